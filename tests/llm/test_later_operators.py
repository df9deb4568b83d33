"""Periodic runs, whitening and byte shards against their plain versions."""

import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm.byte_shards import KEYS, byte_shards, keyed, splitters, write_shards
from tarn.llm.periodic_runs import periodic_runs, runs_of
from tarn.llm.queries import QUERIES
from tarn.llm.whitening import characteristic_polynomial, isolated_root, null_vector, roots_above, whiten
from tarn.session import scratch_path
from tests.llm import brute

# Periodic runs


def test_runs_of_random_words_equal_the_plain_version():
    draw = random.Random(3)
    for _ in range(400):
        documents = []
        for _ in range(draw.randint(1, 4)):
            words = []
            for _ in range(draw.randint(0, 5)):
                base = [draw.randint(0, draw.choice([1, 2, 30])) for _ in range(draw.choice([1, 2, 5, 8, 16, 17, 33]))]
                words += (base * 26)[: draw.randint(1, 120)]
            documents.append(words)
        limits = draw.choice([(24, 3), (6, 3), (10, 4), (1, 3)])
        codes = np.array([w for d in documents for w in d], np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in documents])])
        expected = sorted((i, *r) for i, d in enumerate(documents) for r in brute.periodic_runs(d, *limits))
        assert runs_of(codes, bounds, *limits) == expected


def test_fewer_than_three_periods_are_refused():
    with pytest.raises(ValueError, match="three periods"):
        runs_of(np.zeros(4, np.int64), np.array([0, 4]), 4, 2)


def test_runs_of_edge_rows(spark, edge_docs, no_docs):
    texts = [
        (1, " a b " * 40), (2, "x" + " y" * 23), (3, "x" + " y" * 24 + "\ty\x0bz"), (4, "é ü ö " * 30), (4, None), (None, "p q r " * 9),
        (5, " \n"), (6, "lead " + "one two three " * 5000 + "tail"), (7, "q " * 24 + "r " + "q " * 24 + "r " + "q " * 24),
    ]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = periodic_runs(docs).collect() + periodic_runs(edge_docs).collect()
    given = texts + [tuple(r) for r in edge_docs.select("doc_id", "text").collect()]
    expected = []
    for i, t in given:
        words = brute.words_of(t or "")
        runs = brute.periodic_runs(words)
        expected.append((i, len(words), runs, brute.collapsed(words, runs)))
    order = repr
    assert sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found), key=order) == sorted(expected, key=order)
    assert periodic_runs(no_docs).count() == 0


@pytest.mark.parametrize("name", ["op11_periodic_runs"])
def test_runs_of_given_documents(spark, sf_dir, given_docs, name):
    found = {r["doc_id"]: r for r in QUERIES[name](spark, sf_dir).collect()}
    assert len(found) == len(given_docs)
    with_runs = 0
    for i, text, *_ in given_docs:
        words = brute.planted_words(i, text)
        runs = brute.periodic_runs(words)
        row = found[i]
        assert row["n_runs"] == len(runs) and row["n_words"] == len(words)
        listed = "".join(f"{s},{n},{p}\n" for s, p, n in runs)
        assert row["runs_sha256"] == brute.sha(listed)
        assert row["collapsed_sha256"] == brute.sha(brute.collapsed(words, runs))
        if runs:
            with_runs += 1
            best = min(runs, key=lambda r: (-r[2] * 10**12 // r[1], r[0], r[1]))
            assert (row["start"], row["period"], row["length"]) == best and row["exponent_milli"] == 1000 * best[2] // best[1]
        else:
            assert row["start"] is row["length"] is row["period"] is row["exponent_milli"] is None
    assert with_runs


# Whitening


def plain_whitening(vectors, components=16, scale=64):
    rows = np.array([[int(np.floor(scale * float(c))) for c in v] for v in vectors], np.int64)
    fit = np.unique(rows, axis=0)
    mean = fit.mean(axis=0)
    values, axes = np.linalg.eigh((fit - mean).T @ (fit - mean) / len(fit))
    order = [i for i in np.argsort(values)[::-1][:components] if values[i] > 1e-9]
    return len(fit), ((rows - mean) @ axes[:, order]) / np.sqrt(values[order]), values[order] / values.sum()


def test_polynomial_roots_and_axes_of_known_matrices(spark):
    matrix = np.array([[4, 1, 0], [1, 4, 0], [0, 0, 5]], object)  # roots 5, 5, 3
    polynomial = characteristic_polynomial(spark, matrix)
    assert polynomial == [-75, 55, -13, 1]
    assert [roots_above(polynomial, a, 1) for a in (0, 6, 9, 10)] == [3, 2, 2, 0]
    assert [(r >> 256, m, n) for r, m, n in (isolated_root(polynomial, i, 16) for i in (1, 2, 3))] == [(5, 1, 2), (5, 2, 2), (3, 1, 1)]
    first, second = (null_vector(matrix, 5 << 256, m) for m in (1, 2))
    for v in (first, second):
        assert np.abs(matrix.astype(float) @ v - 5 * v).max() < 1e-14
    assert abs(first @ second) < 1e-14


def test_axes_of_nearly_equal_roots_are_exact():
    # Roots 10^12 + 1 and 10^12 whose gap doubles hardly see, turned by a rational rotation (3, 4, 5).
    big = 10**12
    matrix = np.array([[9 * (big + 1) + 16 * big, 12], [12, 16 * (big + 1) + 9 * big]], object)
    vector = null_vector(matrix, 25 * (big + 1) << 256, 1)
    assert np.abs(vector - np.array([0.6, 0.8])).max() < 1e-15


def test_whitening_of_edge_rows(spark):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(40, 5)) * [3, 2, 1, 0.5, 0.25]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(base)] + [(3, base[3].tolist(), 2), (None, base[5].tolist(), 2)]
    dropped = [(100, None, 0), (101, [], 0), (102, [1.0, None, 0.0, 0.0, 0.0], 0), (103, [1.0, float("nan"), 0.0, 0.0, 0.0], 0), (104, [float("-inf")] * 5, 0)]
    short = [(50, [1.5, -2.5], 0)]
    df = spark.createDataFrame(rows + dropped + short, "vec_id bigint, embedding array<double>, n int")
    found = whiten(df, components=4).collect()
    vectors = [v for _, v, _ in rows] + [[1.5, -2.5, 0, 0, 0]]
    n, expected, shares = plain_whitening(vectors, 4)
    assert len(found) == len(vectors) and {r["n"] for r in found} == {n}
    keys = [i for i, *_ in rows] + [50]
    by_id = defaultdict(list)
    for k, w in zip(keys, expected, strict=True):
        by_id[k].append(w)
    signs = np.sign(np.array([r["whitened"] for r in found if r["vec_id"] == 0]) * by_id[0][0])
    for r in found:
        assert min(np.abs(np.array(r["whitened"]) * signs - w).max() for w in by_id[r["vec_id"]]) < 1e-10
        assert r["explained"] == pytest.approx(shares.tolist(), rel=1e-12) and r["identity_error"] < 1e-12


def test_whitening_without_spread(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert whiten(empty).count() == 0
    equal = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id bigint, embedding array<float>")
    assert [(r["n"], int(r["deviation"]), r["whitened"]) for r in whiten(equal).collect()] == [(1, 0, []), (1, 0, [])]
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id bigint, embedding array<float>")
    assert {len(r["whitened"]) for r in whiten(line).collect()} == {1}
    # The corners of a cross: two equal roots.
    cross = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, -1.0])], "vec_id bigint, embedding array<float>")
    found = whiten(cross).collect()
    assert {len(r["whitened"]) for r in found} == {2} and found[0]["identity_error"] < 1e-14


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(i) * 2**40, float(i % 3)]) for i in range(12)]
    found = {r["vec_id"]: r for r in whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), scale=1).collect()}
    y = [[int(c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*y, strict=True)]
    assert all(int(found[i]["deviation"]) == sum((12 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in enumerate(y))


def test_whitening_of_given_embeddings(spark, sf_dir):
    found = QUERIES["op12_embedding_whitening"](spark, sf_dir).toPandas()
    given = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf_dir}/embeddings.parquet' ORDER BY 1").fetchall()
    n, expected, shares = plain_whitening([v for _, v in given])
    assert len(found) == 16 * len(given) and set(found["n"]) == {n} and found["identity_error"].max() < 1e-12
    wide = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(wide * np.sign((wide * expected).sum(axis=0)) - expected).max() < 1e-9
    assert found.groupby("component")["explained"].first().to_numpy() == pytest.approx(shares, rel=1e-12)


# Byte shards


def check_shards(rows, shards, tolerance=0.001):
    """``rows`` are (text, size, shard, slot): sizes right, slots gapless, every end as near as promised."""
    slots, sizes, groups = defaultdict(list), defaultdict(int), defaultdict(set)
    weight = defaultdict(int)
    for text, size, shard, slot in rows:
        assert size == len((text or "").encode()) + 1 and 0 <= shard < shards
        slots[shard].append(slot)
        sizes[shard] += size
        groups[text or ""].add(shard)
        weight[text or ""] += size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, largest = sum(sizes.values()), max((size for _, size, *_ in rows), default=0)
    slack = max(tolerance * total / shards, largest / 2) + 1
    below = 0
    for shard in range(shards - 1):
        below += sizes[shard]
        assert abs(below - total * (shard + 1) / shards) <= slack
    assert all(len(s) == 1 or weight[t] > largest or weight[t] > tolerance * total / shards for t, s in groups.items())


def listed(df):
    return [tuple(r) for r in df.select("text", "size", "shard", "slot").collect()]


def test_shards_of_edge_rows(edge_docs, no_docs):
    found = byte_shards(edge_docs.withColumn("shard", F.lit(7)), shards=3)
    assert set(found.columns) == {*edge_docs.columns, "size", "shard", "slot"}
    check_shards(listed(found), 3)
    assert byte_shards(no_docs).count() == 0
    check_shards(listed(byte_shards(edge_docs, shards=40)), 40)
    assert listed(byte_shards(edge_docs, shards=1)) != [] and {r[2] for r in listed(byte_shards(edge_docs, shards=1))} == {0}


def test_large_groups_are_split_and_small_ones_are_not(spark):
    rows = [(i, "the same text again") for i in range(600)] + [(None, "nobody's text") for _ in range(600)]
    rows += [(1000 + i, f"text {i // 2} " + "word " * (i // 2 % 40)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = listed(byte_shards(docs, shards=8))
    check_shards(found, 8)
    spread = defaultdict(set)
    for text, _, shard, _ in found:
        spread[text].add(shard)
    assert len(spread["the same text again"]) > 1 and len(spread["nobody's text"]) > 1
    assert sorted(found, key=repr) == sorted(listed(byte_shards(docs.repartition(5), shards=8)), key=repr)
    # Cells that equal rows overfill are dealt on; all else stays where it was.
    dealt = listed(byte_shards(docs, shards=8, cell_rows=5))
    check_shards(dealt, 8)
    assert {r[:3] for r in dealt} == {r[:3] for r in found}


def test_splitters_are_where_a_plain_count_puts_them(spark):
    docs = spark.createDataFrame([(i, "w " * (i * 37 % 101)) for i in range(700)], "doc_id bigint, text string")
    narrow = keyed(docs, "doc_id", "text", 1).select("_size", *KEYS)
    rows = sorted((*(r[k] for k in KEYS), r["_size"]) for r in narrow.collect())
    total, largest = sum(r[-1] for r in rows), max(r[-1] for r in rows)
    for i, splitter in enumerate(splitters(narrow, 6, 0.0), 1):
        below = sum(r[-1] for r in rows if r[: len(splitter)] < splitter)
        assert abs(below - total * i / 6) <= largest / 2


def test_shards_are_written_as_folders(spark, edge_docs):
    path = scratch_path(spark, "shards")
    sharded = byte_shards(edge_docs, shards=3)
    write_shards(sharded, path)
    assert sorted(listed(spark.read.parquet(path)), key=repr) == sorted(listed(sharded), key=repr)


def test_shards_of_given_documents(spark, sf_dir, given_docs):
    found = QUERIES["op13_byte_shards"](spark, sf_dir).collect()
    texts = {i: t or "" for i, t, *_ in given_docs}
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["law"] == "bytes" and r["grown_shard"] is None for r in found)
    check_shards([(texts[r["doc_id"]], r["size"], r["shard"], r["slot"]) for r in found], 16)


# Repeated strings: rows of one id, and hashes that collide


def test_rows_of_one_id_are_texts_of_their_own(spark):
    from tarn.llm.suffix_dedup import without_repeats

    draw = random.Random(8)
    texts = ["".join(draw.choices("abcdefgh ", k=300)) for _ in range(60)]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(None, texts[7][50:250]), (5, texts[9])], "doc_id bigint, text string")
    found = without_repeats(docs, length=100, token=25)
    given = [*texts, texts[7][50:250], texts[9]]
    plain = brute.without_repeats(given, 100)
    expected = sorted((n, gone, bytes(kept)) for n, gone, _, kept in plain)
    assert sorted((r[1], r[1] - len(r[2]), bytes(r[2])) for r in found.collect()) == expected
    assert sum(gone > 0 for _, gone, *_ in plain) == 4


def test_colliding_hashes_remove_nothing_that_does_not_repeat(monkeypatch):
    from tarn.llm import suffix_dedup

    draw = random.Random(9)
    shared = bytes(draw.choices(b"xyz", k=130))
    texts = [bytes(draw.choices(b"abc", k=140)) for _ in range(30)] + [b"1" + shared, shared + b"2"]
    real = suffix_dedup.Hashes.of
    monkeypatch.setattr(suffix_dedup.Hashes, "of", lambda self, a, b: real(self, a, b) & np.uint64(1))
    # One token for all, and the distance 0: every start of one place is held equal by the hash.
    runs = [(0, 60, len(t) - 100 + 1, False, t) for t in texts]
    found = suffix_dedup.repeated_starts(runs, 100, 25)
    for t, again in zip(texts, found, strict=True):
        for i, verdict in enumerate(again.tolist()):
            same = sum(u[i : i + 100] == t[i : i + 100] for u in texts)
            assert verdict == (same > 1)
