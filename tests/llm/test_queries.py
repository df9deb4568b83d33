"""The registered queries and the pipeline over the given tables, against their plain versions."""

import zlib

import duckdb
import pytest

import corpus_pipeline
from tarn.llm.queries import ORACLES, QUERIES, tokenizer_path
from tarn.llm.source_mix import mix_plan
from tests.llm import brute


def by_id(df):
    found = {r[0]: r.asDict() for r in df.collect()}
    assert len(found) == df.count()
    return found


def test_all_operators_are_registered():
    import __spark_entry__

    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [q for n in range(1, 14) for q in QUERIES if q.startswith(f"op{n}_")]
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())


def test_line_dedup(spark, sf_dir, given_docs):
    removed = brute.repeated_lines([d[:2] for d in given_docs])
    found = by_id(QUERIES["op1_line_dedup"](spark, sf_dir))
    assert {i: r["removed"] for i, r in found.items()} == {i: ",".join(map(str, removed[i, t or ""])) for i, t, *_ in given_docs}


def test_codec(spark, sf_dir, given_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    found = by_id(QUERIES["op2_bpe_codec"](spark, sf_dir))
    for i, text, *_ in given_docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        row = found[i]
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), brute.sha(" ".join(map(str, ids))))
        assert row["decoded_sha256"] == brute.sha(tokenizer.decode(ids, skip_special_tokens=False))


def test_mix(spark, sf_dir, given_docs):
    found = by_id(QUERIES["op3_source_mix"](spark, sf_dir))
    size = {i: len((t or "").encode().split()) for i, t, *_ in given_docs}
    totals, most, taken = {}, {}, {}
    for i, _, _, source in given_docs:
        totals[source] = totals.get(source, 0) + size[i]
        most[source] = max(most.get(source, 0), size[i])
        taken[source] = taken.get(source, 0) + found[i]["taken"]
    targets = brute.water_filling(totals)
    for i, _, _, source in given_docs:
        row = found[i]
        assert (row["size"], row["source_size"]) == (size[i], totals[source]) and row["taken"] <= 3 * size[i]
        assert row["target"] == pytest.approx(targets[source])
    assert all(abs(taken[s] - targets[s]) <= most[s] for s in totals)


def test_exact_dedup(spark, sf_dir):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    expected = connection.execute(ORACLES["op4_exact_dedup"])
    names = [c[0] for c in expected.description]
    found = QUERIES["op4_exact_dedup"](spark, sf_dir).select(*names)
    assert sorted(map(tuple, found.collect())) == sorted(expected.fetchall())


def test_personal_data(spark, sf_dir, given_docs):
    found = by_id(QUERIES["op5_pii_bootstrap"](spark, sf_dir))
    kinds = ("email", "ip", "card", "phone")
    for i, text, *_ in given_docs:
        base = brute.base_spans(text or "")
        named = [f"{kinds[k]}:{s}:{e}" for s, k, e in base]
        row = found[i]
        assert row["base_sha256"] == brute.sha(",".join(named)) and set(named) <= set(row["spans"].split(","))
        assert [row[f"n_{k}"] for k in kinds] == [sum(b[1] == n for b in base) for n in range(4)]


def test_score(spark, sf_dir, given_docs):
    found = by_id(QUERIES["op6_ctw_score"](spark, sf_dir))
    training = [zlib.crc32(str(i).encode()) % 7 != 2 for i, *_ in given_docs]
    base, tokens = brute.unigram([d[:2] for d in given_docs], training)
    for (i, *_), learn, (n, known, score) in zip(given_docs, training, base, strict=True):
        row = found[i]
        assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (not learn, n, known, tokens)
        assert row["base_score"] == pytest.approx(score)
    learned = [found[i]["bits_per_byte"] for (i, *_), learn in zip(given_docs, training, strict=True) if learn]
    assert sum(learned) / len(learned) < 2.5


def test_suffix_dedup(spark, sf_dir, given_docs):
    found = by_id(QUERIES["op7_suffix_dedup"](spark, sf_dir))
    for (i, *_), (n, gone, spans, kept) in zip(given_docs, brute.without_repeats([d[1] for d in given_docs], 400), strict=True):
        assert tuple(found[i].values()) == (i, n, gone, spans, brute.sha(kept), kept.decode("utf-8", "replace"))


def test_embeddings(spark, sf_dir):
    vectors = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf_dir}/embeddings.parquet'").fetchall()
    found = by_id(QUERIES["op8_embedding_dedup"](spark, sf_dir))
    for (i, _), (n, component) in zip(vectors, brute.near_vectors(vectors), strict=True):
        assert tuple(found[i].values()) == (i, n, component, i == component)


def test_simhash(spark, sf_dir, given_docs):
    found = by_id(QUERIES["op9_simhash_dedup"](spark, sf_dir))
    assert [tuple(found[r[0]].values()) for r in brute.simhash_groups([d[:2] for d in given_docs])] == brute.simhash_groups([d[:2] for d in given_docs])


def test_languages(spark, sf_dir, given_docs):
    found = by_id(QUERIES["op10_language_id"](spark, sf_dir))
    training = [zlib.crc32(str(i).encode()) % 4 != 2 for i, *_ in given_docs]
    known = brute.profiles([d[:3] for d in given_docs], training)
    right = []
    for (i, text, lang, _), learn in zip(given_docs, training, strict=True):
        row = found[i]
        expected, score = brute.identify(text, known)
        assert (row["held_out"], row["lang_pred"]) == (not learn, expected) and row["score"] == pytest.approx(score)
        right += [] if learn else [row["lang_pred"] == lang]
    assert sum(right) >= 0.95 * len(right)


def test_pipeline(spark, sf_dir, given_docs):
    """Each stage against its plain version; the mix is taken from the plan, which has a test of its own."""
    from tokenizers import Tokenizer

    docs = [d for d in given_docs if d[1] and any(c.isalpha() for c in d[1])]
    groups = {r[0]: r[3] for r in brute.exact_groups([d[:2] for d in docs])}
    docs = [d for d in docs if groups[d[0]]]
    groups = {r[0]: r[2] for r in brute.simhash_groups([d[:2] for d in docs])}
    docs = [d for d in docs if groups[d[0]] == d[0]]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mix_plan(frame).collect()}
    tokenizer = Tokenizer.from_file(tokenizer_path())
    expected = []
    for i, text, *_ in docs:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        row = (i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(tokenizer.decode(ids, skip_special_tokens=False)))
        expected += [row] * copies[i]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(expected)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "source_mix", "bpe_codec"]
