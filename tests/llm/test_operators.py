"""Operators on the edge rows, on no rows, and against their plain versions."""

import math
import random
import re
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from tarn.llm.bpe_codec import Codec, Lexicon, Merger, Vocabulary, compile_lexicon, encode_and_decode
from tarn.llm.common import crc32_of_id
from tarn.llm.ctw import score_documents
from tarn.llm.embedding_dedup import near_vectors
from tarn.llm.exact_dedup import distinct_documents, exact_groups
from tarn.llm.language_id import identify_languages, with_known_language
from tarn.llm.line_dedup import group_candidates, repeated_lines, without_repeated_lines
from tarn.llm.pii_bootstrap import base_spans, find_personal_data
from tarn.llm.queries import tokenizer_path
from tarn.llm.simhash_dedup import linked_stars, near_distinct_documents, near_groups
from tarn.llm.source_mix import mix_plan, mixed_documents
from tarn.llm.suffix_dedup import without_repeats
from tests.llm import brute
from tests.llm.conftest import rows

PAIRS = [(r[0], r[1]) for r in rows()]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_line_dedup(edge_docs, no_docs):
    found = repeated_lines(edge_docs)
    removed = brute.repeated_lines(PAIRS)
    expected = [(i, len((t or "").split("\n")), removed[i, t or ""]) for i, t in PAIRS]
    assert collected(found) == sorted(expected, key=repr)
    assert collected(repeated_lines(no_docs)) == []
    unique = edge_docs.where("doc_id IN (11, 12)")
    assert without_repeated_lines(unique).columns == unique.columns
    assert {r["doc_id"]: r["text"] for r in without_repeated_lines(unique).collect()} == {11: "le la les été où çà être", 12: ""}


def test_line_dedup_of_a_large_group(spark):
    """More variants of a line than a round names: none is lost."""
    generator = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    docs = []
    for i in range(120):
        line = [*words]
        for place in generator.sample(range(12), 1 if i % 3 else 4):
            line[place] = f"x{generator.randrange(10**6)}"
        docs.append((i, " ".join(line)))
    found = repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string"))
    removed = brute.repeated_lines(docs)
    assert {r[0]: r[2] for r in found.collect()} == {i: removed[i, t] for i, t in docs}


def test_group_candidates_come_in_rounds():
    import numpy as np

    n = 100
    size, at = np.full(n, 10), np.zeros(n, np.int64)
    named = set()
    for skip in (0, 32, 64, 96):
        i, j, more = group_candidates(np.arange(n), size, at, 0.8, skip)
        named |= set(zip(i.tolist(), j.tolist(), strict=True))
        assert (len(more) == 0) == (skip == 96)
    assert named == {(i, j) for i in range(n) for j in range(i)}


def test_small_and_large_groups_name_the_same_candidates():
    import numpy as np

    from tarn.llm.line_dedup import whole_candidates

    random_bits = np.random.default_rng(3)
    n = 90
    size, at = random_bits.integers(9, 12, n), random_bits.integers(0, 2, n)
    bits = np.zeros((2, n), np.uint64)
    bits[0] = np.uint64(1) << random_bits.integers(0, 4, n).astype(np.uint64)
    wanted = np.arange(n) % 5 > 0
    for skip, most in ((0, 4), (4, 8), (12, 100)):
        one = group_candidates(np.arange(n), size, at, 0.8, skip, bits, wanted, most)
        other = whole_candidates(np.arange(n), size, at, 0.8, skip, bits, wanted, most)
        assert all(a.tolist() == b.tolist() for a, b in zip(one, other, strict=True))
        assert len(one[0]) and (len(one[2]) > 0) == (most < 100)


def test_lines_that_only_share_a_rare_word_are_not_verified(spark, monkeypatch):
    """Bits of the words tell unlike lines apart before any pair is written."""
    from tarn.llm import line_dedup

    generator = random.Random(6)
    pool = [f"often{i}" for i in range(20)]
    docs = [(i, " ".join([f"rare{i % 4}", *generator.sample(pool, 9)])) for i in range(200)]
    docs.append((200, docs[3][1]))
    verified, counted = line_dedup._verified, []

    def counting(pairs, *rest):
        counted.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(line_dedup, "_verified", counting)
    found = repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string"))
    removed = brute.repeated_lines(docs)
    assert {r[0]: r[2] for r in found.collect()} == {i: removed[i, t] for i, t in docs}
    assert sum(counted) < 100


def test_words_of_lines_in_a_batch():
    import pyarrow as pa

    from tarn.llm.line_dedup import words_in

    texts = ["", " a\x0bb \n\n a\x1cé a\r\n", "z\u00a0z\tz", "\n"]
    lines, counts, word, distinct = words_in(pa.array(texts))
    expected = [line.split() for t in texts for line in t.encode().split(b"\n")]
    assert lines.tolist() == [t.count("\n") + 1 for t in texts]
    assert counts.tolist() == [len(x) for x in expected]
    assert [distinct[i] for i in word] == [w for x in expected for w in x]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_codec_equals_the_tokenizer(tokenizer):
    with open(tokenizer_path(), "rb") as file:
        content = file.read()
    vocabulary = Vocabulary(content)
    words = ["the", "there", "there's", "here", "naïve", "über", "42"]
    entries = {w.encode(): vocabulary.merge(w) for w in words}
    lexicon = Lexicon(compile_lexicon(entries))
    positions = lexicon.positions([*entries, b"ther", b"theres", b"", b"zz"]).tolist()
    assert sorted(positions[: len(words)]) == list(range(len(words))) and positions[len(words) :] == [-1] * 4
    assert [lexicon.ids_at(p) for p in positions[: len(words)]] == list(entries.values())
    assert Lexicon(compile_lexicon({})).positions([b"a"]).tolist() == [-1]
    texts = [
        "", " \n", "Hello, World's it's I'LL 123 ΣΑΣ", "<|endoftext|>", "a<|startoftext|>b<|ENDOFTEXT|>", "é İ ﬁ 日本語 😀😀",
        "x\u0085y z　", "ab" * 300, *["a" + chr(c) + "b" + chr(c) * 2 for c in range(0x2FF)],
    ]
    codec = Codec(content, compile_lexicon(entries))
    encoded = codec.encode(texts)
    for text, ids, expected in zip(texts, encoded, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == expected.ids, text
        assert codec.decode(ids) == tokenizer.decode(expected.ids, skip_special_tokens=False)
    some = ["".join(random.Random(i).choices("abcdeinorst", k=1 + i % 30)) for i in range(500)]
    assert Merger(vocabulary).merge(some) == {w: vocabulary.merge(w) for w in some}


def test_codec_equals_the_tokenizer_at_every_code_point(tokenizer):
    with open(tokenizer_path(), "rb") as file:
        codec = Codec(file.read(), compile_lexicon({}))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    blocks = ["".join(f"a{c}1{c}!{c} " for c in points[at : at + 500]) for at in range(0, len(points), 500)]
    marks = [c for c in points if unicodedata.combining(c) or len(unicodedata.normalize("NFD", c)) > 1]
    for c in marks:  # composed and decomposed, and between marks of other classes
        parts = unicodedata.normalize("NFD", c)
        blocks.append(f"{parts} a{parts}\u0301 \u0345{parts}\u0334 e\u0301{c}\u0323\u0301 Σ{c}")
    rng = random.Random(5)
    blocks += ["".join(rng.choices(marks, k=12)) + "aÉ" + "".join(rng.choices(points, k=20)) for _ in range(3_000)]
    for text, ids, expected in zip(blocks, codec.encode(blocks), tokenizer.encode_batch(blocks, add_special_tokens=False), strict=True):
        assert ids.tolist() == expected.ids, ascii(text)


def test_states_are_shared_between_words_and_suffixes():
    import numpy as np

    content = compile_lexicon({w.encode(): (1,) for w in ("walking", "talking", "walked", "talked")})
    transitions = int(np.frombuffer(content, np.int64)[1])
    assert transitions == len("alking") + 2 + len("ed")


def test_encode_and_decode(edge_docs, no_docs, tokenizer):
    found = encode_and_decode(edge_docs, tokenizer_path(), lexicon_words=5)
    expected = []
    for key, text in PAIRS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        expected.append((key, ids, tokenizer.decode(ids, skip_special_tokens=False)))
    assert collected(found) == sorted(expected, key=repr)
    assert collected(encode_and_decode(no_docs, tokenizer_path())) == []


def test_source_mix(spark, edge_docs, no_docs):
    plan = mix_plan(edge_docs)
    found = plan.collect()
    sizes = [(r[0], len((r[1] or "").encode().split()), r[3]) for r in rows()]
    totals = {s: sum(n for _, n, t in sizes if t == s) for _, _, s in sizes}
    targets = brute.water_filling(totals)
    expected = sorted(((k, n, totals[s], round(targets[s], 6)) for k, n, s in sizes), key=repr)
    assert sorted(((r[0], r[1], r[2], round(r[3], 6)) for r in found), key=repr) == expected
    assert all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in found)
    assert collected(plan) == collected(mix_plan(edge_docs))
    assert collected(mix_plan(no_docs)) == []
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 4}" if i % 3 else None) for i in range(600)], "doc_id bigint, text string, source string")
    plan = mix_plan(docs).join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    assert all(abs(r["taken"] - r["target"]) <= 4 for r in plan.collect())
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == mix_plan(docs).agg(F.sum("copies")).first()[0]


def test_exact_dedup(edge_docs, no_docs):
    assert collected(exact_groups(edge_docs)) == sorted(brute.exact_groups(PAIRS), key=repr)
    assert collected(exact_groups(no_docs)) == []
    stay = distinct_documents(edge_docs)
    assert stay.columns == edge_docs.columns
    kept = {(r[1], r[4]) for r in brute.exact_groups(PAIRS)}
    assert sorted((r["doc_id"] for r in stay.collect()), key=repr) == sorted((k for k, _ in kept), key=repr)


def test_personal_data(spark, edge_docs, no_docs):
    found = find_personal_data(edge_docs)
    names = lambda spans: [tuple(s) for s in spans]
    assert sorted(((r[0], names(r[1])) for r in found.collect()), key=repr) == sorted(
        ((i, brute.base_spans(t or "")) for i, t in PAIRS), key=repr
    )
    assert collected(find_personal_data(no_docs)) == []
    generator = random.Random(7)
    docs = [(i, f"call +1 (269) 555-{1000 + i} now") for i in range(30)] + [(99, "so +1 (269) 555-3296 4524132264652876 it is")]
    spans = {r[0]: (names(r[1]), names(r[2])) for r in find_personal_data(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert spans[99] == ([], [(3, 3, 20)]) and spans[5][0] == spans[5][1] == [(5, 3, 22)]
    for _ in range(3000):
        text = "".join(generator.choice("a1@. +-(2%9") for _ in range(generator.randint(1, 25)))
        assert base_spans(text) == brute.base_spans(text), text


def added_spans(spark, docs):
    """{id: spans that are not base spans} of (id, text) rows."""
    found = find_personal_data(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    return {r[0]: [tuple(s) for s in r[2] if s not in r[1]] for r in found}


def test_personal_data_of_many_tokens(spark):
    """Cards in four groups and phones of six tokens that a longer match swallows, against all windows."""
    generator = random.Random(11)

    def card():
        digits = "4" + "".join(generator.choices("0123456789", k=14))
        digits += next(d for d in "0123456789" if brute.luhn(digits + d))
        return " ".join(digits[i : i + 4] for i in range(0, 16, 4))

    def phone():
        return f"+33 {generator.randint(1, 9)} " + " ".join(f"{generator.randrange(100):02d}" for _ in range(4))

    docs = [(i, f"pay {card()} soon") for i in range(20)] + [(20 + i, f"ring {phone()} soon") for i in range(20)]
    swallowed = [f"order {n} {card()} ok" for n in range(10, 40)] + [f"so {phone()} {card().replace(' ', '')} it" for _ in range(30)]
    swallowed = [t for t in swallowed if not brute.base_spans(t)]
    docs += [(100 + i, t) for i, t in enumerate(swallowed)]
    found, some = added_spans(spark, docs), 0
    shapes = {"9999 9999 9999 9999": 2, "+99 9 99 99 99 99": 3}
    for key, text in docs[40:]:
        tokens = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        windows = [(a, b) for i, (a, _) in enumerate(tokens) for _, b in tokens[i:]]
        expected = []
        for a, b in windows:
            kind = shapes.get(re.sub("[0-9]", "9", text[a:b]))
            if kind is not None and brute.base_spans(text[a:b]) == [(0, kind, b - a)]:
                expected.append((a, kind, b))
        assert found[key] == expected, text
        some += len(expected)
    assert some >= 40 and all(not found[i] for i in range(40))


def test_personal_data_of_unseen_forms(spark):
    """The context of the seeds gives a kind to forms that no expression accepts."""
    docs = [(i, f"call +1 (269) 555-{1000 + i} now") for i in range(30)]
    docs += [(30 + i, f"write to someone.{i}@mail.example.org today") for i in range(30)]
    docs += [(60 + i, f"host 10.1.{i}.7 up") for i in range(30)]
    docs += [(90 + i, f"serial {1000000 + i} of {i}") for i in range(30)]
    unseen = {
        200: ("please call (269) 555-3296 now", "(269) 555-3296", 3), 201: ("call 269-555-3297, maybe", "269-555-3297", 3),
        202: ("call tel:(269) 555-3298 now", "(269) 555-3298", 3), 203: ("call [269.555.3299] now", "269.555.3299", 3),
        204: ("write to joe.doe at mail.example.org today", "joe.doe at mail.example.org", 0),
        205: ("write to joe (at) mail dot example dot org today", "joe (at) mail dot example dot org", 0),
        206: ("host 10[.]0[.]0[.]9 up", "10[.]0[.]0[.]9", 1),
    }
    wrong = {300: "serial 269-555-3296 of", 301: "we met at mail.example.org, all", 302: "host 10[.]0[.]0[.]999 up", 303: "call 12 now"}
    docs += [(i, t) for i, (t, *_) in unseen.items()] + list(wrong.items())
    found = added_spans(spark, docs)
    for i, (text, value, kind) in unseen.items():
        at = text.index(value)
        assert found[i] == [(at, kind, at + len(value))], text
    assert not any(found[i] for i in [*range(120), *wrong])


def test_score(edge_docs, no_docs):
    held_out = F.coalesce(crc32_of_id("doc_id") % 7 == 2, F.lit(False))
    short = edge_docs.where("text IS NULL OR length(text) < 300")
    docs = [(i, t) for i, t in PAIRS if t is None or len(t) < 300]
    training = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in docs]
    base, tokens = brute.unigram(docs, training)
    tree = brute.ContextTree([(t or "").encode() for (_, t), learn in zip(docs, training, strict=True) if learn], 3)
    expected = sorted(
        ((i, n, k, tokens, round(b, 6), round(tree.score((t or "").encode()), 3)) for (i, t), (n, k, b) in zip(docs, base, strict=True)),
        key=repr,
    )
    found = score_documents(short, ~held_out, depth=3)
    assert sorted(((r[0], r[1], r[2], r[3], round(r[4], 6), round(r[5], 3)) for r in found.collect()), key=repr) == expected
    assert collected(score_documents(no_docs, ~held_out)) == []
    untrained = score_documents(short.where("doc_id IN (2, 12)"), F.lit(False)).collect()
    assert {r["doc_id"]: (r["train_tokens"], r["base_score"], round(r["bits_per_byte"], 6)) for r in untrained} == {2: (0, 0.0, 8.0), 12: (0, 0.0, 8.0)}


def test_probabilities_of_all_bytes_add_up_to_one():
    tree = brute.ContextTree([b"abracadabra", b"abraham"], 2)
    bits = [f"{b:08b}" for b in range(256)]
    for context in (b"ba", b"zz", b"\xff\xff"):
        total = sum(math.prod(tree.probability(context, x[:k], int(x[k])) for k in range(8)) for x in bits)
        assert abs(total - 1) < 1e-9


@pytest.mark.parametrize("length, token", [(400, 50), (40, 10)])
def test_suffix_dedup(edge_docs, no_docs, length, token):
    found = without_repeats(edge_docs, length=length, token=token)
    plain = brute.without_repeats([t for _, t in PAIRS], length)
    expected = sorted(((i, n, gone, spans, kept) for (i, _), (n, gone, spans, kept) in zip(PAIRS, plain, strict=True)), key=repr)
    assert sorted(((r[0], r[1], r[1] - len(r[2]), len(r[3]), bytes(r[2])) for r in found.collect()), key=repr) == expected
    assert collected(without_repeats(no_docs)) == []


def test_embedding_dedup(spark):
    generator = random.Random(3)
    base = [[generator.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    vectors = [(i, base[i % 60] if i % 5 else [x + generator.gauss(0, 0.15) for x in base[i % 60]]) for i in range(240)]
    vectors += [(300, None), (301, []), (302, [0.0] * 8), (303, [1.0, None]), (304, [float("nan"), 1.0]), (305, [float("inf")]), (306, [1e-200] * 8), (307, [1.0] * 8), (308, base[0][:5])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").withColumn("_vector", F.lit(1)).withColumn("label", F.lit(2))
    found = {r[0]: (r[1], r[2], r[3]) for r in near_vectors(df).collect()}
    plain = brute.near_vectors([(i, [x * 1e200 for x in v] if i == 306 else v) for i, v in vectors])
    assert found == {i: (n, c, c == i) for (i, _), (n, c) in zip(vectors, plain, strict=True)}
    assert collected(near_vectors(df.where("false"))) == []


def test_simhash(edge_docs, no_docs):
    assert collected(near_groups(edge_docs)) == sorted(brute.simhash_groups(PAIRS), key=repr)
    assert collected(near_groups(no_docs)) == []
    stay = near_distinct_documents(edge_docs)
    assert stay.columns == edge_docs.columns
    assert sorted((r["doc_id"] for r in stay.collect()), key=repr) == sorted({c for _, _, c in brute.simhash_groups(PAIRS)}, key=repr)


def test_rows_that_share_an_id_are_kept_apart(spark):
    """Each component keeps one row, also where ids are null or repeat; a copy never stands for another text."""
    generator = random.Random(5)
    text = [" ".join(generator.choices([f"w{i}" for i in range(500)], k=300)) for _ in range(5)]
    docs = [(None, text[0], "a"), (None, text[1], "a"), (5, text[2], "a"), (None, text[2] + " ", "a"), (6, text[3], "a"), (6, text[4], "b"), (6, text[3], "a")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    expected = [(None, text[0], "a"), (None, text[1], "a"), (5, text[2], "a"), (6, text[3], "a"), (6, text[4], "b")]
    assert collected(near_distinct_documents(df)) == sorted(expected, key=repr)


def test_mix_of_rows_that_share_an_id(spark):
    """The mix has as many rows as the plan, of each source and size, when ids repeat."""
    docs = [(None if i % 3 else i % 4, f"t{i % 50} " * (1 + i % 7), f"s{i % 4}" if i % 5 else None) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    plan = mix_plan(df)
    assert plan.where("copies > 0").groupBy("doc_id").agg(F.countDistinct("copies").alias("n")).agg(F.max("n")).first()[0] > 1
    expected = {(r[0], r[1], r[2]): r[3] for r in plan.groupBy("doc_id", "size", "target").agg(F.sum("copies")).collect() if r[3]}
    found = {}
    for r in mixed_documents(df).groupBy("doc_id", "text", "source").count().collect():
        key = (r["doc_id"], len(r["text"].split()))
        found[key] = found.get(key, 0) + r["count"]
    by_size = {}
    for (i, n, _), copies in expected.items():
        by_size[i, n] = by_size.get((i, n), 0) + copies
    assert found == by_size


def test_stars_of_large_groups_join_what_small_ones_join():
    import numpy as np

    generator = np.random.default_rng(2)
    prints = np.unique(generator.integers(0, 1 << 14, 900).astype(np.uint64) * np.uint64(37) & np.uint64((1 << 26) - 1))
    assert len(prints) > 256
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 2]
    top = brute.components(len(prints), links)
    member, centre = linked_stars(prints, 2, (1 << 26) - 1)
    place = {int(p): i for i, p in enumerate(prints)}
    assert {(place[int(m)], place[int(c)]) for m, c in zip(member, centre, strict=True)} == {(i, t) for i, t in enumerate(top) if i != t}


def test_language_id(edge_docs, no_docs):
    docs = [(r[0], r[1], r[2]) for r in rows()]
    known = brute.profiles(docs, [True] * len(docs))
    expected = sorted(((i, *brute.identify(t, known)) for i, t, _ in docs), key=repr)
    found = collected(identify_languages(edge_docs, F.lit(True)))
    assert [(i, lang, round(s, 9)) for i, lang, s in found] == [(i, lang, round(s, 9)) for i, lang, s in expected]
    assert collected(identify_languages(no_docs, F.lit(True))) == []
    assert {r[1] for r in identify_languages(edge_docs, F.lit(False)).collect()} == {"und"}
    stay = with_known_language(edge_docs, F.lit(True))
    assert stay.columns == edge_docs.columns and {r["doc_id"] for r in stay.collect()} == {i for i, lang, _ in expected if lang != "und"}
    assert with_known_language(edge_docs, F.lit(False)).count() == stay.count()
