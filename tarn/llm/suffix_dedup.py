"""Removal of long repeated byte strings by a sparse, range-partitioned suffix array.

Which suffixes matter is decided by the text alone: each string of ``length`` bytes has an
anchor, the position in it whose ``token`` bytes have the least hash, so equal strings have
their anchors at the same place. Consecutive strings with one anchor form a run, and only the
runs whose leading token occurs again are kept.

1. Runs that are equal as a whole are combined (map-side first) into classes with a count.
2. Classes whose leading token is shared by other classes are range-partitioned by that token
   with sampled splitters; a token never straddles two buckets, and within a bucket the
   portions are cut between tokens, so neighbours across a boundary differ in their first token.
3. A bucket sorts the suffixes at all starts of its runs by multikey quicksort: groups of equal
   leading tokens are sorted by the next one until they are alone. What is still equal after
   ``length`` bytes occurs elsewhere.
4. The verdicts of a class go back to all of its members.

Equal runs are told by a 128-bit digest of their bytes. Tokens are grouped by a fast hash, which
never parts equal ones, and what is left equal at the end is compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import keyed_text, text_batches
from tarn.session import cut_lineage

#: Bytes of runs that a bucket sorts at once.
PORTION = 3_000_000
_WRAP = 2**64
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(5).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64; kept by the worker."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, _WRAP))):
            line = np.full(1 << (n - 1).bit_length(), base, np.uint64)
            line[0] = 1
            _POWERS[i] = np.multiply.accumulate(line)
    return _POWERS


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Hashes:
    """Hashes of any substrings of one byte string, from the prefix sums of a polynomial."""

    def __init__(self, line: np.ndarray):
        powers, self._inverse = _powers(len(line) + 1)
        self._sums = np.zeros(len(line) + 1, np.uint64)
        np.cumsum(_BYTES[line] * powers[: len(line)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self._sums[ends] - self._sums[starts]) * self._inverse[starts])

    def all_of(self, size: int) -> np.ndarray:
        n = len(self._sums) - size
        return _mixed((self._sums[size:] - self._sums[:n]) * self._inverse[:n])


def runs_of(text: bytes, length: int, token: int) -> tuple[np.ndarray, ...]:
    """Runs of a text: first start, number of starts, anchor, hash of its token, digest of the run's bytes."""
    line = np.frombuffer(text, np.uint8)
    strings, width = len(line) - length + 1, length - token + 1
    if strings < 1:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64), [])
    hashes = Hashes(line)
    tokens = hashes.all_of(token)
    # Hash above, place below: the least of a window is its leftmost least token.
    bits = np.uint64(max(24, len(tokens).bit_length()))
    ranked = tokens >> bits << bits | np.arange(len(tokens), dtype=np.uint64)
    padded = np.concatenate((ranked, np.full(-len(ranked) % width, _WRAP - 1, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:strings], ahead[width - 1 : width - 1 + strings])
    anchor = (least & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    count = np.diff(np.append(first, strings))
    at = anchor[first]
    view = memoryview(text)
    ends = (first + count - 1 + length).tolist()
    whole = [blake2b(view[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), ends, strict=True)]
    return first, count, at, tokens[at], whole


def _runs(docs: DataFrame, length: int, token: int) -> DataFrame:
    """``_row, _first, _count, _anchor, _token, _run`` of all runs of ``_row, _text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = [runs_of(t.encode(), length, token) for t in batch.column(1).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            first, count, at, tokens = (np.concatenate(x) for x in zip(*(f[:4] for f in found), strict=True))
            whole = [w for f in found for w in f[4]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)),
                 pa.array((at - first).astype(np.int32)), pa.array(tokens.view(np.int64)), pa.array(whole, pa.binary())],
                names=["_row", "_first", "_count", "_anchor", "_token", "_run"],
            )

    return docs.select("_row", "_text").mapInArrow(
        run, "_row bigint, _first int, _count int, _anchor int, _token bigint, _run binary"
    )


def equal_bytes(line: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """``group`` numbers (of strings that one hash holds equal) parted where the bytes differ."""
    order = np.argsort(group, kind="stable")
    heads = np.concatenate(([True], group[order][1:] != group[order][:-1]))
    first = np.empty(len(group), np.int64)
    first[order] = start[order][np.flatnonzero(heads)[np.cumsum(heads) - 1]]
    odd = np.zeros(len(group), bool)
    for at in range(0, len(group), 20_000):
        part = slice(at, at + 20_000)
        steps = np.arange(length)
        odd[part] = (line[start[part, None] + steps] != line[first[part, None] + steps]).any(axis=1)
    if not odd.any():
        return group
    # A collision: every group that has one is parted by its bytes themselves.
    parted = np.isin(group, group[odd])
    names: dict[tuple[int, bytes], int] = {}
    group = group.copy()
    for i in np.flatnonzero(parted).tolist():
        key = int(group[i]), line[start[i] : start[i] + length].tobytes()
        group[i] = names.setdefault(key, len(start) + len(names))
    return group


def repeated_starts(runs: list[tuple[int, int, int, bool, bytes]], length: int, token: int) -> list[np.ndarray]:
    """For each run (token, anchor, number of starts, known, bytes) which of its starts occur again.

    ``known`` runs occur twice themselves; they are partners of the others.
    """
    line = np.frombuffer(b"".join(r[4] for r in runs), np.uint8)
    hashes = Hashes(line)
    sizes = np.array([len(r[4]) for r in runs])
    counts = np.array([r[2] for r in runs])
    run = np.repeat(np.arange(len(runs)), counts)
    inner = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = (np.cumsum(sizes) - sizes)[run] + inner
    _, leading = np.unique(np.array([r[0] for r in runs], np.int64), return_inverse=True)
    # Equal strings have the same leading token at the same distance.
    label = leading[run] * (2 * length) + np.array([r[1] for r in runs])[run] - inner
    weight = np.array([2 if r[3] else 1 for r in runs])[run]
    left = np.arange(len(run))
    for depth in range(0, length, token):
        ends = np.minimum(start[left] + depth + token, start[left] + length)
        key = hashes.of(start[left] + depth, ends)
        order = np.lexsort((key, label[left]))
        left, key = left[order], key[order]
        new = np.concatenate(([True], (label[left][1:] != label[left][:-1]) | (key[1:] != key[:-1])))
        group = np.cumsum(new) - 1
        label[left] = group
        left = left[np.bincount(group, weight[left])[group] >= 2]
        if not len(left):
            break
    if len(left):
        _, group = np.unique(equal_bytes(line, start[left], label[left], length), return_inverse=True)
        left = left[np.bincount(group, weight[left])[group] >= 2]
    again = np.zeros(len(run), bool)
    again[left] = True
    return np.split(again, np.cumsum(counts)[:-1])


def _spans(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [{"lo": int(lo), "hi": int(hi)} for lo, hi in edges.reshape(-1, 2)]


def _verdicts(texts: DataFrame, length: int, token: int) -> DataFrame:
    """``_token, _run, _spans``: the starts of each class (of ``_bytes``) that occur elsewhere."""
    spread = texts.repartitionByRange("_token").sortWithinPartitions("_token")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def judge(rows: list[tuple]) -> pa.RecordBatch:
            found = repeated_starts([(r[0], r[2], r[3], r[4] > 1, r[5]) for r in rows], length, token)
            columns = [[r[0] for r in rows], [r[1] for r in rows], [_spans(f) for f in found]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["_token", "_run", "_spans"])

        types = [pa.int64(), pa.binary(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))]
        size = 0
        for batch in text_batches(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > PORTION and row[0] != held[-1][0]:
                    yield judge(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield judge(held)

    columns = ["_token", "_run", "_anchor", "_count", "_rows", "_bytes"]
    return spread.select(*columns).mapInArrow(run, "_token bigint, _run binary, _spans array<struct<lo:int,hi:int>>")


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, token: int = 50
) -> DataFrame:
    """``<id>, text_bytes, kept, spans`` of every row: its bytes less those that a repeat covers.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in the same
    text or another; strings never cross texts and are judged on the input. ``kept`` is binary,
    since a cut may fall inside a character; ``spans`` are the removed [start, end) of bytes. A
    null text counts as empty. Every row is a text of its own under a number of its own, whatever
    ids repeat, so equal rows remove each other's bytes and others leave each other alone. No rows
    give no rows; extra columns are not read.
    """
    if length % token or length < 2 * token:
        raise ValueError("the length must be at least two whole tokens")
    texts = cut_lineage(keyed_text(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()))
    runs = _runs(texts, length, token)
    place = F.struct("_row", "_first")
    classes = (
        runs.groupBy("_token", "_run").agg(
            F.count("*").alias("_rows"), F.min(place).alias("_place"), F.first("_count").alias("_count"),
            F.first("_anchor").alias("_anchor"),
        )
    )
    classes = cut_lineage(classes)
    of_token = classes.groupBy("_token").agg(F.sum("_rows").alias("_all"), F.count("*").alias("_classes"))
    again = cut_lineage(classes.join(of_token.where("_all > 1"), "_token").select(
        "_token", "_run", "_rows", "_count", "_anchor", "_classes", "_place.*"
    ))
    # The bytes of one member of each class that has other classes to be compared with.
    wanted = again.where("_classes > 1").select(
        "_row", F.struct("_token", "_run", "_anchor", "_count", "_rows", "_first").alias("_class")
    )
    cut = F.substring(F.encode("_text", "UTF-8"), F.col("_class._first") + 1, F.col("_class._count") - 1 + F.lit(length))
    fetched = texts.select("_row", "_text").join(wanted, "_row").select("_class.*", cut.alias("_bytes"))
    verdicts = _verdicts(fetched, length, token)
    whole = F.array(F.struct(F.lit(0).alias("lo"), F.col("_count").alias("hi")))
    alone = again.where("_rows > 1").select("_token", "_run", whole.alias("_spans"))
    judged = cut_lineage(alone.unionByName(verdicts.join(again.where("_rows = 1"), ["_token", "_run"], "left_semi")))
    judged = judged.where(F.size("_spans") > 0)
    covered = (
        runs.select("_row", "_first", "_token", "_run").join(judged, ["_token", "_run"])
        .select("_row", F.explode("_spans").alias("_span"), "_first")
        .select(
            "_row",
            F.struct((F.col("_first") + F.col("_span.lo")).alias("start"), (F.col("_first") + F.col("_span.hi") - 1 + F.lit(length)).alias("end")).alias("_cut"),
        )
        .groupBy("_row").agg(F.collect_set("_cut").alias("_cuts"))
    )
    joined = texts.join(covered, "_row", "left").select("_id", "_text", "_cuts")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        for batch in text_batches(batches):
            rows = []
            for text, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                spans: list[list[int]] = []
                for start, end in sorted((c["start"], c["end"]) for c in cuts or ()):
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(end, spans[-1][1])
                    else:
                        spans.append([start, end])
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(data), kept, [{"start": a, "end": b} for a, b in spans]))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["_id", "_bytes", "_kept", "_spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, _bytes bigint, _kept binary, _spans array<struct<start:bigint,end:bigint>>"
    return joined.mapInArrow(remove, schema).select(
        F.col("_id").alias(id_col), F.col("_bytes").alias("text_bytes"), F.col("_kept").alias("kept"), F.col("_spans").alias("spans")
    )
