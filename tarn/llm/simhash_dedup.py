"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming distance.

Fingerprints that differ in at most ``max_bits`` bits agree in at least ``blocks - max_bits`` of
their blocks, so they meet in one of the groups that share such a choice of blocks. With 5
blocks and 2 bits a group shares 38 bits or more: groups stay small and a group can hold at
most 2**26 different fingerprints. A group is compared inside one task without writing its
pairs: it returns a star for each of its linked sets, at most one row per fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.graph.entities import star_rounds
from tarn.llm.common import keyed_text, rows_of, text_batches
from tarn.session import cut_lineage

#: Groups up to this many fingerprints are compared pair by pair, larger ones by flipping bits.
PAIRWISE = 256


def fingerprint(text: bytes, words: int, seed: int) -> int:
    """Majority of the hash bits over all word shingles of a text, repeats included; no word: 0."""
    tokens = text.lower().split()  # bytes: only A-Z change, and only ASCII white space parts words
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(tokens) > words:
        starts, ends = starts[: len(tokens) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    shingles = map(joined.__getitem__, map(slice, starts.tolist(), ends.tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16_384):
        part = hashes[at : at + 16_384].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, digests: bool = False
) -> DataFrame:
    """``_id, _fp``: the signed 64-bit fingerprint of every whole text (null text: as empty).

    With ``digests`` also ``_length, _digest`` of the text, which tell rows of one id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            prints = [fingerprint(t.as_buffer().to_pybytes(), words, seed) for t in batch.column(1)]
            columns = {"_id": batch.column(0), "_fp": pa.array(np.array(prints, np.uint64).view(np.int64))}
            if digests:
                columns["_length"] = pc.utf8_length(batch.column(1)).cast(pa.int64())
                columns["_digest"] = pa.array([sha256(t.as_buffer()).hexdigest() for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = docs.schema[id_col].dataType.simpleString()
    more = ", _length bigint, _digest string" if digests else ""
    return keyed_text(docs, id_col, text_col).mapInArrow(run, f"_id {kind}, _fp bigint{more}")


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """Signed 64-bit masks of every choice of ``blocks - max_bits`` blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(choice) for choice in combinations(parts, blocks - max_bits)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def linked_stars(prints: np.ndarray, max_bits: int, free: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, centre) for the members of ``prints`` (sorted, distinct) that a chain of links joins.

    ``free`` are the bits in which the members of the group may differ.
    """
    n = len(prints)
    label = np.arange(n)
    if n <= PAIRWISE:
        near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= max_bits
        while True:
            least = np.where(near, label[None, :], n).min(axis=1)
            if (least == label).all():
                break
            label = least
    else:
        bits = [1 << b for b in range(64) if free >> b & 1]
        flips = [sum(c) for k in range(1, max_bits + 1) for c in combinations(bits, k)]
        while True:
            least = label.copy()
            for flip in flips:
                other = prints ^ np.uint64(flip)
                at = np.minimum(np.searchsorted(prints, other), n - 1)
                hit = prints[at] == other
                least[hit] = np.minimum(least[hit], least[at[hit]])
            least = least[least]
            if (least == label).all():
                break
            label = least
    moved = np.flatnonzero(label != np.arange(n))
    return prints[moved], prints[label[moved]]


def fingerprint_links(distinct: DataFrame, max_bits: int = 2, blocks: int = 5) -> DataFrame:
    """``a, b`` pairs of linked fingerprints (column ``_fp``) that join all that links join."""
    if not 0 <= max_bits < blocks <= 64:
        raise ValueError("there must be more blocks than bits that may differ")
    masks = block_masks(blocks, max_bits)
    keys = [F.struct(F.lit(i).alias("choice"), F.col("_fp").bitwiseAND(F.lit(m)).alias("key"))
            for i, m in enumerate(masks)]
    blocked = distinct.select("_fp", F.explode(F.array(*keys)).alias("_block"))
    blocked = blocked.select("_block.choice", "_block.key", "_fp").repartition("choice", "key")
    full = (1 << 64) - 1

    def stars(choice: np.ndarray, key: np.ndarray, prints: np.ndarray, last: bool):
        """Links of the groups in sorted rows; the last group is held back unless ``last``."""
        cut = np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
        done = len(starts) if last else len(starts) - 1
        found = []
        for s, e in zip(starts[:done], ends[:done], strict=True):
            if e - s > 1:
                group = np.unique(prints[s:e].view(np.uint64))
                free = full & ~(masks[choice[s]] & full)
                found.append(linked_stars(group, max_bits, free))
        rest = starts[-1] if not last else len(key)
        a = np.concatenate([np.empty(0, np.uint64), *[f[0] for f in found]]).view(np.int64)
        b = np.concatenate([np.empty(0, np.uint64), *[f[1] for f in found]]).view(np.int64)
        return rest, pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            rows = [np.concatenate((h, batch.column(i).to_numpy().astype(np.int64))) for i, h in enumerate(held)]
            if len(rows[0]):
                rest, links = stars(*rows, last=False)
                yield links
                held = [r[rest:] for r in rows]
        if len(held[0]):
            yield stars(*held, last=True)[1]

    return blocked.sortWithinPartitions("choice", "key").mapInArrow(run, "a bigint, b bigint")


def _placed(distinct: DataFrame, max_bits: int, blocks: int) -> DataFrame:
    """The rows of ``distinct`` (one for each ``_fp``) with the least fingerprint of their component as ``_top``."""
    tops = star_rounds(fingerprint_links(distinct.select("_fp"), max_bits, blocks)).select(
        F.col("a").alias("_fp"), F.col("b").alias("_top")
    )
    return distinct.join(tops, "_fp", "left").withColumn("_top", F.coalesce("_top", "_fp"))


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    max_bits: int = 2,
    seed: int = 42,
    blocks: int = 5,
) -> DataFrame:
    """``<id>, fingerprint, component_id`` of every row.

    Texts are lower-cased (A-Z); shingles are ``words`` words, or the whole text if it has
    fewer. A null, empty or blank text has fingerprint zero and links like any other. The
    component is the least id that links reach, null ids aside (it is null if all are). Rows
    that repeat an id each give a row. No rows give no rows. Extra columns are not read.
    """
    # A written table: it is used several times and costs a pass over all texts.
    prints = cut_lineage(fingerprints(docs, id_col, text_col, words, seed))
    distinct = prints.groupBy("_fp").agg(F.min("_id").alias("_least"))
    placed = _placed(distinct, max_bits, blocks)
    least = placed.groupBy("_top").agg(F.min("_least").alias("_component"))
    of_print = placed.join(least, "_top").select("_fp", "_component")
    return prints.join(of_print, "_fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("_component").alias("component_id"),
    )


def near_distinct_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    max_bits: int = 2,
    seed: int = 42,
    blocks: int = 5,
) -> DataFrame:
    """The rows of ``docs`` that stay, in its own columns: one of each component of ``near_groups``.

    It is the row of the least id, null ids last; among rows of one id that of the longest text,
    then of the least digest. Rows that share an id, or have none, but are not near all stay.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, words, seed, digests=True))
    choice = F.struct(F.col("_id").isNull().alias("_null"), "_id", (-F.col("_length")).alias("_back"), "_digest")
    distinct = cut_lineage(prints.groupBy("_fp").agg(F.min(choice).alias("_best")))
    kept = _placed(distinct, max_bits, blocks).groupBy("_top").agg(F.min("_best").alias("_best"))
    kept = cut_lineage(kept.select(F.col("_best._id").alias(id_col), F.col("_best._digest").alias("_digest")))
    return rows_of(docs, kept, id_col, text_col, "_digest", white_space=True)
