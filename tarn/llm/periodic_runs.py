"""Runs: stretches of words that repeat with a period, found by seeds on diagonals.

A run of period q and length n matches itself at lag q over n - q words. For a length of at least
24 and three periods that overlap is never below 16 words, and for q in (K/2, K], K a power of two
above 16, it is above K. So 16-grams are the seeds of all periods up to 16, and K-grams of those
in (K/2, K]. Grams are indexed by naming: a K-gram's name stands for the pair of its halves' names,
so equal names are equal words, not equal hashes. Positions whose gram occurs once in its document
leave the index for good.

The occurrence pairs of a seed are those of neighbouring occurrences. No run is lost by that: in a
run of smallest period q <= K a nearer occurrence, at d < q, would give a window of K + d words
both periods, and so (K >= q) the smaller period gcd(q, d). A seed is extended word by word to both
sides of its diagonal unless the lag's furthest covered word says that it has been.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tarn.llm.common import keyed_text, text_batches

SCHEMA = "n_words bigint, runs array<struct<start:bigint,period:bigint,length:bigint>>, collapsed string"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words `[^\\x20\\x09-\\x0D]+` of the texts in order, and the first one of each text (and the end)."""
    parts = pc.ascii_split_whitespace(texts)
    words = parts.flatten()
    of_text = np.repeat(np.arange(len(texts)), parts.value_lengths().to_numpy(zero_copy_only=False))
    real = pc.not_equal(words, "")  # white space at an end leaves an empty part
    counts = np.bincount(of_text[real.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return words.filter(real), np.concatenate([[0], np.cumsum(counts)])


def least_overlap(min_length: int, min_exponent: int) -> int:
    """Words that every run matches itself over at the least: min over q of max(min_length - q, (e - 1) q)."""
    return min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, min_length + 1))


class GramIndex:
    """Names of the K-grams of many documents, K doubling; grams of different documents differ."""

    def __init__(self, codes: np.ndarray, doc_of: np.ndarray):
        self.size = 1
        self.names = doc_of * (int(codes.max(initial=0)) + 1) + codes
        self.places = np.arange(len(codes))
        self.doc_of = doc_of

    def double(self) -> tuple[np.ndarray, np.ndarray]:
        """Names for grams twice as long; returns (place, lag to its next occurrence) pairs."""
        places = self.places[self.places + self.size < len(self.names)]
        second = places + self.size
        together = (self.names[second] >= 0) & (self.doc_of[places] == self.doc_of[second])
        places, second = places[together], second[together]
        low = self.names[second]
        key = self.names[places] * (int(low.max(initial=0)) + 1) + low if self.size > 1 else self._pair_keys(places, second)
        self.names[self.places] = -1
        self.size *= 2
        if not len(places):
            self.places = places
            return places, places
        order = np.argsort(key, kind="stable")
        places, key = places[order], key[order]
        same = key[1:] == key[:-1]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        names = np.cumsum(np.concatenate([[0], ~same]))
        self.names[places[twice]] = names[twice]
        self.places = np.sort(places[twice])
        return places[:-1][same], (places[1:] - places[:-1])[same]

    def _pair_keys(self, places: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The first doubling: names are (document, word), of which the second needs the word alone."""
        width = int(self.names.max(initial=0)) + 1
        if width < 3_000_000_000:
            return self.names[places] * width + self.names[second]
        _, dense = np.unique(self.names, return_inverse=True)  # more than 3e9 names: number them densely
        return dense[places] * (int(dense.max()) + 1) + dense[second]


def matched(codes: np.ndarray, at: int, lag: int, end: int) -> int:
    """The first place from ``at`` on whose word differs from the one ``lag`` further, or end - lag."""
    step = 64
    while at < end - lag:
        to = min(at + step, end - lag)
        differs = codes[at:to] != codes[at + lag : to + lag]
        if differs.any():
            return at + int(differs.argmax())
        at, step = to, step * 2
    return at


def matched_back(codes: np.ndarray, at: int, lag: int, begin: int) -> int:
    """The first place of the stretch of matches that ends before ``at``."""
    step = 64
    while at > begin:
        to = max(at - step, begin)
        differs = codes[to:at] != codes[to + lag : at + lag]
        if differs.any():
            return at - int(differs[::-1].argmax())
        at, step = to, step * 2
    return at


def runs_of(codes: np.ndarray, bounds: np.ndarray, min_length: int = 24, min_exponent: int = 3) -> list[tuple[int, int, int, int]]:
    """(document, start within it, period, length) of every maximal run, in order.

    ``bounds`` are the first words of the documents and the end; ``codes`` are equal where words are.
    """
    if min_exponent < 3:
        raise ValueError("neighbouring occurrences suffice from three periods on")
    doc_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    index = GramIndex(codes.astype(np.int64), doc_of)
    seed = 1
    while seed * 2 <= least_overlap(min_length, min_exponent):
        seed *= 2
    found = []
    longest = int(np.diff(bounds).max(initial=0))
    while len(index.places) and index.size * 2 <= max(seed, 2 * longest // min_exponent):
        places, lags = index.double()
        if index.size < seed:
            continue
        wanted = (lags <= index.size) & ((lags > index.size // 2) | (index.size == seed))
        places, lags = places[wanted], lags[wanted]
        order = np.lexsort((places, lags))
        places, lags = places[order], lags[order]
        # A seed right behind another of its lag lies on the same stretch.
        head = np.ones(len(places), bool)
        head[1:] = (places[1:] != places[:-1] + 1) | (lags[1:] != lags[:-1])
        covered: dict[int, int] = {}
        for place, lag in zip(places[head].tolist(), lags[head].tolist(), strict=True):
            if place < covered.get(lag, -1):
                continue
            document = int(doc_of[place])
            begin, end = int(bounds[document]), int(bounds[document + 1])
            to = matched(codes, place + index.size, lag, end)
            covered[lag] = to
            start = matched_back(codes, place, lag, begin)
            length = to - start + lag
            if length >= max(min_length, min_exponent * lag):
                found.append((document, start - begin, lag, length))
    return sorted(found)


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 24, min_exponent: int = 3
) -> DataFrame:
    """``<id>, n_words, runs, collapsed`` of every row.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. ``runs`` lists (start, period, length) of every
    maximal stretch whose smallest period fits at least ``min_exponent`` (3 or more) times and that
    has ``min_length`` words, by start, then period; runs may overlap. ``collapsed`` joins by one
    space the words that no run contains after its first period. A null or blank text has no words,
    no runs and an empty ``collapsed``. Null and repeated ids are kept row by row; no rows give no
    rows; extra columns are not read. Every row is worked on alone, in batches of about 4 MB of
    whole texts, in time that grows as words times the logarithm of the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            words, bounds = words_of(batch.column(1))
            codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            found = runs_of(codes, bounds, min_length, min_exponent)
            edges = np.zeros(len(codes) + 1, np.int64)
            for document, start, period, length in found:
                edges[bounds[document] + start + period] += 1
                edges[bounds[document] + start + length] -= 1
            kept = np.cumsum(edges[:-1]) == 0
            kept_bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
            lists = pa.ListArray.from_arrays(pa.array(kept_bounds, pa.int32()), words.filter(pa.array(kept)))
            counts = np.bincount([f[0] for f in found], minlength=batch.num_rows) if found else np.zeros(batch.num_rows, np.int64)
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in (1, 2, 3)]
            runs = pa.StructArray.from_arrays(columns, names=["start", "period", "length"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.diff(bounds), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), runs),
                    pc.binary_join(lists, " "),
                ],
                names=["_id", "n_words", "runs", "collapsed"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return keyed_text(docs, id_col, text_col).mapInArrow(run, f"_id {kind}, {SCHEMA}").withColumnRenamed("_id", id_col)
