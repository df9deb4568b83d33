"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A language's profile is the order of its most frequent character n-grams; a document's own
order is compared with each by out-of-place distance. Spark counts the n-grams per language
over all training texts; the profiles (``top`` rows per language) go to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import text_batches

SPACE = 0x20
#: Profile rows that may be sent to the tasks (24 bytes each).
MOST_ROWS = 3_000_000
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point whether it is a letter; built once per worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one to three characters of a text and their counts.

    Letters are lower-cased, all else is one space between words; an n-gram may begin or end
    at a word's edge but not span two words. An n-gram is a number of 21 bits per character.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, SPACE)
    padded = np.concatenate(([SPACE], points, [SPACE])).astype(np.uint64)
    gap = padded == SPACE
    padded = padded[~(gap & np.concatenate(([False], gap[:-1])))]
    if len(padded) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    gap = padded == SPACE
    one = padded[~gap]
    two = padded[:-1] | padded[1:] << np.uint64(21)
    three = (two[:-1] | padded[2:] << np.uint64(42))[~gap[1:-1]]
    return np.unique(np.concatenate((one, two, three)), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent n-grams in order; ties by n-gram."""
    if len(grams) > top:
        floor = np.partition(counts, len(counts) - top)[len(counts) - top]
        kept = counts >= floor
        grams, counts = grams[kept], counts[kept]
    return grams[np.lexsort((grams, -counts))][:top]


def profile_counts(labelled: DataFrame) -> DataFrame:
    """``_lang, _gram, _n`` over all texts of ``_lang, _text``; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}

        def add_up(lang: str) -> None:
            grams, at = np.unique(np.concatenate([g for g, _ in sums[lang]]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([n for _, n in sums[lang]])).astype(np.int64)
            sums[lang] = [(grams, counts)]

        for batch in text_batches(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = sums.setdefault(lang, [])
                held.append(ngrams(text))
                if len(held) >= 512:
                    add_up(lang)
        for lang in sums:
            add_up(lang)
            grams, counts = sums[lang][0]
            for at in range(0, len(grams), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams[part]), pa.string()), pa.array(grams[part].view(np.int64)),
                     pa.array(counts[part])],
                    names=["_lang", "_gram", "_n"],
                )

    counted = labelled.select("_lang", "_text").mapInArrow(run, "_lang string, _gram bigint, _n bigint")
    return counted.groupBy("_lang", "_gram").agg(F.sum("_n").alias("_n"))


def learn_profiles(
    docs: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang", top: int = 300
) -> list[tuple[str, int, int]]:
    """(language, n-gram, rank) of the ``top`` n-grams of each language.

    Learns from the text and language of the rows where ``training`` holds and both are
    present. The result has at most ``top`` rows per language; beyond ``MOST_ROWS`` rows the
    language column does not hold languages, and that is an error.
    """
    labelled = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")
    )
    order = Window.partitionBy("_lang").orderBy(F.desc("_n"), "_gram")
    best = profile_counts(labelled).withColumn("_rank", F.row_number().over(order) - 1).where(F.col("_rank") < top)
    rows = best.select("_lang", "_gram", "_rank").limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS // top} languages")
    return sorted((r["_lang"], r["_gram"] % 2**64, r["_rank"]) for r in rows)


class Profiles:
    """Ranks of all profile n-grams by language, and the distance of a text to each."""

    def __init__(self, rows: list[tuple[str, int, int]], top: int):
        self.top = top
        self.langs = sorted({lang for lang, _, _ in rows})
        self.grams = np.unique(np.array([g for _, g, _ in rows], np.uint64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        place = {lang: i for i, lang in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, np.uint64(gram)), place[lang]] = rank

    def identify(self, text: str | None) -> tuple[str, float]:
        """The nearest language (ties: least name) and one minus its distance over the largest possible."""
        own = ranked(*ngrams(text), self.top) if text else ()
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        ranks = self.ranks[np.where(self.grams[at] == own, at, len(self.grams))]
        places = np.arange(len(own))[:, None]
        distance = np.where(ranks < 0, self.top, np.minimum(abs(ranks - places), self.top)).sum(axis=0)
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / (self.top * len(own)))


def identify_languages(
    docs: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    top: int = 300,
) -> DataFrame:
    """``<id>, lang_pred, score`` of every row.

    Only the text decides: the language column, source and id are no inputs of a prediction.
    ``und`` and score 0 where the text is null or has no letter, or where nothing was learned.
    Ties go to the language first by name. Rows that repeat an id each give a row; extra
    columns are not read.
    """
    rows = learn_profiles(docs, training, text_col, lang_col, top)
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(sent.value, top)
        for batch in text_batches(batches):
            found = [profiles.identify(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["_id", "_lang", "_score"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return texts.mapInArrow(run, f"_id {kind}, _lang string, _score double").select(
        F.col("_id").alias(id_col), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score")
    )


def with_known_language(
    docs: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang", top: int = 300
) -> DataFrame:
    """The rows of ``docs``, in its own columns, whose language can be told.

    A text that is null or has no letter is rejected, and nothing else. If no profile could be
    learned no language is known at all: then each text with a letter stays.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn_profiles(docs, training, text_col, lang_col, top))

    @F.pandas_udf("boolean")
    def known(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        profiles = Profiles(sent.value, top)
        for batch in texts:
            if profiles.langs:
                yield pd.Series([profiles.identify(text)[0] != "und" for text in batch], dtype=bool)
            else:
                yield pd.Series([bool(text) and len(ngrams(text)[0]) > 0 for text in batch], dtype=bool)

    return docs.where(known(F.col(text_col)))
