"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

#: The white space of every contract: space, tab, line feed, vertical tab, form feed, return.
WHITE = " \t\n\x0b\x0c\r"


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just ``_id, _text`` of the documents; a null text is empty, other columns stay behind."""
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def without_white_space(text: Column) -> Column:
    """``text`` less every white-space character; plain byte searches, no regular expression."""
    for character in WHITE:
        text = F.replace(text, F.lit(character))
    return text


def crc32_of_id(id_col: str) -> Column:
    """CRC-32 of the id written as decimal text; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def text_batches(batches: Iterator[pa.RecordBatch], most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to about ``most_bytes`` each, so that one batch never holds many long texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def most_frequent(counts: DataFrame, most: int) -> list[Row]:
    """(``_word, _n``) of the words at least as frequent as a cut-off that at most ``most`` reach, rarest first.

    ``counts`` is a written table of ``_word, _n``. The cut-off comes from a histogram of eight
    steps per doubling, some 500 rows at any size, so no task sends the driver a list of its own.
    """
    step = F.floor(F.log2("_n") * 8)
    histogram = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()
    total, cut = 0, None
    for row in sorted(histogram, reverse=True):
        total += row["words"]
        if total > most:
            break
        cut = row["step"]
    if cut is None:
        return []
    rows = counts.where(step >= cut).select("_word", "_n").collect()
    return sorted(rows, key=lambda r: (r["_n"], r["_word"]))


def repeats_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether some rows share an id; null is one more id."""
    return not docs.groupBy(F.col(id_col).alias("_kept_id")).agg(F.count("*").alias("_rows")).where("_rows > 1").isEmpty()


def rows_of(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str, digest_col: str, white_space: bool = False) -> DataFrame:
    """The rows of ``docs`` that ``kept`` names by id, null ids included, and text.

    Where rows repeat an id, ``digest_col`` of ``kept`` (a SHA-256 of the text, without its white
    space unless ``white_space``) tells which texts are meant; of rows equal in both the first
    in order stays. Ids are looked at first: only if some repeat do texts take part in a window.
    """
    if not repeats_ids(docs, id_col):
        wanted = kept.select(F.col(id_col).alias("_kept_id")).distinct()
        return docs.join(wanted, docs[id_col].eqNullSafe(wanted["_kept_id"]), "left_semi")
    text = F.coalesce(docs[text_col], F.lit(""))
    digest = F.sha2(text if white_space else without_white_space(text), 256)
    wanted = kept.select(F.col(id_col).alias("_kept_id"), F.col(digest_col).alias("_kept_digest")).distinct()
    same = docs[id_col].eqNullSafe(F.col("_kept_id")) & (digest == F.col("_kept_digest"))
    found = docs.join(wanted, same, "left_semi")
    place = F.row_number().over(Window.partitionBy(docs[id_col], digest).orderBy(F.length(text).desc(), text))
    return found.withColumn("_place_of_id", place).where("_place_of_id = 1").drop("_place_of_id")
