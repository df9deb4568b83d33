"""Exact deduplication in three combining stages, all of them plain aggregates.

1. Each map task combines its own copies (the partial aggregate before the shuffle).
2. Groups of (salt, digest, content) combine what the map tasks found; the salt is the number
   of the map task modulo ``salts``, so a text that a third of all rows hold is spread.
3. The salt winners, at most ``salts`` per text, meet by digest.

The content is a grouping key next to its digest in each stage, so texts are equal only if all
of their characters are, and a digest collision cannot merge two texts.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import keyed_text, rows_of, without_white_space
from tarn.session import cut_lineage

#: Above every signed 64-bit id, so that length and id fit one decimal.
SHIFT = Decimal(10**20)
TOP_ID = Decimal(2**63 - 1)


def _preference(length: Column, key: Column) -> Column:
    """A decimal that is larger for longer texts and, among these, for smaller ids; null ids come last.

    One decimal stays within Spark's hash aggregate, where a struct would force a sort of the texts.
    """
    behind = F.lit(TOP_ID).cast("decimal(20,0)") - key.cast("decimal(20,0)") + F.lit(1).cast("decimal(1,0)")
    rank = F.coalesce(behind, F.lit(0).cast("decimal(20,0)")).cast("decimal(21,0)")
    return (length.cast("decimal(10,0)") * F.lit(SHIFT).cast("decimal(21,0)") + rank).cast("decimal(38,0)")


def _id_of(preference: Column) -> Column:
    rank = (preference % F.lit(SHIFT).cast("decimal(21,0)")).cast("decimal(21,0)")
    key = F.lit(TOP_ID).cast("decimal(20,0)") - rank + F.lit(1).cast("decimal(1,0)")
    return F.when(rank > 0, key.cast("bigint"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """Each row's group of equal texts: ``<id>, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical without white space; a null text counts as empty,
    so null, empty and blank texts are one group. The longest original stays, then the least
    id; a null id stays only where no other is. Rows that repeat an id count in ``group_size``,
    each has a row in the result and all rows of the kept id are ``kept``. No rows give no
    rows. Extra columns are not read, whatever their names. Ids are integers.
    """
    if salts < 1:
        raise ValueError("salts must be positive")
    texts = keyed_text(docs, id_col, text_col).withColumn("_norm", without_white_space(F.col("_text")))
    digested = texts.select(
        F.col("_id").cast("bigint").alias("_id"), F.length("_text").alias("_length"), "_norm",
        F.unhex(F.sha2(F.col("_norm"), 256)).alias("_digest"),
    )
    salted = (
        digested.withColumn("_salt", F.spark_partition_id() % F.lit(salts))
        .groupBy("_salt", "_digest", "_norm")
        .agg(F.max(_preference(F.col("_length"), F.col("_id"))).alias("_best"), F.count("*").alias("_size"))
    )
    winners = salted.select("_digest", "_norm", "_best", "_size").repartition("_digest")
    groups = winners.groupBy("_digest", "_norm").agg(F.max("_best").alias("_best"), F.sum("_size").alias("_size"))
    # Texts are done with here, unless one digest stands for several of them.
    found = cut_lineage(
        groups.groupBy("_digest").agg(
            F.count("*").alias("_texts"), F.max("_best").alias("_best"), F.max("_size").alias("_size")
        )
    )
    rows = digested.select("_id", "_digest")
    alone = rows.join(found.where("_texts = 1").drop("_texts"), "_digest")
    clashes = found.where("_texts > 1").select("_digest")
    if not clashes.isEmpty():
        apart = groups.join(clashes, "_digest", "left_semi")
        alone = alone.unionByName(
            digested.join(apart, ["_digest", "_norm"]).select("_digest", "_id", "_best", "_size")
        )
    keep = _id_of(F.col("_best"))
    return alone.select(
        F.col("_id").alias(id_col), keep.alias("keep_id"), F.col("_size").cast("bigint").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, in its own columns: one of each group of equal texts."""
    groups = cut_lineage(exact_groups(docs, id_col, text_col, salts).where("kept"))
    return rows_of(docs, groups, id_col, text_col, "text_sha256")
