"""Access stamps of bounded size: bits over principal numbers, 64 to a row.

An object's grants are rows of ``word`` (principal number / 64) with one ``allow`` and one ``deny``
bitmap each. No cell grows: an object that a billion principals may see has 16 million small rows,
one with three grants has three at most. Bits are gathered by ``bit_or``, which map tasks combine
first, and compared by ``&`` and ``~`` inside generated code; Spark's own bitmap aggregates hold
4,096 bytes even for one bit and offer no difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators.windows import running_total

WORD = 64


def number_principals(principals: DataFrame, id_col: str = "id") -> DataFrame:
    """``principal_id, number``: dense numbers from 0 in the order of ids; the same for the same ids."""
    ids = principals.select(F.col(id_col).alias("principal_id")).where("principal_id IS NOT NULL").distinct()
    placed = running_total(ids.withColumn("_one", F.lit(1)), "_one", [F.col("principal_id")], name="number")
    return placed.select("principal_id", F.col("number").cast("bigint").alias("number"))


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(number, F.lit(WORD)).cast("int"))


def bitmap_stamps(acl: DataFrame, numbers: DataFrame) -> DataFrame:
    """``source_object_id, word, allow, deny`` of the grants of numbered principals."""
    deny = F.col("effect") == "deny"
    none = F.lit(0).cast("bigint")
    placed = acl.join(numbers, "principal_id").select(
        "source_object_id", F.floor(F.col("number") / WORD).cast("bigint").alias("word"), _bit(F.col("number")).alias("_bit"), deny.alias("_deny")
    )
    return placed.groupBy("source_object_id", "word").agg(
        F.bit_or(F.when(~F.col("_deny"), F.col("_bit")).otherwise(none)).alias("allow"),
        F.bit_or(F.when(F.col("_deny"), F.col("_bit")).otherwise(none)).alias("deny"),
    )


def merged_stamps(stamps: DataFrame, added: DataFrame) -> DataFrame:
    """Stamps with those of further grants; only bits are joined, whatever the objects hold."""
    both = stamps.unionByName(added)
    return both.groupBy("source_object_id", "word").agg(F.bit_or("allow").alias("allow"), F.bit_or("deny").alias("deny"))


def effective(stamps: DataFrame) -> DataFrame:
    """Stamps with ``granted``: principals that are allowed and not denied."""
    return stamps.withColumn("granted", F.col("allow").bitwiseAND(F.bitwise_not("deny")))


def stamp_counts(stamps: DataFrame) -> DataFrame:
    """``source_object_id, n_allow, n_deny, n_granted``, summed over the rows of an object."""
    counted = effective(stamps)
    return counted.groupBy("source_object_id").agg(*[
        F.sum(F.bit_count(c)).cast("bigint").alias(f"n_{c}") for c in ("allow", "deny", "granted")
    ])


def visible_by_bitmaps(
    df: DataFrame, object_col: str, stamps: DataFrame, requester: DataFrame, numbers: DataFrame, default: str = "private"
) -> DataFrame:
    """Rows a requester's principals may see: one of them allowed, none denied.

    ``requester`` lists ``principal_id`` values; they become as many (word, mask) rows as they
    touch words. Rows without any grant are hidden unless ``default="public"``.
    """
    masks = requester.join(numbers, "principal_id").groupBy(F.floor(F.col("number") / WORD).cast("bigint").alias("word")).agg(
        F.bit_or(_bit(F.col("number"))).alias("_mask")
    )
    mine = stamps.join(masks, "word").groupBy("source_object_id").agg(
        F.bit_or(F.col("allow").bitwiseAND(F.col("_mask"))).alias("_allowed"), F.bit_or(F.col("deny").bitwiseAND(F.col("_mask"))).alias("_denied")
    )
    seen = mine.where("_allowed <> 0 AND _denied = 0").select(F.col("source_object_id").alias(object_col))
    found = df.join(seen, object_col, "left_semi")
    if default == "public":
        granted = stamps.select(F.col("source_object_id").alias(object_col)).distinct()
        found = found.unionByName(df.join(granted, object_col, "left_anti"))
    return found
