"""Running totals and ranks that do not need a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.session import cut_lineage


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys, NULL being equal to NULL; the right side's keys are dropped."""
    renamed = right.select(
        *[F.col(c).alias(f"_k_{c}") for c in keys], *[c for c in right.columns if c not in keys]
    )
    same = reduce(Column.__and__, [left[c].eqNullSafe(renamed[f"_k_{c}"]) for c in keys])
    return left.join(renamed, same, how).drop(*[f"_k_{c}" for c in keys])


def running_total(
    df: DataFrame,
    value: str,
    order: Sequence[Column],
    by: Sequence[str] = (),
    name: str = "running",
    partitions: int | None = None,
) -> DataFrame:
    """Sum of ``value`` over the rows before this one, per group, in a *total* order.

    Rows are range-partitioned by (group, order), so a group of any size spreads over
    many tasks; each task sums its own slice, and the slice totals (one row per slice)
    give the offsets. A NULL group is a group like any other. Integer and decimal values
    add up exactly.
    """
    by = list(by)
    spread = [*[F.col(c).asc() for c in by], *order]
    ranged = (
        df.repartitionByRange(partitions, *spread) if partitions else df.repartitionByRange(*spread)
    )
    # The slice number must not change between its two uses, hence the written table.
    sliced = cut_lineage(ranged.withColumn("_slice", F.spark_partition_id()))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*by, "_slice").agg(F.sum(value).alias("_total"))
    offsets = totals.select(
        *by,
        "_slice",
        F.sum("_total")
        .over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
        .alias("_offset"),
    )
    local = before.partitionBy(*by, "_slice").orderBy(*order)
    summed = sliced.withColumn("_local", F.sum(value).over(local))
    zero = F.lit(0)
    return (
        _joined(summed, offsets, [*by, "_slice"], "inner")
        .withColumn(name, F.coalesce("_local", zero) + F.coalesce("_offset", zero))
        .drop("_slice", "_local", "_offset")
    )


#: Ranges that values are cut into, and the rows that one more of them stands for.
RANGES, RANGE_ROWS = 256, 100_000
#: Share of the rows that the ranges are taken from, and salts of rows that are ties.
SAMPLED, SALTS = 0.05, 64
#: Types whose quantiles Spark estimates.
_MEASURED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def value_bounds(df: DataFrame, value: str, ranges: int | None = None) -> tuple[list, list]:
    """Ascending values that cut ``value`` into ranges of about as many rows, and those of them that are
    a range by themselves; one aggregate over a sample, one row.

    Without ``ranges`` there is one for each 100,000 rows, 256 at most. They only balance the work:
    any bounds give the same ranks. A value that fills two cuts or more is frequent.
    """
    steps = (ranges or RANGES) - 1
    wanted = [(i + 1) / (steps + 1) for i in range(steps)]
    if not wanted:
        return [], []
    part = 1.0 if ranges else SAMPLED
    found = df.select(value).sample(part, 7).agg(F.count(value).alias("n"), F.percentile_approx(value, wanted, 1_000).alias("cuts")).first()
    rows = found["n"] / part
    cuts = [c for c in found["cuts"] or [] if c == c]
    frequent = sorted({a for a, b in zip(cuts, cuts[1:], strict=False) if a == b}) if rows > RANGE_ROWS or ranges else []
    if ranges is None:
        every = max(1, round(RANGES * RANGE_ROWS / max(1.0, rows)))
        cuts = cuts[every - 1 :: every]
    return sorted({*cuts, *frequent}), frequent


def range_of(df: DataFrame, value: str, bounds: Sequence, frequent: Sequence = ()) -> Column:
    """Ranges from the largest values (0) down; a frequent value has an odd one, NULLs the last."""
    kind, alone = df.schema[value].dataType, set(frequent)
    cuts = [F.lit(b).cast(kind) for b in bounds]

    def found(v: Column, low: int, high: int) -> Column:
        """Binary search for the number of bounds up to the value, as nested conditions."""
        if low < high:
            middle = (low + high) // 2
            return F.when(v < cuts[middle], found(v, low, middle)).otherwise(found(v, middle + 1, high))
        here = 2 * (len(bounds) - low)
        if low and bounds[low - 1] in alone:
            return F.when(v == cuts[low - 1], here + 1).otherwise(here)
        return F.lit(here)

    # The lambda binds the value once, however it is computed.
    searched = F.transform(F.array(F.col(value)), lambda v: found(v, 0, len(bounds)))[0]
    return F.when(F.col(value).isNull(), 2 * len(bounds) + 1).otherwise(searched)


def rank_in_group(df: DataFrame, by: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """SQL ``rank() OVER (PARTITION BY by ORDER BY value DESC)``, NULL values last.

    Values are cut into ranges by quantiles. A rank is the number of rows in the ranges above (one
    sum for each group and range) and the rank within (group, range), so rows are shuffled once and
    no task holds a group. Rows of a frequent value, and NULLs, are ties: the sum alone tells their
    rank, so salts spread them. Values without quantiles (text) take a distributed running total instead.
    """
    by = list(by)
    if not isinstance(df.schema[value].dataType, _MEASURED):
        counted = df.groupBy(*by, value).agg(F.count("*").alias("_rows"))
        ahead = running_total(counted, "_rows", [F.col(value).desc_nulls_last()], by, "_ahead")
        ranks = ahead.select(*by, value, (F.col("_ahead") + 1).cast("bigint").alias(name))
        return _joined(df, ranks, [*by, value], "left").select(*df.columns, name)
    bounds, frequent = value_bounds(df, value)
    ordered = F.col(value).desc_nulls_last()
    if not bounds:
        return df.withColumn(name, F.rank().over(Window.partitionBy(*by).orderBy(ordered)).cast("bigint"))
    # Fields of a struct are equal where both are NULL, so one key serves window and join.
    df = df.withColumn("_range", range_of(df, value, bounds, frequent))
    place, columns = F.col("_range"), [c for c in df.columns if c != "_range"]
    salt = F.when(place % 2 == 1, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0)
    group = [F.col(c).alias(f"g{i}") for i, c in enumerate(by)]
    totals = df.groupBy(F.struct(*group, place.alias("range")).alias("_in")).agg(F.count("*").alias("_total"))
    before = Window.partitionBy(*[F.col(f"_in.g{i}") for i in range(len(by))]).orderBy("_in.range").rowsBetween(Window.unboundedPreceding, -1)
    salts = F.sequence(F.lit(0), F.when(F.col("_in.range") % 2 == 1, SALTS - 1).otherwise(0))
    above = totals.select("_in", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_above"))
    salted = above.select("_above", "_in", F.explode(salts).alias("_salt"))
    above = salted.select("_above", F.struct("_in.*", F.col("_salt").alias("salt")).alias("_at"))
    placed = df.withColumn("_at", F.struct(*group, place.alias("range"), salt.alias("salt")))
    inside = F.rank().over(Window.partitionBy("_at").orderBy(ordered))
    rank = (F.col("_above") + F.col("_inside")).cast("bigint")
    return placed.withColumn("_inside", inside).join(above, "_at").withColumn(name, rank).select(*columns, name)
