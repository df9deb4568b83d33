"""Interval labels of trees, and joins of points with ranges on equal keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators.windows import running_total
from tarn.session import cut_lineage, tasks_for

#: Bits of a step between block sizes: a range is at most 2 * 63 blocks of each size, and 4,096 of the largest.
STEP = 6


def _blocks(low: Column, high: Column, level: int, top: int) -> Column:
    """Numbers of the blocks of 64^level points that lie in [low, high) and in no larger such block."""

    def whole(of: int) -> tuple[Column, Column]:
        size = F.lit(1 << STEP * of)
        return F.ceil(low / size).cast("bigint") if of else low, F.floor(high / size).cast("bigint") if of else high

    def listed(first: Column, end: Column) -> Column:
        return F.when(first < end, F.sequence(first, end - 1)).otherwise(F.array().cast("array<bigint>"))

    first, end = whole(level)
    if level == top:
        return listed(first, end)
    above, above_end = whole(level + 1)
    inner, inner_end = above * (1 << STEP), above_end * (1 << STEP)
    return F.when(above < above_end, F.concat(listed(first, inner), listed(inner_end, end))).otherwise(listed(first, end))


def points_in_ranges(
    points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, most: int, dense: bool = False
) -> DataFrame:
    """Rows of ``points`` joined with the ``ranges`` [low, high) that hold them; all values in [0, most).

    A range becomes the few blocks of 64^k points it consists of, a point one row for each block
    size, and blocks are equal keys: no range is compared with points outside it. The largest
    blocks hold a 64th of the numbers at most, so the rows of one key stay few. ``dense``
    says that most numbers are points: rows are then dealt to as many tasks as the numbers need. Each
    pair comes once. Values stay below 2^50, where their quotients are exact.
    """
    if most >= 1 << 50:
        raise ValueError("numbers must stay below 2^50")
    top = max(0, -(-max(1, most - 1).bit_length() // STEP) - 2)
    lows, highs = F.col(low).cast("bigint"), F.col(high).cast("bigint")

    def of_level(level: int) -> Column:
        return F.transform(_blocks(lows, highs, level, top), lambda b: F.struct(F.lit(level).alias("level"), b.alias("block")))

    parts = [of_level(level) for level in range(top + 1)]
    blocks = ranges.withColumn("_block", F.explode(F.concat(*parts)))
    levels = F.array(*[
        F.struct(F.lit(level).alias("level"), F.shiftright(F.col(point).cast("bigint"), STEP * level).alias("block"))
        for level in range(top + 1)
    ])
    placed = points.withColumn("_block", F.explode(levels))
    if dense:
        tasks = tasks_for(most * (top + 1))
        placed, blocks = placed.repartition(tasks, "_block"), blocks.repartition(tasks, "_block")
    return placed.join(blocks, "_block").drop("_block")


def tree_intervals(parents: DataFrame) -> DataFrame:
    """``node, parent, low, high`` of a forest given as ``node, parent`` (NULL above a root).

    ``low`` numbers the nodes from 0 so that a node's descendants and itself are [low, high). The
    forest must have no cycles and one row per node; every parent has a row. Levels are walked
    twice, up for sizes and down for numbers: two joins for each level. Children of one parent get
    their places by a distributed running total, so a parent of any number of children is no task
    of its own.
    """
    rows = cut_lineage(parents.select("node", "parent"))
    levels = [cut_lineage(rows.where("parent IS NULL").select("node"))]
    while True:
        above = levels[-1].select(F.col("node").alias("parent"))
        below = cut_lineage(rows.join(above, "parent", "left_semi").select("node"))
        if below.isEmpty():
            break
        levels.append(below)
    sizes, carried = [], None
    for level in reversed(levels):
        sized = level.join(rows, "node")
        if carried is None:
            sized = sized.withColumn("size", F.lit(1).cast("bigint"))
        else:
            sums = carried.groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("_below"))
            sized = sized.join(sums, "node", "left").withColumn("size", F.coalesce("_below", F.lit(0)) + 1).drop("_below")
        carried = cut_lineage(sized.select("node", "parent", "size"))
        sizes.append(carried)
    every = reduce(DataFrame.unionByName, sizes)
    placed = cut_lineage(running_total(every, "size", [F.col("node")], ["parent"], "ahead"))
    numbered, found = None, []
    for level in levels:
        here = placed.join(level, "node", "left_semi")
        if numbered is None:
            here = here.withColumn("low", F.col("ahead").cast("bigint"))
        else:
            starts = numbered.select(F.col("node").alias("parent"), F.col("low").alias("_start"))
            here = here.join(starts, "parent").withColumn("low", (F.col("_start") + 1 + F.col("ahead")).cast("bigint"))
        numbered = cut_lineage(here.select("node", "parent", "low", (F.col("low") + F.col("size")).alias("high")))
        found.append(numbered)
    return reduce(DataFrame.unionByName, found)
