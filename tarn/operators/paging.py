"""Deep pages and large samples by counted ranges: nothing before a page is sorted or held.

The first order column is cut into ranges by quantiles and the rows of each are counted exactly.
Ranges wholly inside the page are taken as they are, the (two at most) that the page cuts are
counted again, finer, and only what is then at most ``edge`` rows is sorted. So a page a billion
rows down costs some counts and one small sort, and a sample of a billion rows stays distributed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators.merge import require_columns
from tarn.operators.windows import _MEASURED, range_of, value_bounds

#: Rows that one task sorts at most where the order's columns can tell rows apart.
EDGE = 100_000
#: Ranges of a count.
CUTS = 256


def _sorted_by(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]


def _range(df: DataFrame, column: str, down: bool) -> tuple[Column, bool]:
    """Ranges of a column in the order asked for, NULLs last; and whether there is more than one."""
    bounds, frequent = value_bounds(df, column, CUTS)
    place = range_of(df, column, bounds, frequent)
    if not down:
        place = F.when(F.col(column).isNull(), 2 * len(bounds) + 1).otherwise(2 * len(bounds) - place)
    return place.cast("int"), bool(bounds)


def _cut(df: DataFrame, order: list[tuple[str, bool]], every: list[tuple[str, bool]], total: int, start: int, end: int, edge: int) -> list[DataFrame]:
    """Rows at places [start, end) of ``total`` rows; ``order`` has the columns that may still part them."""
    start, end = max(0, start), min(end, total)
    if start >= end:
        return []
    if start == 0 and end == total:
        return [df]
    if total <= edge or not order or not isinstance(df.schema[order[0][0]].dataType, _MEASURED):
        return [df.orderBy(*_sorted_by(every)).offset(start).limit(end - start)]
    place, parted = _range(df, *order[0])
    counts = sorted((r["r"], r["n"]) for r in df.groupBy(place.alias("r")).agg(F.count("*").alias("n")).collect())
    if not parted or len(counts) == 1:
        # Rows that this column does not part: the next one decides.
        return _cut(df, order[1:], every, total, start, end, edge)
    inside, found, before = [], [], 0
    for r, n in counts:
        low, high = max(start - before, 0), min(end - before, n)
        if low == 0 and high == n:
            inside.append(r)
        elif low < high:
            found += _cut(df.where(place == r), order, every, n, low, high, edge)
        before += n
    return [df.where(place.isin(inside)), *found] if inside else found


def rows_between(df: DataFrame, order: Sequence[str | tuple[str, bool]], start: int, end: int, edge: int = EDGE) -> DataFrame:
    """Rows at places [start, end) of ``df`` in an order, as a distributed set (not itself sorted).

    ``order`` lists columns, or (column, descending) pairs, NULLs last, and should be total: of rows
    equal in all of them any may be cut. Numbers, dates and times are counted in ranges; where a
    text column has to decide among more than ``edge`` rows, those rows are sorted by Spark.
    """
    columns = [(c, False) if isinstance(c, str) else tuple(c) for c in order]
    require_columns(df, [c for c, _ in columns], "order column")
    parts = _cut(df, columns, columns, df.count(), start, end, edge)
    return reduce(DataFrame.unionByName, parts) if parts else df.limit(0)


def deep_page(df: DataFrame, order: Sequence[str | tuple[str, bool]], page: int, size: int, edge: int = EDGE) -> DataFrame:
    """Page ``page`` (from 1) of ``size`` rows, sorted."""
    if page < 1 or size < 1:
        raise ValueError("pages and sizes begin at 1")
    columns = [(c, False) if isinstance(c, str) else tuple(c) for c in order]
    return rows_between(df, order, (page - 1) * size, page * size, edge).orderBy(*_sorted_by(columns))
