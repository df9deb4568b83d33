"""Merges, deletes, change feeds and diffs as plain DataFrame joins.

Nothing here collects keys: a delete or an upsert is an anti-join whose small side
Spark broadcasts only when its measured size allows, and otherwise shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.ids import row_fingerprint


def _orderable(field: T.StructField) -> bool:
    return not isinstance(field.dataType, (T.MapType, T.VariantType))


def _as_list(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def require_columns(df: DataFrame, cols: Sequence[str], role: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{role} not in table: {', '.join(missing)}")


def keep_latest(
    df: DataFrame, pk: str | Sequence[str], order: str | Sequence[str] | None = None
) -> DataFrame:
    """One row per key: the latest by ``order``; ties fall to the largest remaining columns.

    The ``row = 1`` filter makes Spark keep one row per key in every map task before
    the shuffle, so a hot key costs one row per task and not its whole group.
    """
    pk, order = _as_list(pk), _as_list(order or [])
    require_columns(df, [*pk, *order], "key or order column")
    rest = [f.name for f in df.schema if f.name not in {*pk, *order} and _orderable(f)]
    if not order and not rest:
        return df.dropDuplicates(pk)
    ranking = [F.col(c).desc_nulls_last() for c in [*order, *rest]]
    window = Window.partitionBy(*pk).orderBy(*ranking)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def without_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is not among ``keys`` (NULL keys match NULL keys)."""
    on = _as_list(on)
    marked = keys.select(*[F.col(c).alias(f"_key_{i}") for i, c in enumerate(on)])
    same = reduce(
        Column.__and__, [df[c].eqNullSafe(marked[f"_key_{i}"]) for i, c in enumerate(on)]
    )
    return df.join(marked, same, "left_anti")


def merge_by_key(
    target: DataFrame,
    source: DataFrame,
    pk: str | Sequence[str],
    order: str | Sequence[str] | None = None,
    unique: bool = True,
) -> DataFrame:
    """Delete-then-insert: whole rows of ``source`` replace those with the same key.

    With ``unique=False`` the key names a group (a day, a parent): every target row of
    an incoming group goes, and all incoming rows stay.
    """
    pk = _as_list(pk)
    require_columns(target, pk, "merge key")
    require_columns(source, pk, "merge key")
    incoming = keep_latest(source, pk, order) if unique else source
    return union_relaxed(without_keys(target, source, pk), incoming)


def _staged(source: DataFrame) -> DataFrame:
    return source.select(
        F.lit(True).alias("_in_source"), *[F.col(c).alias(f"_new_{c}") for c in source.columns]
    )


def _same_keys(left: DataFrame, staged: DataFrame, on: Sequence[str]) -> Column:
    return reduce(Column.__and__, [left[c].eqNullSafe(staged[f"_new_{c}"]) for c in on])


def _overlaid(joined: DataFrame, target: DataFrame, update: Sequence[str]) -> DataFrame:
    """Target columns, with the updated ones taken from the source where it matched."""
    hit = F.col("_in_source").isNotNull()
    return joined.select(
        *[
            F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in update else F.col(c)
            for c in target.columns
        ]
    )


def new_rows(target: DataFrame, source: DataFrame, on: Sequence[str]) -> DataFrame:
    """Source rows whose key the target lacks. Only the target's key columns are read, and
    only matching keys (never more than the source has) are shuffled on."""
    staged = _staged(source.select(*on))
    keys = target.select(*on)
    matched = keys.join(staged, _same_keys(keys, staged, on)).select(*on)
    return without_keys(source, matched, on)


def upsert_columns(
    target: DataFrame, source: DataFrame, on: str | Sequence[str], update: Sequence[str]
) -> DataFrame:
    """MERGE with a column list: matched rows take only ``update``, new rows are inserted.

    Of several source rows of one key the largest stays (``keep_latest``), so a target row
    is never multiplied. A source small enough to broadcast leaves the target where it is.
    """
    on = _as_list(on)
    require_columns(source, [*on, *update], "merge column")
    source = keep_latest(source, on)
    staged = _staged(source)
    joined = target.join(staged, _same_keys(target, staged, on), "left")
    fresh = conform(new_rows(target, source, on), target.schema)
    return _overlaid(joined, target, update).unionByName(fresh)


def upsert_delta(
    target: DataFrame, source: DataFrame, on: str | Sequence[str], update: Sequence[str]
) -> DataFrame:
    """Only the rows ``upsert_columns`` changes or inserts, whole."""
    on = _as_list(on)
    require_columns(source, [*on, *update], "merge column")
    source = keep_latest(source, on)
    staged = _staged(source)
    matched = target.join(staged, _same_keys(target, staged, on))
    fresh = conform(new_rows(target, source, on), target.schema)
    return _overlaid(matched, target, update).unionByName(fresh)


def delete_where_in(target: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is not in the key table."""
    return without_keys(target, keys.select(column), column)


def latest_changes(
    changes: DataFrame, pk: str | Sequence[str], seq: str | Sequence[str]
) -> DataFrame:
    """The last change of every key."""
    return keep_latest(changes, pk, seq)


def apply_changes(
    target: DataFrame,
    changes: DataFrame,
    pk: str | Sequence[str],
    seq: str | Sequence[str],
    op_col: str,
    delete_op: str = "delete",
) -> DataFrame:
    """Change feed onto a snapshot: the last change per key wins, deletes remove."""
    pk = _as_list(pk)
    last = latest_changes(changes, pk, seq)
    alive = last.where(~F.col(op_col).eqNullSafe(delete_op)).drop(op_col)
    extra = [c for c in _as_list(seq) if c not in target.columns]
    return union_relaxed(without_keys(target, changes, pk), alive.drop(*extra))


# --- schema drift -------------------------------------------------------------------

# Numeric types from narrow to wide.
NUMERIC_ORDER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def widest(left: T.DataType, right: T.DataType) -> T.DataType:
    """Type that holds both; text when they have nothing else in common."""
    if left == right or isinstance(right, T.NullType):
        return left
    if isinstance(left, T.NullType):
        return right
    if type(left) in NUMERIC_ORDER and type(right) in NUMERIC_ORDER:
        pair = {type(left), type(right)}
        if T.FloatType in pair and pair & {T.IntegerType, T.LongType}:
            return T.DoubleType()
        return max(left, right, key=lambda t: NUMERIC_ORDER.index(type(t)))
    if isinstance(left, T.DecimalType) and isinstance(right, T.DecimalType):
        scale = max(left.scale, right.scale)
        whole = max(left.precision - left.scale, right.precision - right.scale)
        return T.DecimalType(min(38, whole + scale), scale)
    dates = (T.DateType, T.TimestampNTZType, T.TimestampType)
    if type(left) in dates and type(right) in dates:
        return max(left, right, key=lambda t: dates.index(type(t)))
    decimal_pair = {type(left), type(right)}
    if T.DecimalType in decimal_pair and decimal_pair & set(NUMERIC_ORDER):
        return T.DoubleType()
    return T.StringType()


def common_schema(schemas: Sequence[T.StructType]) -> T.StructType:
    """Union of the columns by name, each with its widest type, in order of appearance."""
    merged: dict[str, T.DataType] = {}
    for schema in schemas:
        for field in schema:
            known = merged.get(field.name)
            merged[field.name] = field.dataType if known is None else widest(known, field.dataType)
    return T.StructType([T.StructField(n, t) for n, t in merged.items()])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: cast, or NULL where missing."""
    have = {f.name: f.dataType for f in df.schema}

    def column(field: T.StructField) -> Column:
        if field.name not in have:
            return F.lit(None).cast(field.dataType).alias(field.name)
        if have[field.name] == field.dataType:
            return F.col(field.name)
        return F.col(field.name).cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in schema])


def union_relaxed(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name that tolerates missing columns and differing types."""
    schema = common_schema([f.schema for f in frames])
    return reduce(DataFrame.unionByName, [conform(f, schema) for f in frames])


def union_sources(**frames: DataFrame) -> DataFrame:
    """One table out of one table per connector, with a ``source`` column."""
    return union_relaxed(*[f.withColumn("source", F.lit(n)) for n, f in frames.items()])


# --- comparison ---------------------------------------------------------------------


def table_diff(
    left: DataFrame,
    right: DataFrame,
    pk: str | Sequence[str],
    compare: Sequence[str] | None = None,
) -> DataFrame:
    """Keys whose rows differ: ``only_left``, ``only_right`` or ``changed``.

    Only keys and a 64-bit row hash travel through the shuffle, not the rows.
    """
    pk = _as_list(pk)
    cols = list(compare or [c for c in left.columns if c in right.columns and c not in pk])

    def hashed(df: DataFrame, side: str) -> DataFrame:
        keys = [F.col(c).alias(f"_{side}_{c}") for c in pk]
        return df.select(
            *keys, row_fingerprint(cols or pk).alias(f"_{side}_hash"), F.lit(True).alias(f"_{side}")
        )

    a, b = hashed(left, "l"), hashed(right, "r")
    same = reduce(Column.__and__, [a[f"_l_{c}"].eqNullSafe(b[f"_r_{c}"]) for c in pk])
    status = (
        F.when(F.col("_r").isNull(), "only_left")
        .when(F.col("_l").isNull(), "only_right")
        .when(F.col("_l_hash") != F.col("_r_hash"), "changed")
    )
    keys = [F.coalesce(f"_l_{c}", f"_r_{c}").alias(c) for c in pk]
    return a.join(b, same, "full_outer").select(*keys, status.alias("diff")).where("diff IS NOT NULL")


def changed_by_content(
    current: DataFrame, previous: DataFrame, pk: str | Sequence[str]
) -> DataFrame:
    """Rows of ``current`` that are new or differ: the delta of a table without a cursor."""
    pk = _as_list(pk)
    moved = table_diff(current, previous, pk).where("diff <> 'only_right'")
    marked = moved.select(*[F.col(c).alias(f"_key_{c}") for c in pk])
    same = reduce(Column.__and__, [current[c].eqNullSafe(marked[f"_key_{c}"]) for c in pk])
    return current.join(marked, same, "left_semi")


def fabricate_delta(
    df: DataFrame, touched: Column, changes: dict[str, Column], fresh: DataFrame | None = None
) -> DataFrame:
    """The table after updating the ``touched`` rows and adding the ``fresh`` ones."""
    updated = df.select(
        *[
            F.when(touched, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)
            for c in df.columns
        ]
    )
    return updated if fresh is None else updated.unionByName(fresh.select(*df.columns))
