"""Results kept by delta: ranks, counts and entities that follow signed changes instead of a recount.

A delta comes as rows taken away and rows added (``KeyedTable.lookup`` gives the old rows of a
batch). Each view reads the part of its own state that the delta touches and is equal to building
it anew.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.graph.entities import connected_components
from tarn.lake.files import SharedFiles
from tarn.operators.merge import without_keys
from tarn.operators.windows import range_of, value_bounds
from tarn.session import cut_lineage

RANGE = "range"


class RankedTable:
    """``rank() OVER (PARTITION BY by ORDER BY value DESC)`` kept by delta.

    Rows lie in folders of value ranges with their rank inside (group, range); a histogram counts
    the rows of each. A delta adjusts the histogram by its signed counts and ranks anew only the
    ranges it touches; reading adds the counts of the ranges above. The bounds are those of the
    first build and only balance the folders. Keys are unique and not NULL.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, by: Sequence[str], value: str, bounds: list, schema, histogram: DataFrame):
        self.spark, self.path, self.key, self.by, self.value = spark, path, key, list(by), value
        self.bounds, self.schema, self.histogram = bounds, schema, histogram

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, by: Sequence[str], value: str, ranges: int = 64) -> RankedTable:
        bounds, _ = value_bounds(df, value, ranges)
        table = cls(df.sparkSession, path, key, by, value, bounds, df.schema, df)
        table._store(table._placed(df), "static")
        table.histogram = cut_lineage(table._counts(table._placed(df), 1))
        return table

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(RANGE, range_of(df, self.value, self.bounds).cast("int"))

    def _counts(self, placed: DataFrame, sign: int) -> DataFrame:
        return placed.groupBy(*self.by, RANGE).agg((F.count("*") * sign).alias("n"))

    def _store(self, placed: DataFrame, mode: str) -> None:
        inside = Window.partitionBy(*self.by, RANGE).orderBy(F.col(self.value).desc_nulls_last())
        ranked = placed.withColumn("_inside", F.rank().over(inside))
        ranked.write.partitionBy(RANGE).mode("overwrite").option("partitionOverwriteMode", mode).option("compression", "zstd").parquet(self.path)

    def _read(self) -> DataFrame:
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema]
        return self.spark.read.schema(", ".join([*fields, "_inside int", f"{RANGE} int"])).parquet(self.path)

    def apply(self, removed: DataFrame, added: DataFrame) -> int:
        """Take away and add rows; returns the number of ranges ranked anew."""
        gone, fresh = (cut_lineage(self._placed(d.select(*self.schema.fieldNames()))) for d in (removed, added))
        hit = sorted({r[0] for d in (gone, fresh) for r in d.select(RANGE).distinct().collect()})  # at most the ranges there are
        if not hit:
            return 0
        kept = without_keys(self._read().where(F.col(RANGE).isin(hit)).drop("_inside"), gone, self.key)
        rows = cut_lineage(kept.unionByName(fresh))
        signed = self.histogram.unionByName(self._counts(gone, -1)).unionByName(self._counts(fresh, 1))
        self.histogram = cut_lineage(signed.groupBy(*self.by, RANGE).agg(F.sum("n").alias("n")).where("n <> 0"))
        self._store(rows, "dynamic")
        left = {r[0] for r in rows.select(RANGE).distinct().collect()}
        files = SharedFiles(self.spark, self.path)
        for r in hit:
            if r not in left:
                files.delete(f"{self.path}/{RANGE}={r}")
        return len(hit)

    def ranked(self, name: str = "rank") -> DataFrame:
        above = Window.partitionBy(*self.by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        starts = self.histogram.select(*[F.col(c).alias(f"_{c}") for c in self.by], F.col(RANGE).alias("_range"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_above"))
        rows = self._read()
        same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(starts[f"_{c}"]) for c in self.by], rows[RANGE] == starts["_range"])
        rank = (F.col("_above") + F.col("_inside")).cast("bigint").alias(name)
        return rows.join(starts, same).select(*self.schema.fieldNames(), rank)


class CountedView:
    """Counts of rows by ``keys``, kept by signed rows; also degrees and quality ratios of edges."""

    def __init__(self, rows: DataFrame, keys: Sequence[str]):
        self.keys = list(keys)
        self.counts = cut_lineage(rows.groupBy(*self.keys).agg(F.count("*").alias("n")))

    def apply(self, removed: DataFrame, added: DataFrame) -> None:
        """The delta's own counts meet the view's; neither the rows before nor those after are read."""
        minus = removed.groupBy(*self.keys).agg((-F.count("*")).alias("n"))
        plus = added.groupBy(*self.keys).agg(F.count("*").alias("n"))
        signed = self.counts.unionByName(minus).unionByName(plus)
        self.counts = cut_lineage(signed.groupBy(*self.keys).agg(F.sum("n").alias("n")).where("n <> 0"))


class EntityIndex:
    """Entities by several identity values, kept by delta.

    The state is one row per record: its key, its values and its entity (the least value of its
    component, its own key where it has no value). A delta rebuilds the components that its old
    rows belonged to and those that its new values occur in, from the records that are left; all
    other records keep their entity. So components merge through new values and split where a
    record is lost, and the result is that of a rebuild.
    """

    def __init__(self, rows: DataFrame, key: str, values: Sequence[str]):
        self.key, self.values = key, list(values)
        self.state = cut_lineage(self._resolved(self._records(rows)))

    def _records(self, rows: DataFrame) -> DataFrame:
        tagged = [F.concat(F.lit(f"{v}="), F.col(v).cast("string")) for v in self.values]
        return rows.select(F.col(self.key).alias("key"), F.array_compact(F.array(*tagged)).alias("held"))

    @staticmethod
    def _resolved(records: DataFrame) -> DataFrame:
        records = cut_lineage(records)
        pairs = records.select(F.col("held")[0].alias("a"), F.explode("held").alias("b")).where("a <> b").distinct()
        components = connected_components(pairs).select(F.col("node").alias("_first"), "component")
        first = F.when(F.size("held") > 0, F.col("held")[0])
        joined = records.withColumn("_first", first).join(components, "_first", "left")
        return joined.select("key", "held", F.coalesce("component", "_first", F.col("key").cast("string")).alias("entity"))

    def apply(self, changed: DataFrame, deleted: DataFrame) -> int:
        """``changed`` rows replace those of their key, ``deleted`` lists keys; returns the records resolved anew."""
        fresh = cut_lineage(self._records(changed))
        keys = cut_lineage(fresh.select("key").unionByName(deleted.select(F.col(self.key).alias("key"))).distinct())
        left = self.state.join(keys, "key", "left_semi").select("entity")
        values = fresh.select(F.explode("held").alias("value")).distinct()
        met = self.state.select("entity", F.explode("held").alias("value")).join(values, "value", "left_semi").select("entity")
        touched = cut_lineage(left.unionByName(met).distinct())
        others = self.state.join(keys, "key", "left_anti").join(touched, "entity", "left_semi")
        again = cut_lineage(self._resolved(others.select("key", "held").unionByName(fresh)))
        untouched = self.state.join(touched, "entity", "left_anti").join(keys, "key", "left_anti")
        self.state = cut_lineage(untouched.select("key", "held", "entity").unionByName(again))
        return again.count()
