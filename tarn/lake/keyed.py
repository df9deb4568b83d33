"""Tables laid out by key: plain Parquet in hash buckets that merges and deletes replace.

A row lives in the folder ``bucket=pmod(hash(key), buckets)``. A merge or delete knows from its
keys alone which buckets it touches, reads and rewrites those with a dynamic partition overwrite,
and leaves all others as they are, unopened. Reading is one scan: nothing has to be hidden behind
an anti-join, whatever was merged before.

The number of buckets is chosen so that a bucket is a few files (``buckets_for``). A batch of k
keys touches at most k buckets, so a delta costs at most its keys times a bucket and never more
than the table. Tables that grow are laid out anew with ``rebucket``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.lake.files import SharedFiles
from tarn.operators.merge import conform, keep_latest, require_columns, without_keys
from tarn.session import cut_lineage

BUCKET = "bucket"
#: Bytes that a bucket should hold.
BUCKET_BYTES = 256 << 20


def buckets_for(table_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """A power of two, so that a table laid out anew with twice as many splits each bucket in two."""
    return 1 << max(0, (max(1, -(-table_bytes // bucket_bytes)) - 1).bit_length())


@dataclass(frozen=True)
class Rewrite:
    """What a write touched: buckets rewritten, buckets left without rows, and all buckets there are."""

    rewritten: int
    emptied: int
    buckets: int


class KeyedTable:
    """A bucketed table at ``path``; ``pk`` and ``buckets`` are properties of the layout.

    A writer that dies while its files are moved into place leaves each bucket as it was or as it
    should be; giving the same batch again brings the table to the same rows, since merges and
    deletes by key are idempotent. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, pk: str | Sequence[str], buckets: int, schema: T.StructType):
        self.spark, self.path, self.buckets, self.schema = spark, path.rstrip("/"), buckets, schema
        self.pk = [pk] if isinstance(pk, str) else list(pk)

    @classmethod
    def create(cls, df: DataFrame, path: str, pk: str | Sequence[str], buckets: int, order: str | Sequence[str] | None = None) -> KeyedTable:
        """Lay ``df`` out anew; of several rows of one key the latest by ``order`` stays."""
        table = cls(df.sparkSession, path, pk, buckets, df.schema)
        if BUCKET in df.columns:
            raise ValueError(f"a column may not be called {BUCKET}")
        require_columns(df, table.pk, "key")
        placed = keep_latest(df, table.pk, order).withColumn(BUCKET, table.bucket())
        # Whole buckets to a task, except that AQE splits those that are too large for one.
        table._store(placed.hint("rebalance", BUCKET), "static")
        return table

    def bucket(self) -> Column:
        """The bucket of a row; NULL keys have one as well."""
        return F.pmod(F.hash(*self.pk), F.lit(self.buckets))

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets: a partition filter, so other folders are not opened."""
        rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(self.path)
        if buckets is not None:
            rows = rows.where(F.col(BUCKET).isin([int(b) for b in buckets]))
        return rows

    def rows(self) -> DataFrame:
        return self.read().select(*self.schema.fieldNames())

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows whose key is among ``keys``; only their buckets are read."""
        marked = keys.select(*[F.col(c).alias(f"_key_{i}") for i, c in enumerate(self.pk)]).distinct()
        found = self.read(self.touched(keys)).select(*self.schema.fieldNames())
        same = F.lit(True)
        for i, c in enumerate(self.pk):
            same &= found[c].eqNullSafe(marked[f"_key_{i}"])
        return found.join(marked, same, "left_semi")

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of ``keys``, at most all there are."""
        key_types = [self.schema[c].dataType for c in self.pk]
        cast = keys.select(*[F.col(c).cast(t).alias(c) for c, t in zip(self.pk, key_types, strict=True)])
        return sorted(r[0] for r in cast.select(self.bucket().alias("b")).distinct().collect())

    def merge(self, batch: DataFrame, order: str | Sequence[str] | None = None) -> Rewrite:
        """Rows of ``batch`` replace those of the same key, others are added."""
        require_columns(batch, self.pk, "merge key")
        unknown = [c for c in batch.columns if c not in self.schema.fieldNames()]
        if unknown:
            raise ValueError(f"not in the table: {', '.join(unknown)}")
        incoming = cut_lineage(keep_latest(conform(batch, self.schema), self.pk, order))
        return self._replace(incoming.select(*self.pk), incoming)

    def delete(self, keys: DataFrame) -> Rewrite:
        """Rows whose key is among ``keys`` go."""
        require_columns(keys, self.pk, "key")
        wanted = T.StructType([self.schema[c] for c in self.pk])
        return self._replace(cut_lineage(conform(keys.select(*self.pk), wanted).distinct()), None)

    def apply(self, changes: DataFrame, op_col: str, delete_op: str = "delete") -> Rewrite:
        """Upserts and deletes of changes that hold one row per key (see ``tarn.streaming.feeds``)."""
        changes = cut_lineage(changes)
        gone = F.col(op_col).eqNullSafe(delete_op)
        alive = conform(changes.where(~gone).drop(op_col), self.schema)
        return self._replace(changes.select(*self.pk), alive)

    def _replace(self, keys: DataFrame, incoming: DataFrame | None) -> Rewrite:
        hit = self.touched(keys)
        if not hit:
            return Rewrite(0, 0, self.buckets)
        # Rows that stay are streamed from their bucket into its next version: the keys are the
        # small side, and no row of the table is shuffled while they fit a broadcast.
        kept = without_keys(self.read(hit), keys, self.pk)
        if incoming is not None:
            kept = kept.unionByName(incoming.withColumn(BUCKET, self.bucket()))
        filled = self._store(kept, "dynamic")
        # A bucket that gets no row keeps its files in a dynamic overwrite; its folder goes instead.
        emptied = [b for b in hit if b not in filled]
        files = SharedFiles(self.spark, self.path)
        for b in emptied:
            files.delete(f"{self.path}/{BUCKET}={b}")
        return Rewrite(len(hit), len(emptied), self.buckets)

    def _store(self, placed: DataFrame, mode: str) -> set[int]:
        """Write rows with their bucket and return the buckets that got some; ``dynamic`` replaces only these."""
        seen = Observation()
        observed = placed.observe(seen, F.collect_set(BUCKET).alias("buckets"))
        observed.write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", mode).option(
            "compression", "zstd"
        ).parquet(self.path)
        return set(seen.get["buckets"])

    def rebucket(self, path: str, buckets: int) -> KeyedTable:
        """The same rows in another number of buckets, at another path."""
        return KeyedTable.create(self.rows(), path, self.pk, buckets)
