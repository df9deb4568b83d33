"""Tables in files: Parquet folders, JSON document collections, landed API pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.operators.merge import keep_latest


def read_parquet_dir(spark: SparkSession, root: str, source: str) -> DataFrame:
    """Folder or glob of Parquet files, e.g. ``clean/orders`` or ``raw/*``."""
    return spark.read.parquet(f"{root.rstrip('/')}/{source}")


def read_open_table(spark: SparkSession, path: str, table_format: str) -> DataFrame:
    """Delta or Iceberg table by path, where its package is on the class path."""
    if table_format not in ("delta", "iceberg"):
        raise ValueError(f"unknown table format: {table_format}")
    try:
        return spark.read.format(table_format).load(path)
    except Exception as error:
        if "DATA_SOURCE_NOT_FOUND" in str(error) or "ClassNotFound" in str(error):
            raise RuntimeError(f"the {table_format} package is not on the class path") from error
        raise


def read_documents(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, key: str = "_id"
) -> DataFrame:
    """Collection exported as JSON lines; the key (``_id`` by default) becomes text.

    Give a schema at scale: without one Spark reads the files twice to infer it.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.json(path)
    if key not in df.columns:
        raise ValueError(f"documents have no {key}")
    if isinstance(df.schema[key].dataType, T.StructType):
        # Exported object ids come as {"$oid": "..."}.
        return df.withColumn(key, F.col(f"{key}.`$oid`"))
    return df.withColumn(key, F.col(key).cast("string"))


def parse_fields(df: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """Opaque JSON text into typed columns next to the others."""
    keep = [c for c in df.columns if c != column]
    return df.withColumn("_f", F.from_json(column, schema)).select(*keep, "_f.*")


def flatten_pages(
    pages: DataFrame,
    body: str,
    records_path: str,
    record_schema: T.StructType | str,
    key: str | Sequence[str],
    order: str | Sequence[str],
) -> DataFrame:
    """API page envelopes to records; a record seen on overlapping pages is kept once.

    ``records_path`` names the array inside the envelope (``data`` or ``result.items``).
    """
    record = (
        record_schema.simpleString()
        if isinstance(record_schema, T.StructType)
        else f"struct<{record_schema}>"
    )
    shape = f"array<{record}>"
    for part in reversed(records_path.split(".")):
        shape = f"struct<`{part}`: {shape}>"
    envelope = pages.select(F.from_json(body, shape, {}).alias("_page"))
    path = ".".join(f"`{p}`" for p in records_path.split("."))
    return keep_latest(envelope.select(F.inline(F.col(f"_page.{path}"))), key, order)


def page_envelope(records: Column, has_more: Column) -> Column:
    """JSON text of a page as an API returns it."""
    return F.to_json(F.struct(records.alias("data"), has_more.alias("hasMore")))
