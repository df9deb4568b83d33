"""Relational sources over JDBC, read in parallel and in bounded memory."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from tarn.functions.scalars import beyond

# Fixed value: rows fetched per round trip.
FETCH_ROWS = 10_000


def jdbc_options(
    url: str,
    table: str | None = None,
    query: str | None = None,
    fetch_rows: int = FETCH_ROWS,
    **extra: str,
) -> dict[str, str]:
    """Reader options of a table or of a query the source runs itself."""
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    target = {"dbtable": table} if table else {"query": query}
    return {"url": url, "fetchsize": str(fetch_rows), **target, **extra}


def partition_options(column: str, lower: object, upper: object, partitions: int) -> dict[str, str]:
    """Options that split a scan into ``partitions`` ranges of an indexed column."""
    if partitions < 1:
        raise ValueError("at least one partition")
    return {
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def bounds_query(table: str, column: str) -> str:
    return f"SELECT min({column}) AS lo, max({column}) AS hi FROM {table}"


def increment_query(table: str, cursor: str, watermark: object) -> str:
    """Query for ``cursor > watermark`` evaluated at the source."""
    if isinstance(watermark, (int, float)):
        literal = str(watermark)
    elif isinstance(watermark, (dt.datetime, dt.date)):
        literal = f"TIMESTAMP '{watermark.isoformat(sep=' ') if isinstance(watermark, dt.datetime) else watermark}'"
    else:
        literal = "'" + str(watermark).replace("'", "''") + "'"
    return f"SELECT * FROM {table} WHERE {cursor} > {literal}"


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    lower: object | None = None,
    upper: object | None = None,
    num_partitions: int = 8,
    fetch_rows: int = FETCH_ROWS,
    **extra: str,
) -> DataFrame:
    """Table scan: one connection, or ``num_partitions`` of them on a numeric column.

    Missing bounds are asked from the source (an index answers min and max).
    """
    reader = spark.read.format("jdbc").options(**jdbc_options(url, table, None, fetch_rows, **extra))
    if partition_column is None:
        return reader.load()
    if lower is None or upper is None:
        asked = jdbc_options(url, None, bounds_query(table, partition_column), fetch_rows, **extra)
        bounds = spark.read.format("jdbc").options(**asked).load().first()
        lower, upper = bounds[0], bounds[1]
        if lower is None:
            return reader.load()
    return reader.options(**partition_options(partition_column, lower, upper, num_partitions)).load()


def read_increment(df: DataFrame, cursor: str, last: object | None) -> DataFrame:
    """Rows with ``cursor > last``; the filter is pushed to JDBC and Parquet scans."""
    return df if last is None else df.where(beyond(df, cursor, last))
