"""Registered queries: a Spark function over the given tables and its SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.lake.store import LakeStore
from tarn.session import scratch_path

QueryFunction = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFunction] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function under its name, with the ANSI SQL that gives the same rows."""

    def register(function: QueryFunction) -> QueryFunction:
        key = name or function.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = sql.strip()
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_lake(spark: SparkSession, name: str = "lake") -> LakeStore:
    """A lake of its own under the session's shared folder."""
    return LakeStore(spark, scratch_path(spark, name)).bootstrap()


def row_counts_of(**frames: DataFrame) -> DataFrame:
    """One row with the row count of each frame, as a column of its name."""
    counted = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("frame"), "n") for name, df in frames.items()
    ]
    counts = reduce(DataFrame.unionByName, counted)
    return counts.agg(*[F.max(F.when(F.col("frame") == n, F.col("n"))).alias(n) for n in frames])


def uuid5_sql(text: str) -> str:
    """SQL expression of the name-based UUID of a text expression."""
    digest = f"sha1(unhex('{uuid.NAMESPACE_URL.hex}') || encode({text}))"
    variant = f"translate(substr({digest}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')"
    return (
        f"substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-5' || substr({digest}, 14, 3)"
        f" || '-' || {variant} || substr({digest}, 18, 3) || '-' || substr({digest}, 21, 12)"
    )
