"""Deterministic synthetic tables, built from ``spark.range`` without driver loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The partner dimension, and the cycle and first day of the synthetic customers.
PARTNER_COUNT = 1000
PARTNER_TIERS = ("platinum", "gold", "silver", "bronze")
BASE_RATE, RATE_STEP, RATE_CYCLE = "0.01", "0.005", 20
SEGMENT_COUNT = 10
CURSOR_DAYS = 100
FIRST_CURSOR = "2026-01-01 00:00:00"
PRODUCT_COUNT = 500

#: The partner dimension in SQL, from the same values.
PARTNERS_SQL = f"""
SELECT i + 1 AS partner_id, 'Partner ' || (i + 1) AS partner_name,
       list_extract({list(PARTNER_TIERS)}, CAST(1 + i % {len(PARTNER_TIERS)} AS INTEGER)) AS partner_tier,
       CAST({BASE_RATE} + (i % {RATE_CYCLE}) * {RATE_STEP} AS DECIMAL(10,3)) AS rate
FROM range({PARTNER_COUNT}) t(i)
"""


def gen_partners(spark: SparkSession, n: int = PARTNER_COUNT) -> DataFrame:
    """Partner dimension; tiers cycle, rates rise in ``RATE_CYCLE`` steps."""
    i = F.col("id")
    rate = F.expr(f"CAST({BASE_RATE} + (id % {RATE_CYCLE}) * {RATE_STEP} AS DECIMAL(10,3))")
    tiers = F.array(*[F.lit(t) for t in PARTNER_TIERS])
    return spark.range(n).select(
        (i + 1).alias("partner_id"),
        F.concat(F.lit("Partner "), i + 1).alias("partner_name"),
        F.element_at(tiers, (i % len(PARTNER_TIERS) + 1).cast("int")).alias("partner_tier"),
        rate.cast("double").alias("commission_rate"),
    )


def gen_customers(spark: SparkSession, n: int) -> DataFrame:
    """Customers with padded mixed-case e-mails, a balance, a segment and a cursor."""
    i = F.col("id")
    start = F.lit(FIRST_CURSOR).cast("timestamp_ntz")
    return spark.range(n).select(
        i,
        F.concat(F.lit("  User"), i, F.lit("@Mail.Test ")).alias("email"),
        F.concat(F.lit("Buyer "), i).alias("name"),
        ((i % 997) * 2.25).cast("double").alias("balance"),
        F.concat(F.lit("Sg"), i % SEGMENT_COUNT).alias("segment"),
        F.timestamp_add("DAY", (i % CURSOR_DAYS).cast("int"), start).alias("updated_at"),
    )


def gen_products(spark: SparkSession, n: int = PRODUCT_COUNT) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(
        i.alias("product_id"),
        F.concat(F.lit("Product "), i).alias("product_name"),
        F.concat(F.lit("Category "), i % 10).alias("category"),
    )


def gen_contracts(spark: SparkSession, n: int, users: int, products: int = PRODUCT_COUNT) -> DataFrame:
    """Contracts with two parties and a product, spread by hash."""
    i = F.col("id")
    start = F.lit(FIRST_CURSOR).cast("timestamp_ntz")
    states = F.array(*[F.lit(s) for s in ("open", "closed", "canceled")])
    return spark.range(n).select(
        i.alias("contract_id"),
        F.pmod(F.xxhash64(i, F.lit(1)), F.lit(users)).alias("first_party"),
        F.pmod(F.xxhash64(i, F.lit(2)), F.lit(users)).alias("second_party"),
        F.pmod(F.xxhash64(i, F.lit(3)), F.lit(products)).alias("product_id"),
        F.element_at(states, (i % 3 + 1).cast("int")).alias("status"),
        ((i % 10_000) * 13.7).cast("double").alias("value"),
        F.timestamp_add("DAY", (i % CURSOR_DAYS).cast("int"), start).alias("updated_at"),
    )
