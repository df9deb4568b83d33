"""The roles of the lakehouse played by the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.queries.registry import table
from tarn.session import tasks_for

# Recent orders: the part of the table that a later sync finds changed.
RECENT = "2001-01-01 00:00:00"


def raw_customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers with padded mixed-case e-mails and a creation time."""
    key = F.col("c_custkey")
    start = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, d, "customer").select(
        key.alias("id"),
        F.concat(F.lit("  User"), key, F.lit("@Mail.Test ")).alias("email"),
        F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("name"),
        F.col("c_nationkey").alias("nation_id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
        F.timestamp_add("DAY", (key % 2000).cast("int"), start).alias("created_at"),
    )


RAW_CUSTOMERS = """
SELECT c_custkey AS id, '  User' || c_custkey || '@Mail.Test ' AS email,
       ' ' || c_name || ' ' AS name, c_nationkey AS nation_id, c_mktsegment AS segment,
       c_acctbal AS balance,
       TIMESTAMP '2020-01-01' + to_days(CAST(c_custkey % 2000 AS INTEGER)) AS created_at
FROM customer
"""


def repriced(spark: SparkSession, d: str) -> DataFrame:
    """Second load of ``orders``: recent ones cost more and are open, some are brand new."""
    orders = table(spark, d, "orders")
    recent = orders.where(F.col("o_orderdate") >= F.lit(RECENT).cast("timestamp_ntz"))
    changed = recent.withColumns(
        {"o_totalprice": F.col("o_totalprice") + 1000, "o_orderstatus": F.lit("O")}
    )
    fresh = recent.withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    return changed.unionByName(fresh)


REPRICED = f"""
SELECT o_orderkey, o_custkey, 'O' AS o_orderstatus, o_totalprice + 1000 AS o_totalprice,
       o_orderdate, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '{RECENT}'
UNION ALL
SELECT -1 - o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderdate >= TIMESTAMP '{RECENT}'
"""

MERGED_ORDERS = f"""
SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({REPRICED}))
UNION ALL
SELECT * FROM ({REPRICED})
"""


def contracts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as contracts: two parties among the customers, and a product."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    # Both sides are dealt by the order to as many tasks as their rows need: ids, ends and degrees are made there.
    tasks = tasks_for(lines.count() + orders.count())
    lines = lines.repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("second_party"), F.min("l_partkey").alias("product_id")
    )
    orders = orders.repartition(tasks, "o_orderkey")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("external_id"),
        F.col("o_custkey").alias("first_party"),
        "second_party",
        "product_id",
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderdate").alias("updated_at"),
    )


CONTRACTS = """
SELECT o_orderkey AS external_id, o_custkey AS first_party, second_party, product_id,
       o_orderstatus AS status, o_totalprice AS value, o_orderdate AS updated_at
FROM orders LEFT JOIN (
  SELECT l_orderkey, min(l_suppkey) AS second_party, min(l_partkey) AS product_id
  FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
"""


def users(spark: SparkSession, d: str) -> DataFrame:
    """Customers as users of the clean layer."""
    raw = raw_customers(spark, d)
    return raw.select(
        F.col("id").alias("external_id"),
        F.lower(F.trim("email")).alias("email"),
        F.trim("name").alias("name"),
        F.col("created_at").alias("updated_at"),
    )


def products(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
    )
