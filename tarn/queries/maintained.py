"""Views kept by delta, each equal to what a rebuild gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.maintained import CountedView, EntityIndex, RankedTable
from tarn.queries.inputs import MERGED_ORDERS, repriced
from tarn.queries.keyed import keyed_orders
from tarn.queries.registry import query, table
from tarn.session import cut_lineage, scratch_path


@query(f"""
SELECT o_orderkey, o_orderstatus, o_totalprice,
       rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS price_rank FROM ({MERGED_ORDERS})
""")
def rank_by_delta(spark: SparkSession, d: str) -> DataFrame:
    """Ranks after a merge, from the old and new rows of the batch alone."""
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    orders, batch = keyed_orders(spark, d), repriced(spark, d)
    ranks = RankedTable.create(orders.rows().select(*columns), scratch_path(spark, "ranks"), "o_orderkey", ["o_orderstatus"], "o_totalprice", 16)
    old = cut_lineage(orders.lookup(batch.select("o_orderkey")))
    ranks.apply(old, batch)
    return ranks.ranked("price_rank")


@query(f"""
SELECT o_custkey, count(*) AS n_orders FROM ({MERGED_ORDERS}) GROUP BY o_custkey
""")
def degrees_by_delta(spark: SparkSession, d: str) -> DataFrame:
    """Orders of each customer after a merge: the view's counts and the batch's signed ones."""
    orders, batch = keyed_orders(spark, d), repriced(spark, d)
    degrees = CountedView(orders.rows(), ["o_custkey"])
    degrees.apply(orders.lookup(batch.select("o_orderkey")), batch)
    return degrees.counts.select("o_custkey", F.col("n").alias("n_orders"))


@query("""
WITH known AS (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)
SELECT o_orderstatus AS type, count(*) AS total, count(*) FILTER (WHERE o_custkey IN (SELECT c_custkey FROM known)) AS resolved
FROM orders WHERE o_orderkey % 10 <> 3 GROUP BY o_orderstatus
""")
def edge_quality_by_delta(spark: SparkSession, d: str) -> DataFrame:
    """Resolved and all edges of each type, after edges were taken away and others added."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    known = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("resolved"))
    edges = orders.join(known, "o_custkey", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    view = CountedView(edges.where("o_orderkey % 5 <> 4"), ["o_orderstatus", "resolved"])
    view.apply(edges.where("o_orderkey % 10 = 3"), edges.where("o_orderkey % 5 = 4"))
    return view.counts.groupBy(F.col("o_orderstatus").alias("type")).agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("resolved"), F.col("n")).otherwise(0)).alias("resolved")
    )


@query("""
WITH now AS (
  SELECT c_custkey AS k, 'mail=' || (c_custkey // 4) AS a,
         CASE WHEN c_custkey % 8 = 3 AND c_custkey % 16 <> 11 THEN 'phone=' || (c_custkey // 8)
              WHEN c_custkey % 8 = 4 THEN 'phone=' || (c_custkey // 8) END AS b
  FROM customer WHERE c_custkey % 32 <> 4
), linked AS (  -- the two halves of eight are one entity where both ends of the phone are there
  SELECT k // 8 AS g FROM now WHERE b IS NOT NULL GROUP BY 1 HAVING count(*) = 2)
SELECT k AS customer, CASE WHEN k // 8 IN (SELECT g FROM linked) THEN least('mail=' || (k // 8 * 2), 'mail=' || (k // 8 * 2 + 1)) ELSE a END AS entity
FROM now
""")
def entities_by_delta(spark: SparkSession, d: str) -> DataFrame:
    """Two identity fields: fours share a mail, and a phone joins two fours. Some lose a row, some a phone, some gain one."""
    key = F.col("c_custkey")
    customers = table(spark, d, "customer").select(
        key.alias("k"), F.floor(key / 4).alias("mail"),
        F.when((key % 16 == 11) | (key % 16 == 4) | (key % 8 == 3) & (key % 16 != 11), F.floor(key / 8)).alias("phone"),
    )
    # At first the phone of 16n + 11 is there and that of 16n + 12 is not.
    index = EntityIndex(customers, "k", ["mail", "phone"])
    lost = customers.where("k % 16 = 11").withColumn("phone", F.lit(None).cast("bigint"))
    gained = customers.where("k % 16 = 12").withColumn("phone", F.floor(F.col("k") / 8))
    index.apply(lost.unionByName(gained), customers.where("k % 32 = 4"))
    return index.state.select(F.col("key").alias("customer"), "entity")
