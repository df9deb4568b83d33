"""Pages and samples by counted ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.paging import deep_page, rows_between
from tarn.queries.registry import query, table


@query("""
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
ORDER BY l_quantity DESC NULLS LAST, l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_tax LIMIT 50 OFFSET 29950
""")
def deep_page_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """Page 600 of an order that begins with few values: the ranges before it are only counted."""
    order = [("l_quantity", True), "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax"]
    return deep_page(table(spark, d, "lineitem"), order, 600, 50, edge=1000).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )


@query("""
SELECT o_orderstatus, count(*) AS n_orders, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS total FROM (
  SELECT * FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10000 OFFSET 1000) GROUP BY o_orderstatus
""")
def large_sample_by_price(spark: SparkSession, d: str) -> DataFrame:
    """Ten thousand orders behind the first thousand by price: only the ranges at both ends are sorted."""
    found = rows_between(table(spark, d, "orders"), [("o_totalprice", True), "o_orderkey"], 1000, 11000, edge=500)
    return found.groupBy("o_orderstatus").agg(
        F.count("*").alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")
    )
