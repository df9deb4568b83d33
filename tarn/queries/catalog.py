"""Catalog questions and read-only serving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.serving import matches_search, preview, run_sql
from tarn.queries.inputs import MERGED_ORDERS, repriced
from tarn.queries.registry import new_lake, query, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _orders_lake(spark: SparkSession, d: str):
    """Orders after an overwrite, a merge and a delete."""
    lake = new_lake(spark)
    lake.write("raw", "orders", table(spark, d, "orders"))
    lake.write("raw", "orders", repriced(spark, d), "merge", pk="o_orderkey")
    low = table(spark, d, "orders").where("o_orderpriority = '5-LOW'")
    lake.delete_where_in("raw/orders", "o_orderkey", low)
    return lake


ORDERS_CHANGES = f"""
SELECT 1 AS snapshot_id, 'overwrite' AS operation, count(*) AS changed_rows FROM orders
UNION ALL SELECT 2, 'merge', count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'
UNION ALL SELECT 2, 'merge', count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'
UNION ALL SELECT 3, 'delete', count(*) FROM orders WHERE o_orderpriority = '5-LOW'
"""


@query("""
SELECT 'raw' AS layer, t AS table_name, 1 AS version
FROM (VALUES ('customer'), ('events'), ('lineitem'), ('nation'), ('orders'), ('part'), ('region'), ('supplier')) v(t)
""")
def table_list(spark: SparkSession, d: str) -> DataFrame:
    lake = new_lake(spark)
    for name in TABLES:
        lake.write("raw", name, table(spark, d, name))
    return lake.list_tables("raw")


@query("""
SELECT row_number() OVER ()::INTEGER AS position, column_name,
       CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
            WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS data_type
FROM (DESCRIBE lineitem)
""")
def table_columns(spark: SparkSession, d: str) -> DataFrame:
    lake = new_lake(spark)
    lake.write("raw", "lines", table(spark, d, "lineitem"))
    return lake.get_columns("raw/lines")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def row_counts(spark: SparkSession, d: str) -> DataFrame:
    frames = [
        table(spark, d, t).agg(F.count("*").alias("n_rows")).withColumn("table_name", F.lit(t))
        for t in TABLES
    ]
    counts = frames[0]
    for frame in frames[1:]:
        counts = counts.unionByName(frame)
    return counts


@query(f"""
SELECT snapshot_id, operation, 6 AS columns, snapshot_id AS segments,
       CAST(sum(changed_rows) AS BIGINT) AS changed_rows
FROM ({ORDERS_CHANGES}) GROUP BY snapshot_id, operation
""")
def snapshot_list(spark: SparkSession, d: str) -> DataFrame:
    lake = _orders_lake(spark, d)
    return lake.snapshots("raw/orders").select(
        "snapshot_id", "operation", "columns", "segments", "changed_rows"
    )


@query(f"""
SELECT 'raw/orders' AS table_name, snapshot_id, operation, CAST(sum(changed_rows) AS BIGINT) AS changed_rows
FROM ({ORDERS_CHANGES}) GROUP BY snapshot_id, operation
UNION ALL SELECT 'clean/parts', 1, 'overwrite', count(*) FROM part
""")
def snapshot_changes(spark: SparkSession, d: str) -> DataFrame:
    lake = _orders_lake(spark, d)
    lake.write("clean", "parts", table(spark, d, "part"))
    return lake.snapshot_changes()


@query(f"""
SELECT CAST(sum(changed_rows) AS BIGINT) AS record_count, true AS has_size FROM ({ORDERS_CHANGES})
""")
def data_file_counts(spark: SparkSession, d: str) -> DataFrame:
    files = _orders_lake(spark, d).data_files("raw/orders")
    return files.agg(
        F.sum("record_count").alias("record_count"), (F.min("file_size") > 0).alias("has_size")
    )


@query(f"""
WITH t AS (SELECT * FROM ({MERGED_ORDERS}) WHERE o_orderkey NOT IN
           (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW'))
SELECT 'o_orderkey' AS column_name, min(o_orderkey)::VARCHAR AS min_value, max(o_orderkey)::VARCHAR AS max_value,
       count(*) - count(o_orderkey) AS null_count FROM t
UNION ALL SELECT 'o_custkey', min(o_custkey)::VARCHAR, max(o_custkey)::VARCHAR, count(*) - count(o_custkey) FROM t
UNION ALL SELECT 'o_orderstatus', min(o_orderstatus), max(o_orderstatus), count(*) - count(o_orderstatus) FROM t
UNION ALL SELECT 'o_orderpriority', min(o_orderpriority), max(o_orderpriority), count(*) - count(o_orderpriority) FROM t
UNION ALL SELECT 'o_totalprice', min(o_totalprice)::VARCHAR, max(o_totalprice)::VARCHAR, count(*) - count(o_totalprice) FROM t
UNION ALL SELECT 'o_orderdate', min(o_orderdate)::VARCHAR, max(o_orderdate)::VARCHAR, count(*) - count(o_orderdate) FROM t
""")
def column_stats(spark: SparkSession, d: str) -> DataFrame:
    return _orders_lake(spark, d).column_stats("raw/orders")


@query("""
SELECT * FROM customer WHERE c_name ILIKE '%build%' OR c_mktsegment ILIKE '%build%'
ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 20
""")
def preview_search_page(spark: SparkSession, d: str) -> DataFrame:
    return preview(
        table(spark, d, "customer"), "c_custkey", search="build", sort="c_acctbal", desc=True, page=2, size=20
    )


@query("""
SELECT * FROM customer WHERE c_name ILIKE '%99%' OR c_mktsegment ILIKE '%99%'
""")
def ilike_search(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer")
    return customers.where(matches_search(customers, "99"))


@query("""
SELECT c_mktsegment, o_orderstatus, count(*) AS n_orders
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderstatus
""")
def run_sql_group(spark: SparkSession, d: str) -> DataFrame:
    lake = new_lake(spark)
    lake.write("clean", "orders", table(spark, d, "orders"))
    lake.write("clean", "customers", table(spark, d, "customer"))
    return run_sql(lake, """
        SELECT c_mktsegment, o_orderstatus, count(*) AS n_orders
        FROM clean_orders JOIN clean_customers ON o_custkey = c_custkey
        GROUP BY c_mktsegment, o_orderstatus""").rows


@query("""
SELECT c_mktsegment, n_regionkey, count(*) AS n_customers
FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY GROUPING SETS ((c_mktsegment, n_regionkey), (c_mktsegment), ())
""")
def sql_escape_hatch(spark: SparkSession, d: str) -> DataFrame:
    lake = new_lake(spark)
    lake.write("raw", "customers", table(spark, d, "customer"))
    lake.write("clean", "nations", table(spark, d, "nation"))
    return lake.sql("""
        SELECT c_mktsegment, n_regionkey, count(*) AS n_customers
        FROM raw_customers JOIN clean_nations ON c_nationkey = n_nationkey
        GROUP BY GROUPING SETS ((c_mktsegment, n_regionkey), (c_mktsegment), ())""")
