"""Reads: files, increments, federated sources, documents, API pages, generated rows."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.queries.inputs import MERGED_ORDERS, repriced
from tarn.queries.registry import new_lake, query, table
from tarn.session import scratch_path
from tarn.sources.federation import FolderRemote, federate
from tarn.sources.files import flatten_pages, page_envelope, parse_fields, read_documents, read_parquet_dir
from tarn.sources.landed_source import register
from tarn.sources.generate import PARTNER_COUNT, PARTNERS_SQL, gen_partners
from tarn.sources.jdbc import read_increment

MARK = dt.datetime(2024, 1, 15)
ORDER_MARK = dt.datetime(2000, 1, 1)


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n_lines,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total_qty
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-09-01' GROUP BY l_returnflag, l_linestatus
""")
def scan_parquet(spark: SparkSession, d: str) -> DataFrame:
    lines = read_parquet_dir(spark, d, "lineitem.parquet")
    return (
        lines.where(F.col("l_shipdate") >= F.lit("1998-09-01").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count("*").alias("n_lines"),
            F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("total_qty"),
        )
    )


@query("SELECT event_id, user_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-15'")
def incremental_delta(spark: SparkSession, d: str) -> DataFrame:
    return read_increment(table(spark, d, "events"), "ts", MARK).select("event_id", "user_id", "ts")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def lake_read_columns(spark: SparkSession, d: str) -> DataFrame:
    lake = new_lake(spark)
    lake.write("clean", "orders", table(spark, d, "orders"))
    return lake.read("clean/orders", columns=["o_orderkey", "o_orderstatus"])


@query("""
SELECT 'events' AS table_name, count(*) AS n_rows FROM events WHERE ts > TIMESTAMP '2024-01-15'
UNION ALL SELECT 'orders', count(*) FROM orders
""")
def lake_read_watermark(spark: SparkSession, d: str) -> DataFrame:
    """A table without the cursor column is read whole."""
    lake = new_lake(spark)
    counts = []
    for name in ("events", "orders"):
        lake.write("raw", name, table(spark, d, name), sort_by="ts")
        delta = lake.read(f"raw/{name}", watermark=MARK, cursor="ts")
        counts.append(delta.agg(F.count("*").alias("n_rows")).withColumn("table_name", F.lit(name)))
    return counts[0].unionByName(counts[1])


@query(f"""
SELECT 1 AS snapshot_id, count(*) AS n_rows,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders
UNION ALL
SELECT 2, count(*), CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)
FROM ({MERGED_ORDERS})
""")
def time_travel(spark: SparkSession, d: str) -> DataFrame:
    lake = new_lake(spark)
    lake.write("raw", "orders", table(spark, d, "orders"))
    lake.write("raw", "orders", repriced(spark, d), "merge", pk="o_orderkey")
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")
    frames = [
        lake.read("raw/orders", snapshot=n)
        .agg(F.count("*").alias("n_rows"), total)
        .withColumn("snapshot_id", F.lit(n))
        for n in (1, 2)
    ]
    return frames[0].unionByName(frames[1])


def _customer_lake(spark: SparkSession, d: str) -> FolderRemote:
    return FolderRemote(spark, d, suffix=".parquet")


@query("""
SELECT o_orderstatus AS status, count(*) AS n_rows,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_amount
FROM orders GROUP BY o_orderstatus
""")
def federated_query(spark: SparkSession, d: str) -> DataFrame:
    text = """
        SELECT o_orderstatus AS status, count(*) AS n_rows,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_amount
        FROM {orders} GROUP BY o_orderstatus"""
    return federate(_customer_lake(spark, d), query=text, orders="orders")


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_size >= 25")
def federated_relation(spark: SparkSession, d: str) -> DataFrame:
    parts = federate(_customer_lake(spark, d), relation="part")
    return parts.where("p_size >= 25").select("p_partkey", "p_brand", "p_size")


@query("""
SELECT n_name, count(*) AS n_suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey
GROUP BY n_name
""")
def federated_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Catalog mode: the schema is the folder of the scale factor."""
    root, schema = os.path.split(d.rstrip("/"))
    remote = FolderRemote(spark, root, suffix=".parquet")
    suppliers = federate(remote, schema=schema, table="supplier")
    nations = federate(remote, schema=schema, table="nation")
    joined = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("n_suppliers"))


@query("""
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01'
""")
def federated_increment(spark: SparkSession, d: str) -> DataFrame:
    return federate(
        _customer_lake(spark, d), relation="orders", watermark=ORDER_MARK, cursor="o_orderdate"
    ).select("o_orderkey", "o_orderdate")


@query("""
SELECT conv_id || ':' || turn AS _id, role, length(text) AS n_chars FROM conversations
""")
def document_scan(spark: SparkSession, d: str) -> DataFrame:
    """Conversations exported as a collection of JSON documents and read back."""
    path = scratch_path(spark, "collection")
    key = F.concat_ws(":", "conv_id", "turn").alias("_id")
    table(spark, d, "conversations").select(key, "role", "text").write.json(path)
    documents = read_documents(spark, path, "_id string, role string, text string")
    return documents.select("_id", "role", F.length("text").cast("bigint").alias("n_chars"))


@query("SELECT event_id, user_id, event_type, value FROM events", name="flatten_pages")
def flatten_overlapping_pages(spark: SparkSession, d: str) -> DataFrame:
    """API pages of 100 records that repeat the first 10 of the next page."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    page = F.floor(F.col("event_id") / 100)
    overlap = F.when(F.col("event_id") % 100 < 10, page - 1)
    on_pages = events.withColumn("page", F.explode(F.array_compact(F.array(page, overlap))))
    records = F.collect_list(F.struct(*events.columns))
    pages = on_pages.groupBy("page").agg(page_envelope(records, F.lit(True)).alias("body"))
    shape = "event_id bigint, user_id bigint, event_type string, value double"
    return flatten_pages(pages, "body", "data", shape, "event_id", "value")


@query("""
SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n_events,
       count(DISTINCT user_id) AS n_users FROM events GROUP BY 1
""")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    typed = parse_fields(table(spark, d, "events"), "props", "k int")
    return typed.groupBy("k").agg(
        F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users")
    )


@query("""
SELECT v.priority, v.weight, count(*) AS n_orders
FROM orders JOIN (VALUES ('1-URGENT', 5), ('2-HIGH', 3), ('5-LOW', 1)) AS v(priority, weight)
  ON o_orderpriority = v.priority GROUP BY v.priority, v.weight
""")
def values_relation(spark: SparkSession, d: str) -> DataFrame:
    weights = spark.sql(
        "SELECT * FROM VALUES ('1-URGENT', 5), ('2-HIGH', 3), ('5-LOW', 1) AS v(priority, weight)"
    )
    orders = table(spark, d, "orders")
    joined = orders.join(weights, F.col("o_orderpriority") == F.col("priority"))
    return joined.groupBy("priority", "weight").agg(F.count("*").alias("n_orders"))


@query(f"""
WITH partners AS (SELECT * EXCLUDE (rate), CAST(rate AS DOUBLE) AS commission_rate FROM ({PARTNERS_SQL}))
SELECT partner_id, partner_name, partner_tier, commission_rate, count(c_custkey) AS n_customers
FROM partners LEFT JOIN customer ON partner_id = 1 + c_custkey % {PARTNER_COUNT}
GROUP BY partner_id, partner_name, partner_tier, commission_rate
""", name="gen_partners")
def customers_of_partners(spark: SparkSession, d: str) -> DataFrame:
    """The generated dimension with the customers assigned to each partner."""
    partners = gen_partners(spark)
    assigned = table(spark, d, "customer").groupBy(
        (F.pmod("c_custkey", F.lit(PARTNER_COUNT)) + 1).alias("_partner")
    ).agg(F.count("*").alias("_n"))
    joined = partners.join(assigned, F.col("partner_id") == F.col("_partner"), "left")
    return joined.select(*partners.columns, F.coalesce("_n", F.lit(0)).alias("n_customers"))


@query("""
SELECT n_name, count(*) AS n_suppliers,
       CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name
""")
def origin_agnostic_read(spark: SparkSession, d: str) -> DataFrame:
    """A lake table and a federated one, through the same call."""
    lake = new_lake(spark)
    lake.write("clean", "nations", table(spark, d, "nation"))
    remote = _customer_lake(spark, d)
    lake.attach_federation("suppliers", lambda: federate(remote, relation="supplier"))
    nations, suppliers = lake.read(("clean", "nations")), lake.read(("fed", "suppliers"))
    joined = nations.join(suppliers, F.col("n_nationkey") == F.col("s_nationkey"))
    return joined.groupBy("n_name").agg(
        F.count("*").alias("n_suppliers"),
        F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"),
    )


@query("""
SELECT event_type, count(*) AS n_events, max(event_id) AS last_event FROM events
WHERE ts > TIMESTAMP '2024-01-03 00:00:00' GROUP BY event_type
""")
def source_increment(spark: SparkSession, d: str) -> DataFrame:
    """Events above a mark through the library's own source, which filters before rows leave the reader."""
    register(spark)
    events = spark.read.format("landed").option("path", f"{d}/events.parquet").option("cursor", "ts").load()
    mark = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    return events.where(F.col("ts") > mark).groupBy("event_type").agg(F.count("*").alias("n_events"), F.max("event_id").alias("last_event"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def source_stream(spark: SparkSession, d: str) -> DataFrame:
    """Documents that land as JSON in two goes, streamed with offsets of files: each comes once."""
    register(spark)
    landing, target, checkpoint = (scratch_path(spark, n) for n in ("landing", "target", "offsets"))
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    for part in (0, 1):
        turns.where(F.pmod("conv_id", F.lit(2)) == part).write.mode("append").json(landing)
        stream = spark.readStream.format("landed").schema(turns.schema).option("path", landing).option("format", "json").load()
        written = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        written.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(turns.schema).parquet(target)
