"""Tables laid out by key, and change feeds with state on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.lake.keyed import BUCKET, KeyedTable
from tarn.queries.inputs import MERGED_ORDERS, RECENT, REPRICED, repriced
from tarn.queries.registry import query, table
from tarn.queries.writes import USER_CHANGES, user_base, user_changes
from tarn.session import cut_lineage, scratch_path
from tarn.streaming.feeds import stream_into_keyed
from tarn.streaming.landed import landed_files

BUCKETS = 16


def keyed_orders(spark: SparkSession, d: str, buckets: int = BUCKETS) -> KeyedTable:
    return KeyedTable.create(table(spark, d, "orders"), scratch_path(spark, "keyed"), "o_orderkey", buckets)


@query(MERGED_ORDERS)
def keyed_merge(spark: SparkSession, d: str) -> DataFrame:
    """Merging twice by replacing buckets gives the same table as merging once."""
    orders = keyed_orders(spark, d)
    for _ in range(2):
        orders.merge(repriced(spark, d))
    return orders.rows()


@query("""
SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
""")
def keyed_delete(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a returned line go; buckets left without rows lose their folder."""
    orders = keyed_orders(spark, d)
    gone = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    orders.delete(gone)
    return orders.rows()


def files_of(orders: KeyedTable) -> DataFrame:
    return orders.read().select(BUCKET, F.col("_metadata.file_name").alias("file")).distinct()


@query(f"""
SELECT count(*) AS n_rows, true AS others_kept, true AS delta_read
FROM orders WHERE o_orderkey NOT IN (SELECT max(o_orderkey) FROM orders WHERE o_orderdate >= TIMESTAMP '{RECENT}')
""")
def keyed_delta_files(spark: SparkSession, d: str) -> DataFrame:
    """A change of one order rewrites the files of its bucket and no others."""
    orders = keyed_orders(spark, d)
    before = cut_lineage(files_of(orders))
    recent = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit(RECENT).cast("timestamp_ntz"))
    rewrite = orders.delete(recent.agg(F.max("o_orderkey").alias("o_orderkey")))
    lost = before.join(files_of(orders), [BUCKET, "file"], "left_anti").agg(F.count_distinct(BUCKET).alias("lost")).first()["lost"]
    return orders.rows().agg(F.count("*").alias("n_rows")).select(
        "n_rows", F.lit(lost == rewrite.rewritten).alias("others_kept"), F.lit(rewrite.rewritten == 1).alias("delta_read")
    )


@query(f"""
SELECT o_orderkey, o_totalprice FROM ({MERGED_ORDERS})
WHERE o_orderkey IN (SELECT o_orderkey FROM ({REPRICED}))
""")
def keyed_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The merged rows by their keys, from their buckets alone."""
    orders = keyed_orders(spark, d)
    batch = repriced(spark, d)
    orders.merge(batch)
    return orders.lookup(batch.select("o_orderkey")).select("o_orderkey", "o_totalprice")


@query(USER_CHANGES)
def stream_stateful_changes(spark: SparkSession, d: str) -> DataFrame:
    """Events as a change feed that lands in three parts out of order; the stream keeps what each user has seen."""
    users = KeyedTable.create(user_base(spark, d), scratch_path(spark, "keyed"), "user_id", BUCKETS)
    landed, changes = scratch_path(spark, "landed"), user_changes(spark, d)
    for part in (2, 0, 1):
        changes.where(F.pmod("event_id", F.lit(3)) == part).coalesce(1).write.mode("append").parquet(landed)
    stream = landed_files(spark, landed, changes.schema, max_files=1)
    stream_into_keyed(users, stream, ["ts", "event_id"], "op", scratch_path(spark, "feed"), slots=16)
    return users.rows()
