"""Writes: overwrite, append, merges, deletes, change feeds, drift, maintenance."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.lake.store import dual_write as write_both
from tarn.operators import merge
from tarn.operators.privacy import protect
from tarn.queries.inputs import MERGED_ORDERS, RECENT, REPRICED, raw_customers, repriced
from tarn.queries.registry import new_lake, query, row_counts_of, table
from tarn.streaming.config import default_config
from tarn.streaming.sync import sync_resource

LATEST_LINE = """
SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY
        l_shipdate DESC NULLS LAST, l_partkey DESC, l_suppkey DESC, l_quantity DESC,
        l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC,
        l_linestatus DESC) AS rn FROM lineitem) WHERE rn = 1
"""
LINE_COLUMNS = [
    "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity",
    "l_extendedprice",
]


def _total(column: str) -> Column:
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def full_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """The second write replaces the rows and the schema."""
    lake = new_lake(spark)
    orders = table(spark, d, "orders")
    lake.write("raw", "orders", orders)
    lake.write("raw", "orders", orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus"))
    return lake.read("raw/orders")


@query("""
SELECT o_orderstatus, count(*) AS n_rows FROM orders WHERE o_orderstatus IN ('F', 'O')
GROUP BY o_orderstatus
""")
def append_rows(spark: SparkSession, d: str) -> DataFrame:
    lake = new_lake(spark)
    orders = table(spark, d, "orders")
    for status in ("F", "O"):
        lake.write("raw", "orders", orders.where(F.col("o_orderstatus") == status), "append")
    return lake.read("raw/orders").groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"))


@query(MERGED_ORDERS)
def merge_by_pk(spark: SparkSession, d: str) -> DataFrame:
    """Merging twice gives the same table as merging once."""
    lake = new_lake(spark)
    lake.write("raw", "orders", table(spark, d, "orders"))
    for _ in range(2):
        lake.write("raw", "orders", repriced(spark, d), "merge", pk="o_orderkey")
    return lake.read("raw/orders")


@query(f"""
SELECT coalesce(o.o_orderkey, r.o_orderkey) AS o_orderkey,
       coalesce(r.o_orderstatus, o.o_orderstatus) AS o_orderstatus,
       coalesce(o.o_totalprice, r.o_totalprice) AS o_totalprice
FROM orders o FULL JOIN ({REPRICED}) r ON o.o_orderkey = r.o_orderkey
""")
def merge_update_columns(spark: SparkSession, d: str) -> DataFrame:
    """Only the status of matched rows is taken; their price stays."""
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    return merge.upsert_columns(
        table(spark, d, "orders").select(*columns),
        repriced(spark, d).select(*columns),
        "o_orderkey",
        ["o_orderstatus"],
    )


@query(f"""
SELECT coalesce(o.o_orderkey, r.o_orderkey) AS o_orderkey,
       coalesce(o.o_custkey, r.o_custkey) AS o_custkey,
       coalesce(r.o_orderstatus, o.o_orderstatus) AS o_orderstatus,
       coalesce(o.o_totalprice, r.o_totalprice) AS o_totalprice
FROM orders o FULL JOIN ({REPRICED}) r ON o.o_orderkey = r.o_orderkey
""")
def merge_columns_in_lake(spark: SparkSession, d: str) -> DataFrame:
    """The same into a lake table, which stores only the rows that change."""
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    lake = new_lake(spark)
    lake.write("raw", "orders", table(spark, d, "orders").select(*columns))
    lake.upsert_columns("raw/orders", repriced(spark, d).select(*columns), "o_orderkey", ["o_orderstatus"])
    return lake.read("raw/orders")


@query(MERGED_ORDERS)
def merge_update_all(spark: SparkSession, d: str) -> DataFrame:
    """Merge of two DataFrames; the batch carries an older copy of its rows as well."""
    old = repriced(spark, d).withColumn("o_totalprice", F.col("o_totalprice") - 1)
    batch = repriced(spark, d).unionByName(old)
    return merge.merge_by_key(table(spark, d, "orders"), batch, "o_orderkey", "o_totalprice")


@query(LATEST_LINE)
def merge_first_run(spark: SparkSession, d: str) -> DataFrame:
    """A merge into a table that does not exist creates it, deduplicated."""
    lake = new_lake(spark)
    lines = table(spark, d, "lineitem")
    lake.write("raw", "lines", lines, "merge", pk=["l_orderkey", "l_linenumber"], order="l_shipdate")
    return lake.read("raw/lines", columns=LINE_COLUMNS)


@query("""
SELECT count(*) AS n_rows, true AS files_bounded FROM lineitem
""")
def batched_write(spark: SparkSession, d: str) -> DataFrame:
    lake = new_lake(spark)
    lake.write("raw", "lines", table(spark, d, "lineitem"), max_records_per_file=5000)
    return lake.data_files("raw/lines").agg(
        F.sum("record_count").alias("n_rows"),
        (F.max("record_count") <= 5000).alias("files_bounded"),
    )


@query("""
SELECT o_orderstatus, count(*) AS n_rows,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
GROUP BY o_orderstatus
""")
def delete_where_in(spark: SparkSession, d: str) -> DataFrame:
    lake = new_lake(spark)
    lake.write("raw", "orders", table(spark, d, "orders"))
    gone = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    lake.delete_where_in("raw/orders", "o_custkey", gone.select(F.col("c_custkey").alias("o_custkey")))
    return lake.read("raw/orders").groupBy("o_orderstatus").agg(
        F.count("*").alias("n_rows"), _total("o_totalprice").alias("total")
    )


USER_CHANGES = """
WITH last AS (
  SELECT user_id, event_type, value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM events) WHERE rn = 1)
SELECT c_custkey AS user_id, 'none' AS event_type, c_acctbal AS value FROM customer
WHERE c_custkey NOT IN (SELECT user_id FROM last)
UNION ALL SELECT user_id, event_type, value FROM last WHERE event_type <> 'error'
"""


def user_base(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"), F.lit("none").alias("event_type"),
        F.col("c_acctbal").alias("value"),
    )


def user_changes(spark: SparkSession, d: str) -> DataFrame:
    """Events as a change feed on users: an error deletes, anything else replaces."""
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    return table(spark, d, "events").select("user_id", "event_type", "value", "ts", "event_id", op.alias("op"))


@query(USER_CHANGES)
def apply_changes(spark: SparkSession, d: str) -> DataFrame:
    return merge.apply_changes(
        user_base(spark, d), user_changes(spark, d), "user_id", ["ts", "event_id"], "op"
    )


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'even' WHEN o_orderkey % 3 = 0 THEN 'third' ELSE o_orderstatus END AS status
FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 5 <> 0
""")
def changes_out_of_order(spark: SparkSession, d: str) -> DataFrame:
    """A batch of sequence 3 comes after one of sequence 9, with a fold between: its changes and
    deletes lose where the key has already seen the later one."""
    lake = new_lake(spark)
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    lake.write("raw", "orders", orders)

    def batch(of: Column, status: str, op: Column, seq: int) -> DataFrame:
        return orders.where(of).select(
            "o_orderkey", F.lit(status).alias("status"), F.lit(seq).alias("seq"), op.alias("op")
        )

    key = F.col("o_orderkey")
    lake.apply_changes("raw/orders", batch(key % 2 == 0, "even", F.lit("upsert"), 9), "o_orderkey", "seq", "op")
    lake.compact("raw/orders")
    late = F.when(key % 5 == 0, "delete").otherwise("upsert")
    lake.apply_changes("raw/orders", batch((key % 3 == 0) | (key % 5 == 0), "third", late, 3), "o_orderkey", "seq", "op")
    return lake.read("raw/orders")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'two' ELSE o_orderstatus END AS status FROM orders
""")
def upsert_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Two source rows for a key change one target row once."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    some = orders.where("o_orderkey % 7 = 0").select("o_orderkey")
    source = some.withColumn("status", F.lit("one")).unionByName(some.withColumn("status", F.lit("two")))
    return merge.upsert_columns(orders, source, "o_orderkey", ["status"])


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS status, CAST(NULL AS DOUBLE) AS amount
FROM orders
UNION ALL SELECT 'L' || l_orderkey || '-' || l_linenumber, NULL, l_extendedprice FROM lineitem
""")
def schema_drift_union(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with differing columns and key types."""
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")
    )
    key = F.concat(F.lit("L"), "l_orderkey", F.lit("-"), "l_linenumber")
    lines = table(spark, d, "lineitem").select(
        key.alias("key"), F.col("l_extendedprice").alias("amount")
    )
    return merge.union_relaxed(orders, lines)


@query("""
SELECT count(*) AS n_rows, count(n_comment) AS n_comments, sum(CAST(k AS BIGINT))::BIGINT AS key_sum FROM (
  SELECT n_nationkey AS k, NULL AS n_comment FROM nation
  UNION ALL SELECT c_custkey, c_name FROM customer)
""")
def schema_drift_append(spark: SparkSession, d: str) -> DataFrame:
    """An append brings a new column and a wider key; old files are read with both."""
    lake = new_lake(spark)
    lake.write("raw", "mixed", table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name"))
    wider = table(spark, d, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_name").alias("n_comment")
    )
    lake.write("raw", "mixed", wider, "append")
    return lake.read("raw/mixed").agg(
        F.count("*").alias("n_rows"), F.count("n_comment").alias("n_comments"), F.sum("k").alias("key_sum")
    )


@query("SELECT role, count(*) AS n_messages FROM conversations GROUP BY role")
def consolidated_merge(spark: SparkSession, d: str) -> DataFrame:
    """Channels share one table: refreshing one leaves its siblings alone."""
    lake = new_lake(spark)
    config = default_config("slack", "messages", "full_refresh", cursor=None)
    rows = table(spark, d, "conversations").withColumn("message_key", F.concat_ws(":", "conv_id", "turn"))
    for role in ("system", "user", "assistant", "user"):
        sync_resource(lake, rows.where(F.col("role") == role), config)
    return lake.read(("raw", config.table)).groupBy("role").agg(F.count("*").alias("n_messages"))


@query(f"""
SELECT 'changed' AS diff, count(*) AS n_rows FROM orders WHERE o_orderdate >= TIMESTAMP '{RECENT}'
UNION ALL
SELECT 'only_right', count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '{RECENT}'
""")
def fabricated_delta(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    recent = F.col("o_orderdate") >= F.lit(RECENT).cast("timestamp_ntz")
    fresh = orders.where(recent).withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    after = merge.fabricate_delta(orders, recent, {"o_totalprice": F.col("o_totalprice") + 1}, fresh)
    return merge.table_diff(orders, after, "o_orderkey").groupBy("diff").agg(F.count("*").alias("n_rows"))


@query("""
SELECT 'raw/lines' AS table_name, 1 AS version, count(*) AS n_rows FROM lineitem
UNION ALL SELECT 'raw/orders', 1, count(*) FROM orders
""")
def commit_two_tables(spark: SparkSession, d: str) -> DataFrame:
    """Two writers at the same time, on different tables of one lake."""
    lake = new_lake(spark)
    inputs = {"lines": table(spark, d, "lineitem"), "orders": table(spark, d, "orders")}
    with ThreadPoolExecutor(2) as pool:
        versions = dict(zip(inputs, pool.map(lambda n: lake.write("raw", n, inputs[n]), inputs)))
    frames = [
        lake.read(("raw", n)).agg(F.count("*").alias("n_rows")).select(
            F.lit(f"raw/{n}").alias("table_name"), F.lit(v.version).alias("version"), "n_rows"
        )
        for n, v in versions.items()
    ]
    return frames[0].unionByName(frames[1])


@query("""
SELECT 'clean/parts' AS table_name, count(*) AS source_rows, count(*) AS target_rows, 'OK' AS status FROM part
UNION ALL SELECT 'raw/orders', count(*), count(*), 'OK' FROM orders
""")
def backfill_verify(spark: SparkSession, d: str) -> DataFrame:
    old, new = new_lake(spark, "old"), new_lake(spark, "new")
    old.write("raw", "orders", table(spark, d, "orders"))
    old.write("clean", "parts", table(spark, d, "part"))
    old.backfill_into(new)
    return old.verify_backfill(new)


@query(f"""
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
       CASE WHEN b.o_orderkey IS NULL THEN 'only_left' WHEN a.o_orderkey IS NULL THEN 'only_right'
            ELSE 'changed' END AS diff
FROM (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW') a
FULL JOIN (SELECT * FROM ({MERGED_ORDERS}) WHERE o_orderpriority <> '1-URGENT') b
  ON a.o_orderkey = b.o_orderkey
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice
   OR a.o_orderstatus <> b.o_orderstatus
""")
def table_diff(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    after = merge.merge_by_key(orders, repriced(spark, d), "o_orderkey")
    return merge.table_diff(
        orders.where("o_orderpriority <> '5-LOW'"),
        after.where("o_orderpriority <> '1-URGENT'"),
        "o_orderkey",
    )


@query(f"""
SELECT o_orderstatus, 1 AS segments, count(*) AS n_rows,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM ({MERGED_ORDERS}) GROUP BY o_orderstatus
""")
def compact_same_rows(spark: SparkSession, d: str) -> DataFrame:
    lake = new_lake(spark)
    lake.write("raw", "orders", table(spark, d, "orders"))
    lake.write("raw", "orders", repriced(spark, d), "merge", pk="o_orderkey")
    version = lake.compact("raw/orders", sort_by="o_orderdate")
    lake.vacuum("raw/orders", keep=1, older_than_seconds=0)
    return (
        lake.read("raw/orders").groupBy("o_orderstatus")
        .agg(F.count("*").alias("n_rows"), _total("o_totalprice").alias("total"))
        .withColumn("segments", F.lit(len(version.segments)))
    )


@query("""
SELECT c_custkey AS id, sha256('pepper' || '  User' || c_custkey || '@Mail.Test ') AS email,
       c_mktsegment AS segment FROM customer
""")
def pii_protect(spark: SparkSession, d: str) -> DataFrame:
    people = raw_customers(spark, d).select("id", "email", "name", "segment")
    return protect(people, {"email": "hash", "name": "drop"}, salt="pepper")


@query("""
WITH daily AS (
  SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT day, event_type, n FROM daily WHERE day < '2024-01-10'
UNION ALL SELECT day, event_type, n + 1 FROM daily WHERE day >= '2024-01-10' AND event_type <> 'view'
""")
def merge_by_day(spark: SparkSession, d: str) -> DataFrame:
    """The key is a day: all rows of the incoming days are replaced."""
    lake = new_lake(spark)
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    daily = table(spark, d, "events").groupBy(day, "event_type").agg(F.count("*").alias("n"))
    lake.write("raw", "daily", daily)
    late = daily.where("day >= '2024-01-10' AND event_type <> 'view'").withColumn("n", F.col("n") + 1)
    lake.write("raw", "daily", late, "merge", pk="day", unique=False)
    return lake.read("raw/daily")


@query("SELECT count(*) AS old_rows, count(*) AS new_rows, 0 AS n_diff FROM orders")
def dual_write(spark: SparkSession, d: str) -> DataFrame:
    """Cut-over: one batch in two lakes, then compared."""
    stores = {"old": new_lake(spark, "old"), "new": new_lake(spark, "new")}
    write_both(table(spark, d, "orders"), stores["old"], stores["new"], "raw", "orders")
    reads = {n: s.read("raw/orders") for n, s in stores.items()}
    diff = merge.table_diff(reads["old"], reads["new"], "o_orderkey")
    return row_counts_of(old_rows=reads["old"], new_rows=reads["new"], n_diff=diff)
