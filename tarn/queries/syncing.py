"""Incremental sync, streaming sync, change feeds, models."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.merge import table_diff
from tarn.plans import clean
from tarn.plans.models import Model, ModelRegistry, has_changes, run_model
from tarn.queries.inputs import RECENT, repriced
from tarn.queries.registry import new_lake, query, row_counts_of, table
from tarn.queries.writes import USER_CHANGES, user_base
from tarn.session import scratch_path
from tarn.streaming.config import ResourceConfig
from tarn.streaming.landed import landed_files, stream_changes
from tarn.streaming.landed import stream_sync as sync_stream
from tarn.streaming.state import RunLog, SyncState, columns_with_cursor
from tarn.streaming.sync import sync_children, sync_resource

ORDERS = ResourceConfig("shop", "orders", "incremental", "o_orderdate", ("o_orderkey",))
EVENTS = ResourceConfig("shop", "events", "incremental", "ts", ("event_id",))
USERS = ResourceConfig("shop", "users", "incremental", "ts", ("user_id",))
LATER = "o_orderdate + INTERVAL '400' DAY"


def later_orders(spark: SparkSession, d: str) -> DataFrame:
    """The source after a change: recent orders repriced and stamped newer, plus new ones."""
    stamp = F.timestamp_add("DAY", F.lit(400), F.col("o_orderdate"))
    changed = repriced(spark, d).withColumn("o_orderdate", stamp)
    orders = table(spark, d, "orders")
    recent = F.col("o_orderdate") >= F.lit(RECENT).cast("timestamp_ntz")
    return orders.where(~recent).unionByName(changed)


LATER_ORDERS = f"""
SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{RECENT}'
UNION ALL
SELECT o_orderkey, o_custkey, 'O', o_totalprice + 1000, {LATER}, o_orderpriority
FROM orders WHERE o_orderdate >= TIMESTAMP '{RECENT}'
UNION ALL
SELECT -1 - o_orderkey, o_custkey, o_orderstatus, o_totalprice, {LATER}, o_orderpriority
FROM orders WHERE o_orderdate >= TIMESTAMP '{RECENT}'
"""


@query("""
SELECT max(o_orderkey) AS raw_mark, max(o_orderkey) AS clean_mark, count(*) AS raw_rows, count(*) AS clean_rows FROM orders
""")
def widened_cursor(spark: SparkSession, d: str) -> DataFrame:
    """A cursor column that widens from 32 to 64 bits: its mark moves on and the model follows."""
    lake = new_lake(spark)
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("seen"), "o_orderstatus")
    model = Model("orders", ["raw/orders"], lambda rows: rows, materialized="incremental", unique_key=["o_orderkey"], cursor="seen")
    first = orders.where("o_orderkey % 2 = 0 AND o_orderkey < 1000").withColumn("seen", F.col("seen").cast("int"))
    lake.write("raw", "orders", first, "merge", pk="o_orderkey", track="seen")
    run_model(lake, model)
    # The rows not yet there, all beyond the mark by a cursor of their own.
    rest = orders.join(first.select("o_orderkey"), "o_orderkey", "left_anti")
    lake.write("raw", "orders", rest.withColumn("seen", F.col("seen") + F.lit(2**40)), "merge", pk="o_orderkey", track="seen")
    run_model(lake, model)
    marks = [lake.mark(source, "seen") - 2**40 for source in ("raw/orders", "clean/orders")]
    counts = row_counts_of(raw_rows=lake.read("raw/orders"), clean_rows=lake.read("clean/orders"))
    return counts.select(F.lit(marks[0]).alias("raw_mark"), F.lit(marks[1]).alias("clean_mark"), "raw_rows", "clean_rows")


@query(LATER_ORDERS)
def sync_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Full load, delta by cursor, and a repeat that finds nothing."""
    lake = new_lake(spark)
    for source in (table(spark, d, "orders"), later_orders(spark, d), later_orders(spark, d)):
        sync_resource(lake, source, ORDERS)
    return lake.read(("raw", ORDERS.table))


@query(f"""
SELECT 'completed' AS status, count(*) AS records FROM orders
UNION ALL SELECT 'completed', 2 * count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '{RECENT}'
UNION ALL SELECT 'skipped', 0
""")
def sync_run_log(spark: SparkSession, d: str) -> DataFrame:
    lake = new_lake(spark)
    for source in (table(spark, d, "orders"), later_orders(spark, d), later_orders(spark, d)):
        sync_resource(lake, source, ORDERS)
    return RunLog(lake).latest().select("status", "records")


@query("""
SELECT 'shop' AS connector, 'events' AS resource, 'timestamp_ntz' AS value_type, max(ts) AS mark FROM events
UNION ALL SELECT 'shop', 'orders', 'timestamp_ntz', max(o_orderdate) FROM orders
""")
def state_table(spark: SparkSession, d: str) -> DataFrame:
    lake = new_lake(spark)
    sync_resource(lake, table(spark, d, "orders"), ORDERS)
    sync_resource(lake, table(spark, d, "events"), EVENTS)
    return SyncState(lake).table().select(
        "connector", "resource", "value_type", F.col("value").cast("timestamp_ntz").alias("mark")
    )


@query("""
SELECT user_id, event_id, event_type, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1
""")
def stream_sync(spark: SparkSession, d: str) -> DataFrame:
    """Landed files merged by key as a stream, run twice from one checkpoint."""
    lake, checkpoint = new_lake(spark), scratch_path(spark, "checkpoint")
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    for _ in range(2):
        sync_stream(lake, landed_files(spark, path, schema), USERS, checkpoint)
    return lake.read(("raw", USERS.table), columns=["user_id", "event_id", "event_type", "ts"])


@query(USER_CHANGES)
def stream_cdc(spark: SparkSession, d: str) -> DataFrame:
    """The change feed of ``apply_changes`` as a stream over a table of users."""
    lake, checkpoint = new_lake(spark), scratch_path(spark, "checkpoint")
    lake.write("raw", "users", user_base(spark, d))
    path = f"{d}/events.parquet"
    stream = landed_files(spark, path, spark.read.parquet(path).schema)
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op")
    feed = stream.select("user_id", "event_type", "value", "ts", "event_id", op)
    stream_changes(lake, feed, "users", "user_id", ["ts", "event_id"], "op", checkpoint)
    return lake.read("raw/users")


def order_model(materialized: str = "incremental") -> Model:
    """Raw orders to clean ones."""

    def build(raw: DataFrame) -> DataFrame:
        return raw.select(
            F.col("o_orderkey").alias("external_id"),
            "o_orderstatus",
            F.col("o_totalprice").alias("amount"),
            F.col("o_orderdate").alias("updated_at"),
        )

    return Model(
        "orders", ["raw/shop__orders"], build, materialized=materialized,
        unique_key=("external_id",), input_cursor="o_orderdate",
    )


CLEAN_ORDERS = f"""
SELECT o_orderkey AS external_id, o_orderstatus, o_totalprice AS amount, o_orderdate AS updated_at
FROM ({LATER_ORDERS})
"""


def _twice(spark: SparkSession, d: str, lake, model: Model) -> list[str]:
    outcomes = []
    for source in (table(spark, d, "orders"), later_orders(spark, d)):
        sync_resource(lake, source, ORDERS)
        outcomes.append(run_model(lake, model))
    return outcomes


@query(CLEAN_ORDERS)
def incremental_model(spark: SparkSession, d: str) -> DataFrame:
    lake = new_lake(spark)
    _twice(spark, d, lake, order_model())
    return lake.read("clean/orders")


@query(f"SELECT 'rebuilt,merged,skipped' AS outcomes, count(*) AS n_rows, false AS changed FROM ({CLEAN_ORDERS})")
def skip_unchanged(spark: SparkSession, d: str) -> DataFrame:
    lake, model = new_lake(spark), order_model()
    outcomes = [*_twice(spark, d, lake, model), run_model(lake, model)]
    changed = has_changes(lake, model)
    return lake.read("clean/orders").agg(F.count("*").alias("n_rows")).select(
        F.lit(",".join(outcomes)).alias("outcomes"), "n_rows", F.lit(changed).alias("changed")
    )


@query(f"SELECT count(*) AS full_rows, count(*) AS incremental_rows, 0 AS n_diff FROM ({CLEAN_ORDERS})")
def incremental_equals_full(spark: SparkSession, d: str) -> DataFrame:
    lake, model = new_lake(spark), order_model()
    _twice(spark, d, lake, model)
    incremental = lake.pin("clean/orders")
    run_model(lake, model, full_refresh=True)
    full = lake.pin("clean/orders")
    diff = table_diff(full, incremental, "external_id")
    return row_counts_of(full_rows=full, incremental_rows=incremental, n_diff=diff)


@query("SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R'")
def always_full_resource(spark: SparkSession, d: str) -> DataFrame:
    """Pairs without a cursor are read whole, so removed pairs vanish."""
    lake = new_lake(spark)
    config = ResourceConfig(
        "shop", "order_parts", "incremental", None, ("l_orderkey", "l_partkey"), supports_incremental=False
    )
    lines = table(spark, d, "lineitem")
    for rows in (lines, lines.where("l_returnflag <> 'R'")):
        sync_resource(lake, rows.select("l_orderkey", "l_partkey").distinct(), config)
    return lake.read(("raw", config.table))


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '{RECENT}')
UNION ALL
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + 1 FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '{RECENT}')
  AND l_returnflag <> 'R'
""")
def child_by_parent(spark: SparkSession, d: str) -> DataFrame:
    """Lines of changed orders are replaced as a group; returned ones are gone at the source."""
    lake = new_lake(spark)
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    lines = table(spark, d, "lineitem")
    orders = table(spark, d, "orders")
    sync_children(lake, orders, lines.select(*columns), "l_orderkey", "o_orderkey", "lines", lines.count() + orders.count())
    recent = orders.where(F.col("o_orderdate") >= F.lit(RECENT).cast("timestamp_ntz"))
    now = lines.where("l_returnflag <> 'R'").withColumn("l_quantity", F.col("l_quantity") + 1)
    sync_children(lake, recent, now.select(*columns), "l_orderkey", "o_orderkey", "lines", now.count() + recent.count())
    return lake.read("raw/lines")


@query("""
SELECT event_type, count(*) AS n_rows, max(ts) AS mark FROM events GROUP BY event_type
""")
def partition_watermark(spark: SparkSession, d: str) -> DataFrame:
    """One cursor per event type: the first load ends at another time for each."""
    lake = new_lake(spark)
    config = ResourceConfig(
        "shop", "typed_events", "incremental", "ts", ("event_id",), partition="event_type"
    )
    events = table(spark, d, "events")
    end = F.timestamp_add("DAY", F.length("event_type"), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    for rows in (events.where(F.col("ts") < end), events):
        sync_resource(lake, rows, config)
    marks = SyncState(lake).partition_marks("shop", "typed_events", "timestamp_ntz")
    counts = lake.read(("raw", config.table)).groupBy("event_type").agg(F.count("*").alias("n_rows"))
    return counts.join(marks, F.col("event_type") == F.col("partition")).select("event_type", "n_rows", "mark")


# --- models -------------------------------------------------------------------------


def shop_models() -> ModelRegistry:
    registry = ModelRegistry()
    registry.add(order_model("table"))

    @registry.model("customers", ["raw/crm__customers"])
    def customers(raw: DataFrame) -> DataFrame:
        return raw.select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"))

    @registry.model("segment_orders", ["clean/order_owners", "clean/customers"])
    def segment_orders(owners: DataFrame, customers: DataFrame) -> DataFrame:
        return owners.join(customers, "customer_id").groupBy("segment").agg(F.count("*").alias("n_orders"))

    @registry.model("order_owners", ["raw/shop__orders"])
    def order_owners(raw: DataFrame) -> DataFrame:
        return raw.select(F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("external_id"))

    return registry


@query("""
SELECT c_mktsegment AS segment, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY c_mktsegment
""")
def models_build(spark: SparkSession, d: str) -> DataFrame:
    """All models in dependency order."""
    lake = new_lake(spark)
    lake.write("raw", "shop__orders", table(spark, d, "orders"))
    lake.write("raw", "crm__customers", table(spark, d, "customer"))
    shop_models().build(lake)
    return lake.read("clean/segment_orders")


@query("""
SELECT c_mktsegment AS segment, count(*) AS n_orders, 'customers,segment_orders' AS rebuilt
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY c_mktsegment
""")
def models_for_connector(spark: SparkSession, d: str) -> DataFrame:
    """After a sync of one connector only the models that depend on it run."""
    lake, registry = new_lake(spark), shop_models()
    lake.write("raw", "shop__orders", table(spark, d, "orders"))
    lake.write("raw", "crm__customers", table(spark, d, "customer"))
    registry.build(lake)
    lake.write("raw", "crm__customers", table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'"))
    outcome = registry.build(lake, registry.models_for("crm"))
    return lake.read("clean/segment_orders").withColumn("rebuilt", F.lit(",".join(sorted(outcome))))


@query("""
SELECT o_orderkey AS external_id, o_orderstatus, sha256(CAST(o_custkey AS VARCHAR)) AS o_custkey,
       o_orderdate AS updated_at FROM orders
""")
def synthesize_clean(spark: SparkSession, d: str) -> DataFrame:
    pii = {"o_custkey": "hash", "o_totalprice": "drop", "o_orderpriority": "drop"}
    return clean.synthesize_clean(table(spark, d, "orders"), ["o_orderkey"], "o_orderdate", pii)


@query("""
SELECT count(*) AS total_rows, 0 AS null_keys,
       (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys,
       count(*) FILTER (WHERE l_returnflag = 'R') AS null_cursors, true AS has_cursor FROM lineitem
""")
def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    broken = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("external_id"),
        F.when(F.col("l_returnflag") != "R", F.col("l_shipdate")).alias("updated_at"),
    )
    return clean.contract_violations(broken)


@query("""
SELECT 'customer' AS table_name, false AS has_cursor, count(*) AS n_rows FROM customer
UNION ALL SELECT 'events', true, count(*) FROM events
UNION ALL SELECT 'orders', false, count(*) FROM orders
""")
def cursor_column_audit(spark: SparkSession, d: str) -> DataFrame:
    """Which tables carry the cursor column."""
    lake = new_lake(spark)
    for name in ("customer", "events", "orders"):
        lake.write("clean", name, table(spark, d, name))
    tables = {n: lake.read(("clean", n)).columns for n in lake.table_names("clean")}
    audit = columns_with_cursor(tables, "ts")
    frames = [
        lake.read(("clean", name)).agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"), F.lit(has).alias("has_cursor"), "n_rows"
        )
        for name, has in audit
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


