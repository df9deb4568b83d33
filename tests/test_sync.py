"""Sync engine, state, run log, models, streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarn.operators.merge import fabricate_delta, table_diff
from tarn.plans import clean
from tarn.plans.models import Model, ModelRegistry, has_changes, run_model
from tarn.session import scratch_path
from tarn.sources.generate import gen_customers
from tarn.streaming.config import CONNECTOR_KEYS, ResourceConfig, default_config, derive_mode
from tarn.streaming.landed import landed_files, stream_changes, stream_sync
from tarn.streaming.state import RunLog, SyncState, WatermarkMovedBack
from tarn.streaming.sync import sync_children, sync_resource

CUSTOMERS = ResourceConfig("crm", "customers", "incremental", "updated_at", ("id",))


def customers(spark, n=1000):
    return gen_customers(spark, n)


def with_delta(spark, n=1000):
    """One in a hundred updated, as many new, all newer than the first load."""
    later = F.lit("2026-06-01 00:00:00").cast("timestamp_ntz")
    few = n // 100
    base = customers(spark, n)
    fresh = customers(spark, few).select(
        (F.col("id") + 5_000_000).alias("id"), F.concat(F.lit("new"), "id", F.lit("@x.com")).alias("email"),
        "name", F.lit(5.0).alias("balance"), F.lit("Sg1").alias("segment"), later.alias("updated_at"),
    )
    return fabricate_delta(base, F.col("id") < few, {"balance": F.col("balance") + 1, "updated_at": later}, fresh)


def model(**options):
    def build(raw):
        return raw.select(
            F.col("id").alias("external_id"), F.lower(F.trim("email")).alias("email"),
            F.trim("name").alias("full_name"), "balance", "segment", "updated_at",
        )

    return Model("customers", ["raw/crm__customers"], build, materialized="incremental", unique_key=("external_id",), **options)


def test_incremental_equals_full_and_skips(spark, lake):
    assert sync_resource(lake, customers(spark), CUSTOMERS).records == 1000
    assert run_model(lake, model()) == "rebuilt"
    second = sync_resource(lake, with_delta(spark), CUSTOMERS)
    assert second.records == 20 and second.watermark == dt.datetime(2026, 6, 1)
    assert has_changes(lake, model())
    assert run_model(lake, model()) == "merged"
    assert lake.count("clean/customers") == 1010
    merged = lake.pin("clean/customers")
    assert not has_changes(lake, model())
    assert run_model(lake, model()) == "skipped"
    assert sync_resource(lake, with_delta(spark), CUSTOMERS).status == "skipped"
    assert run_model(lake, model(), full_refresh=True) == "rebuilt"
    assert table_diff(lake.read("clean/customers"), merged, "external_id").isEmpty()
    clean.check_contract(lake.read("clean/customers"))


def test_a_failed_run_moves_nothing_and_is_logged(spark, lake):
    sync_resource(lake, customers(spark, 100), CUSTOMERS)
    mark = SyncState(lake).get("crm", "customers", "updated_at")
    broken = with_delta(spark, 100).withColumn("balance", F.raise_error(F.lit("source went away")).cast("double"))
    with pytest.raises(Exception, match="source went away"):
        sync_resource(lake, broken, CUSTOMERS)
    assert SyncState(lake).get("crm", "customers", "updated_at") == mark
    assert lake.current_version("raw/crm__customers") == 1
    states = [r.status for r in RunLog(lake).latest().orderBy("at").collect()]
    assert states == ["completed", "failed"]
    assert sync_resource(lake, with_delta(spark, 100), CUSTOMERS).status == "completed"


def test_marks_keep_their_type_and_direction(spark, lake):
    sync_resource(lake, spark.sql("SELECT 'a' AS id, '0010' AS seq"), ResourceConfig("x", "t", "incremental", "seq", ("id",)))
    state = SyncState(lake)
    assert state.get("x", "t", "seq") == "0010"
    state.advance("x", "t", "seq", "0020")
    assert state.get("x", "t", "seq") == "0020"
    with pytest.raises(WatermarkMovedBack):
        state.advance("x", "t", "seq", "0001")
    assert [tuple(r) for r in state.table().collect()] == [("x", "t", "seq", "0020", "string")]


def test_lookback_rereads_late_rows(spark, lake):
    config = ResourceConfig("crm", "customers", "incremental", "updated_at", ("id",), lookback=dt.timedelta(days=3))
    sync_resource(lake, customers(spark, 100), config)
    late = customers(spark, 1).select((F.col("id") + 777).alias("id"), "email", "name", "balance", "segment",
                                      F.lit("2026-04-08 00:00:00").cast("timestamp_ntz").alias("updated_at"))
    sync_resource(lake, customers(spark, 100).unionByName(late), config)
    assert lake.count("raw/crm__customers") == 101


def test_mode_derivation():
    columns = ["id", "updated_at"]
    assert derive_mode(ResourceConfig("a", "b", "incremental", "updated_at", ("id",)), columns) == "merge"
    assert derive_mode(ResourceConfig("a", "b", "incremental", None, ("id",)), columns) == "overwrite"
    assert derive_mode(ResourceConfig("a", "b", "full_refresh", "updated_at", ("id",)), columns) == "overwrite"
    with pytest.raises(ValueError, match="lacks"):
        derive_mode(ResourceConfig("a", "b", "incremental", "modified", ("id",)), columns)
    assert derive_mode(default_config("hubspot", "deal_associations", pk=("id",)), ["id"]) == "overwrite"
    assert derive_mode(default_config("notion", "pages", "full_refresh"), ["id", "last_edited_time"]) == "merge"


def test_connector_registry():
    assert len(CONNECTOR_KEYS) == 17
    assert default_config("jira", "users").pk == ("account_id",)
    assert default_config("asaas", "transfers").cursor == "transferDate"
    assert not default_config("google_analytics", "report").unique
    assert not default_config("zendesk", "comments").supports_incremental


def test_partitions_advance_alone(spark, lake):
    config = ResourceConfig("drive", "files", "incremental", "n", ("id",), partition="drive")
    first = spark.sql("SELECT * FROM VALUES (1, 'a', 10), (2, 'b', 3) AS t(id, drive, n)")
    second = spark.sql("SELECT * FROM VALUES (1, 'a', 10), (2, 'b', 3), (3, 'a', 9), (4, 'b', 4), (5, 'c', 1) AS t(id, drive, n)")
    sync_resource(lake, first, config)
    assert sync_resource(lake, second, config).records == 2
    assert sorted(r.id for r in lake.read("raw/drive__files").collect()) == [1, 2, 4, 5]
    marks = {r.partition: r.mark for r in SyncState(lake).partition_marks("drive", "files", "int").collect()}
    assert marks == {"a": 10, "b": 4, "c": 1}
    assert sync_resource(lake, second, config).status == "skipped"


def test_children_of_changed_parents_are_replaced(spark, lake):
    children = spark.sql("SELECT * FROM VALUES (1, 'c1'), (1, 'c2'), (2, 'c3') AS t(issue, body)")
    sync_children(lake, spark.sql("SELECT * FROM VALUES (1), (2) AS t(id)"), children, "issue", "id", "comments")
    gone = spark.sql("SELECT * FROM VALUES (2, 'c3') AS t(issue, body)")
    sync_children(lake, spark.sql("SELECT 1 AS id"), gone, "issue", "id", "comments")
    assert [tuple(r) for r in lake.read("raw/comments").collect()] == [(2, "c3")]


def test_build_runs_in_order_and_selects_by_connector(spark, lake):
    registry = ModelRegistry()
    registry.add(Model("b", ["clean/a"], lambda a: a.selectExpr("id + 1 AS id")))
    registry.add(Model("a", ["raw/pg__t"], lambda t: t))
    registry.add(Model("c", ["raw/other__t"], lambda t: t))
    assert registry.order().index("a") < registry.order().index("b")
    assert registry.models_for("pg") == ["a", "b"]
    lake.write("raw", "pg__t", spark.range(3))
    lake.write("raw", "other__t", spark.range(0))
    assert registry.build(lake) == {"a": "rebuilt", "b": "rebuilt", "c": "skipped"}
    with pytest.raises(ValueError, match="unique_key"):
        registry.add(Model("d", ["raw/pg__t"], lambda t: t, materialized="incremental"))


def test_models_follow_their_other_inputs_and_wait(spark, lake):
    rows = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ '2026-01-01'), (2, TIMESTAMP_NTZ '2026-01-02') AS t(id, updated_at)")
    tags = spark.sql("SELECT 1 AS id, 'old' AS tag")
    lake.write("raw", "a", rows, "merge", pk="id", track="updated_at")
    lake.write("enrichment", "b", tags)
    done = []
    model = Model(
        "m", ["raw/a", "enrichment/b"], lambda a, b: a.join(b, "id", "left"), materialized="incremental",
        unique_key=["id"], ready=lambda _: bool(done),
    )
    assert run_model(lake, model) == "waiting" and not lake.table_exists("clean/m")
    done.append(True)
    assert [run_model(lake, model) for _ in range(2)] == ["rebuilt", "skipped"] and not has_changes(lake, model)
    lake.write("enrichment", "b", tags.withColumn("tag", F.lit("new")))
    assert has_changes(lake, model) and run_model(lake, model) == "merged"
    assert {r.id: r.tag for r in lake.read("clean/m").collect()} == {1: "new", 2: None}
    assert run_model(lake, model) == "skipped"


def test_two_sources_unify_to_eight_rows(spark, lake):
    def source(name, first):
        return spark.sql(f"SELECT id, concat('  P', id + {first}, '@X.com') AS email FROM range(1, 5)")

    unified = clean.unify_sources(
        {"postgres": source("postgres", 0), "mongodb": source("mongodb", 100)},
        {"postgres": "id", "mongodb": "id"},
        {"postgres": {"email": "email"}, "mongodb": {"email": "email"}},
    )
    assert unified.count() == 8
    assert {r.source: r["count"] for r in unified.groupBy("source").count().collect()} == {"postgres": 4, "mongodb": 4}
    assert unified.where("external_id = 'postgres:1'").first().email == "p1@x.com"


def test_contract_check(spark):
    with pytest.raises(ValueError, match="repeated_keys"):
        clean.check_contract(spark.sql("SELECT * FROM VALUES (1, 1), (1, 2) AS t(external_id, updated_at)"))
    with pytest.raises(ValueError, match="no cursor column"):
        clean.check_contract(spark.sql("SELECT 1 AS external_id"))


def test_landed_files_are_merged_once(spark, lake):
    folder, checkpoint = scratch_path(spark, "landing"), scratch_path(spark, "checkpoint")
    rows = customers(spark, 40)
    for part in (rows.where("id < 20"), rows.where("id >= 15")):
        part.write.mode("append").parquet(folder)
        stream_sync(lake, landed_files(spark, folder, rows.schema, max_files=3), CUSTOMERS, checkpoint)
    assert lake.count("raw/crm__customers") == 40
    version = lake.current_version("raw/crm__customers")
    stream_sync(lake, landed_files(spark, folder, rows.schema), CUSTOMERS, checkpoint)
    assert lake.current_version("raw/crm__customers") == version
    assert SyncState(lake).get("crm", "customers", "updated_at") == dt.datetime(2026, 2, 9)


def test_replayed_stream_changes_nothing(spark, lake):
    """A lost checkpoint replays its batches; the table has seen their ids."""
    folder = scratch_path(spark, "landing")
    feed = spark.sql("SELECT * FROM VALUES (1, 'a', 1, 'upsert'), (2, 'b', 2, 'upsert'), (1, NULL, 3, 'delete') AS t(id, v, seq, op)")
    feed.coalesce(1).write.parquet(folder)
    for _ in range(2):
        stream = landed_files(spark, folder, feed.schema)
        stream_changes(lake, stream, "t", "id", "seq", "op", scratch_path(spark, "checkpoint"))
    assert [r.id for r in lake.read("raw/t").collect()] == [2]
    assert lake.current_version("raw/t") == 1


def test_run_log_folds_into_a_table(spark, lake):
    log = RunLog(lake)
    run = log.start("a", "b")
    log.finish(run, "a", "b", "completed", 3)
    log.fold(at_least=2)
    assert log.table().count() == 2 and lake.table_exists("state/sync_runs")
    assert log.latest().first().records == 3


def test_consolidated_tables_read_every_channel(spark, lake):
    config = ResourceConfig("chat", "messages", "incremental", "n", ("id",), consolidated=True)
    late = spark.sql("SELECT * FROM VALUES (1, 'a', 10) AS t(id, channel, n)")
    early = spark.sql("SELECT * FROM VALUES (2, 'b', 3) AS t(id, channel, n)")
    sync_resource(lake, late, config)
    sync_resource(lake, early, config)
    assert lake.count("raw/chat__messages") == 2


def test_rows_can_be_stamped(spark, lake):
    config = ResourceConfig("x", "t", stamp=True)
    sync_resource(lake, spark.range(3), config)
    rows = lake.read("raw/x__t").collect()
    assert len({r._row_id for r in rows}) == 3 and all(r._loaded_at for r in rows)


def test_children_are_dealt_by_their_rows(spark, monkeypatch):
    from tarn.streaming.sync import sync_children

    class Taken:
        def write(self, layer, table, rows, *args, **options):
            self.rows = rows

    monkeypatch.setattr("tarn.session.ROWS_A_TASK", 10)
    lake = Taken()
    children = spark.range(90).selectExpr("id % 10 AS parent", "id AS child")
    sync_children(lake, spark.range(9).toDF("key"), children, "parent", "key", "kids", 99)
    assert lake.rows.where("NOT _deleted").count() == 81 and lake.rows.where("_deleted").count() == 9
    assert lake.rows.rdd.getNumPartitions() >= 10
