"""Versioned tables: modes, snapshots, drift, deletes, concurrency, maintenance."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from tarn.lake.store import CommitConflict, LakeStore, TableNotFound, dual_write
from tarn.session import scratch_path


def orders(spark, first, last, amount, stamp):
    """The merge fixture: padded mixed-case e-mails, text timestamps."""
    i = F.col("id")
    return spark.range(first, last + 1).select(
        i,
        F.concat(F.lit("  USER"), i, F.lit("@Example.com ")).alias("customer_email"),
        F.lit(amount).alias("amount"),
        F.lit(stamp).alias("updated_at"),
    )


FIRST, SECOND = "2024-01-15T10:00:00", "2024-01-16T11:00:00"


def test_overwrite_then_merge_gives_115_rows(spark, lake):
    lake.write("raw", "orders", orders(spark, 1, 100, 10.0, FIRST), "merge", pk="id")
    assert lake.count("raw/orders") == 100
    lake.write("raw", "orders", orders(spark, 96, 115, 99.0, SECOND), "merge", pk="id")
    rows = {r.id: r for r in lake.read("raw/orders").collect()}
    assert len(rows) == 115
    assert rows[100].amount == 99.0 and rows[95].amount == 10.0


def test_merge_is_idempotent_and_needs_a_key(spark, lake):
    for _ in range(3):
        lake.write("raw", "orders", orders(spark, 1, 10, 1.0, FIRST), "merge", pk="id")
    assert lake.count("raw/orders") == 10
    with pytest.raises(ValueError, match="key"):
        lake.write("raw", "orders", orders(spark, 1, 2, 1.0, FIRST), "merge")
    with pytest.raises(ValueError, match="merge key"):
        lake.write("raw", "orders", orders(spark, 1, 2, 1.0, FIRST), "merge", pk="nope")


def test_null_keys_merge_once(spark, lake):
    row = spark.sql("SELECT CAST(NULL AS BIGINT) AS id, 1 AS v")
    for _ in range(2):
        lake.write("raw", "t", row, "merge", pk="id")
    assert lake.count("raw/t") == 1


def test_read_as_of_and_pin_are_immutable(spark, lake):
    lake.write("raw", "orders", orders(spark, 1, 100, 10.0, FIRST))
    pinned = lake.pin("raw/orders")
    lake.write("raw", "orders", orders(spark, 96, 115, 99.0, SECOND), "merge", pk="id")
    lake.write("raw", "orders", orders(spark, 1, 3, 0.0, SECOND))
    assert [lake.read("raw/orders", snapshot=n).count() for n in (1, 2, 3)] == [100, 115, 3]
    assert pinned.count() == 100
    with pytest.raises(TableNotFound):
        lake.read("raw/orders", snapshot=9)


def test_watermark_read_and_missing_cursor(spark, lake):
    lake.write("raw", "orders", orders(spark, 1, 10, 1.0, FIRST))
    lake.write("raw", "orders", orders(spark, 11, 14, 1.0, SECOND), "append")
    assert lake.read("raw/orders", watermark=FIRST).count() == 4
    lake.write("raw", "plain", spark.range(2))
    assert lake.read("raw/plain", watermark=FIRST).count() == 2
    with pytest.raises(ValueError, match="no cursor column"):
        lake.read("raw/plain", watermark=FIRST, on_missing_cursor="error")


def test_watermark_filter_reaches_the_scan(spark, lake):
    import datetime as dt

    df = spark.range(10).select("id", F.timestamp_add("DAY", F.col("id").cast("int"), F.lit("2026-01-01").cast("timestamp_ntz")).alias("updated_at"))
    lake.write("raw", "t", df)
    lake.write("raw", "t", df.where("id < 3"), "merge", pk="id")
    read = lake.read("raw/t", columns=["id"], watermark=dt.datetime(2026, 1, 5))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(updated_at" in plan
    assert read.count() == 5


def test_schema_drift(spark, lake):
    lake.write("raw", "t", spark.sql("SELECT 1 AS id, 'a' AS gone"))
    lake.write("raw", "t", spark.sql("SELECT 2L AS id, 2.5D AS fresh"), "append")
    lake.write("raw", "t", spark.sql("SELECT 'x3' AS id, 1.0D AS fresh"), "append")
    rows = {r.id: r for r in lake.read("raw/t").collect()}
    assert set(rows) == {"1", "2", "x3"}
    assert rows["1"].gone == "a" and rows["1"].fresh is None and rows["2"].fresh == 2.5
    lake.write("raw", "t", spark.sql("SELECT 1 AS only"))
    assert lake.read("raw/t").columns == ["only"]


def test_delete_then_reinsert(spark, lake):
    lake.write("raw", "orders", orders(spark, 1, 10, 1.0, FIRST))
    lake.delete_where_in("raw/orders", "id", spark.range(3, 6))
    assert lake.count("raw/orders") == 7
    lake.write("raw", "orders", orders(spark, 4, 4, 2.0, SECOND), "append")
    rows = {r.id: r.amount for r in lake.read("raw/orders").collect()}
    assert len(rows) == 8 and rows[4] == 2.0 and 3 not in rows


def test_apply_changes_last_change_wins(spark, lake):
    lake.write("raw", "t", spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b') AS t(id, v)"))
    feed = spark.sql(
        "SELECT * FROM VALUES (1, 'x', 1, 'upsert'), (1, NULL, 2, 'delete'), (2, 'y', 1, 'delete'),"
        "(2, 'z', 5, 'upsert'), (3, 'n', 1, 'upsert') AS t(id, v, seq, op)"
    )
    lake.apply_changes("raw/t", feed, "id", "seq", "op")
    assert sorted(map(tuple, lake.read("raw/t").collect())) == [(2, "z"), (3, "n")]
    assert lake.read("raw/t").columns == ["id", "v"]


def test_two_writers_on_one_table_both_commit(spark, lake):
    errors = []

    def write(first):
        try:
            lake.write("raw", "t", spark.range(first, first + 10), "append")
        except CommitConflict as error:
            errors.append(error)

    threads = [threading.Thread(target=write, args=(n * 10,)) for n in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and lake.count("raw/t") == 40
    assert lake.current_version("raw/t") == 4


def test_publish_is_exclusive(lake):
    path = f"{lake.root}/raw/v1.json"
    assert lake._files.create_exclusive(path, "one") is True
    assert lake._files.create_exclusive(path, "two") is False
    assert lake._files.read_text(path) == "one"


def test_compact_and_vacuum_keep_rows(spark, lake):
    lake.write("raw", "orders", orders(spark, 1, 100, 10.0, FIRST), track="updated_at")
    for n in range(4):
        lake.write("raw", "orders", orders(spark, 90, 100 + n, float(n), SECOND), "merge", pk="id", track="updated_at")
    before = sorted(map(tuple, lake.read("raw/orders").collect()))
    lake.compact("raw/orders")
    assert sorted(map(tuple, lake.read("raw/orders").collect())) == before
    assert lake.mark("raw/orders", "updated_at") == SECOND
    dropped = lake.vacuum("raw/orders", keep=1, older_than_seconds=0)
    assert len(dropped) == 5
    assert sorted(map(tuple, lake.read("raw/orders").collect())) == before
    assert lake.vacuum("raw/orders", keep=1, older_than_seconds=3600) == []


def test_vacuum_spares_young_files(spark, lake):
    lake.write("raw", "t", spark.range(3))
    lake.write("raw", "t", spark.range(4))
    assert lake.vacuum("raw/t", keep=1) == []


def test_merge_by_group_replaces_whole_days(spark, lake):
    lake.write("raw", "d", spark.sql("SELECT * FROM VALUES ('a', 1), ('a', 2), ('b', 3) AS t(day, n)"))
    lake.write("raw", "d", spark.sql("SELECT * FROM VALUES ('a', 9), ('a', 9) AS t(day, n)"), "merge", pk="day", unique=False)
    assert sorted(map(tuple, lake.read("raw/d").collect())) == [("a", 9), ("a", 9), ("b", 3)]


def test_repeated_batch_is_a_no_op(spark, lake):
    first = lake.write("raw", "t", spark.range(3), "append", batch=("s", 0))
    again = lake.write("raw", "t", spark.range(3), "append", batch=("s", 0))
    assert first is not None and again is None and lake.count("raw/t") == 3
    assert lake.last_batch("raw/t", "s") == 0


def test_marks_do_not_move_back(spark, lake):
    lake.write("raw", "t", spark.range(10), "append", track="id")
    lake.write("raw", "t", spark.range(3), "append", track="id")
    assert lake.mark("raw/t", "id") == 9
    lake.write("raw", "t", spark.range(3), "overwrite", track="id")
    assert lake.mark("raw/t", "id") == 2


def test_backfill_and_divergence(spark, lake):
    other = LakeStore(spark, scratch_path(spark, "other")).bootstrap()
    lake.write("raw", "a", spark.range(5))
    lake.write("clean", "b", spark.range(7))
    lake.backfill_into(other)
    report = lake.verify_backfill(other)
    assert {r.status for r in report.collect()} == {"OK"}
    other.write("raw", "a", spark.range(1), "append")
    states = {r.table_name: r.status for r in lake.verify_backfill(other).collect()}
    assert states == {"raw/a": "DIVERGES", "clean/b": "OK"}


def test_dual_write_lands_the_same_rows(spark, lake):
    other = LakeStore(spark, scratch_path(spark, "other")).bootstrap()
    rows = spark.range(20).select("id", F.expr("uuid()").alias("row_id"))
    dual_write(rows, lake, other, "raw", "t", mode="overwrite")
    left = {r.row_id for r in lake.read("raw/t").collect()}
    assert left == {r.row_id for r in other.read("raw/t").collect()}


def test_catalog_questions(spark, lake):
    lake.write("raw", "t", spark.range(5), max_records_per_file=2)
    assert [tuple(r) for r in lake.list_tables("raw").collect()] == [("raw", "t", 1)]
    assert lake.table_exists("raw/t") and not lake.table_exists("raw/u")
    assert [tuple(r) for r in lake.get_columns("raw/t").collect()] == [(1, "id", "bigint")]
    files = lake.data_files("raw/t").collect()
    assert sum(f.record_count for f in files) == 5 and max(f.record_count for f in files) <= 2
    per_file = lake.column_stats("raw/t", per_file=True)
    assert per_file.count() == len(files)
    with pytest.raises(TableNotFound):
        lake.read("raw/u")
    with pytest.raises(ValueError, match="layer"):
        lake.write("bronze", "t", spark.range(1))


def test_federated_sources_read_like_tables(spark, lake):
    lake.attach_federation("numbers", lambda: spark.range(6))
    lake.write("clean", "numbers", spark.range(6))
    assert lake.read(("fed", "numbers")).collect() == lake.read(("clean", "numbers")).orderBy("id").collect()
    assert lake.sql("SELECT count(*) AS n FROM fed_numbers JOIN clean_numbers USING (id)").first().n == 6


def test_column_merge_stores_only_the_delta(spark, lake):
    lake.write("raw", "t", spark.range(100).select("id", F.lit("a").alias("name"), F.lit(1.0).alias("v")))
    source = spark.sql("SELECT * FROM VALUES (5L, 'b', 9.0D), (200L, 'n', 3.0D) AS t(id, name, v)")
    version = lake.upsert_columns("raw/t", source, "id", ["v"])
    assert version.changed_rows == 2
    rows = {r.id: (r.name, r.v) for r in lake.read("raw/t").collect()}
    assert len(rows) == 101 and rows[5] == ("a", 9.0) and rows[200] == ("n", 3.0) and rows[6] == ("a", 1.0)


def test_duplicate_source_keys_do_not_multiply_rows(spark, lake):
    lake.write("raw", "t", spark.sql("SELECT 1 AS id, 0 AS a"))
    lake.upsert_columns("raw/t", spark.sql("SELECT * FROM VALUES (1, 5), (1, 9) AS t(id, a)"), "id", ["a"])
    assert [tuple(r) for r in lake.read("raw/t").collect()] == [(1, 9)]


def test_marks_move_on_when_the_cursor_widens(spark, lake):
    lake.write("raw", "t", spark.sql("SELECT 1 AS id, 5 AS c"), "merge", pk="id", track="c")
    lake.write("raw", "t", spark.sql("SELECT 2 AS id, 50L AS c"), "merge", pk="id", track="c")
    assert lake.mark("raw/t", "c") == 50
    lake.write("raw", "t", spark.sql("SELECT 3 AS id, 7 AS c"), "merge", pk="id", track="c")
    assert lake.mark("raw/t", "c") == 50
    lake.write("raw", "d", spark.sql("SELECT 1 AS id, DATE '2026-01-02' AS c"), "merge", pk="id", track="c")
    lake.write("raw", "d", spark.sql("SELECT 2 AS id, TIMESTAMP_NTZ '2026-01-03 04:00:00' AS c"), "merge", pk="id", track="c")
    assert lake.mark("raw/d", "c") == dt.datetime(2026, 1, 3, 4)


def test_late_changes_lose_also_after_a_fold(spark, lake):
    def feed(*rows):
        values = ", ".join(f"({i}, {v}, {s}, '{op}')" for i, v, s, op in rows)
        lake.apply_changes("raw/t", spark.sql(f"SELECT * FROM VALUES {values} AS t(id, v, seq, op)"), "id", "seq", "op")

    lake.write("raw", "t", spark.sql("SELECT * FROM VALUES (1, 0), (2, 0), (3, 0) AS t(id, v)"))
    feed((1, 9, 9, "upsert"), (2, 0, 8, "delete"))
    feed((1, 3, 3, "upsert"), (2, 5, 4, "upsert"), (3, 7, 1, "upsert"))
    assert {tuple(r) for r in lake.read("raw/t").collect()} == {(1, 9), (3, 7)}
    lake.compact("raw/t")
    feed((1, 4, 4, "delete"), (2, 6, 6, "upsert"), (3, 8, 2, "upsert"))
    assert {tuple(r) for r in lake.read("raw/t").collect()} == {(1, 9), (3, 8)}
    feed((2, 1, 10, "upsert"))
    assert {tuple(r) for r in lake.read("raw/t").collect()} == {(1, 9), (2, 1), (3, 8)}
    assert lake.read("raw/t").columns == lake.schema_of("raw/t").names == ["id", "v"]


def test_small_commits_fold_without_the_base(spark, lake):
    lake.fold_segments = 3
    lake.write("raw", "t", spark.range(1000).select("id", F.lit(0).alias("v")))
    for i in range(8):
        lake.write("raw", "t", spark.sql(f"SELECT {i}L AS id, {i + 1} AS v"), "merge", pk="id")
        if lake.needs_compaction("raw/t"):
            version = lake.fold("raw/t")
            assert version.operation == "fold" and version.segments[0].rows == 1000
    assert {r.id: r.v for r in lake.read("raw/t").where("v > 0").collect()} == {i: i + 1 for i in range(8)}
    lake.delete_where_in("raw/t", "id", spark.sql("SELECT 0L AS id"))
    lake.delete_where_in("raw/t", "id", spark.sql("SELECT 1L AS id"))
    lake.fold("raw/t")
    assert lake.count("raw/t") == 998


def test_clashing_column_merges_see_each_other(spark, lake):
    lake.write("raw", "t", spark.sql("SELECT 1 AS id, 0 AS a, 0 AS b"))

    def update(column):
        lake.upsert_columns("raw/t", spark.sql("SELECT 1 AS id, 7 AS a, 7 AS b"), "id", [column])

    threads = [threading.Thread(target=update, args=(c,)) for c in ("a", "b")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert tuple(lake.read("raw/t").first()) == (1, 7, 7)


def test_rows_without_null_keys_stay_where_the_join_that_hides_older_ones_put_them(spark, lake):
    from tarn.operators.merge import keep_latest

    lake.write("raw", "t", spark.range(100).withColumn("v", F.lit(0)))
    lake.write("raw", "t", spark.range(10).withColumn("v", F.lit(1)), "merge", pk="id")
    lake.delete_where_in("raw/t", "id", spark.range(5, 7))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        latest = keep_latest(lake.read("raw/t"), "id")
        plan = latest._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(id") == 1 and "Exchange hashpartitioning(coalesce" not in plan
        assert {(r.id, r.v) for r in latest.collect()} == {(i, int(i < 10)) for i in range(100) if i not in (5, 6)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("counted", [True, False])
def test_null_keys_hide_null_keys_also_where_nobody_counted_them(spark, lake, monkeypatch, counted):
    if not counted:  # a table from before they were counted
        stage = lake._stage
        monkeypatch.setattr(lake, "_stage", lambda *a, **b: ((found := stage(*a, **b))[0].__setattr__("null_keys", None), found)[1])
    shape = "a int, b string, v int"
    lake.write("raw", "t", spark.createDataFrame([(1, "x", 0), (1, None, 0), (None, None, 0), (2, "y", 0)], shape))
    lake.write("raw", "t", spark.createDataFrame([(1, None, 1), (2, "y", 1)], shape), "merge", pk=["a", "b"])
    assert [s.null_keys for s in lake._require("raw", "t").segments] == [None, 1 if counted else None]
    assert sorted(map(str, lake.read("raw/t").collect())) == sorted(map(str, spark.createDataFrame([(1, "x", 0), (1, None, 1), (None, None, 0), (2, "y", 1)], shape).collect()))
    lake.delete_where_in("raw/t", ["a", "b"], spark.createDataFrame([(None, None), (1, "x")], "a int, b string"))
    assert {tuple(r) for r in lake.read("raw/t").collect()} == {(1, None, 1), (2, "y", 1)}
    derived = lake.read_derived("raw/t", F.concat_ws("/", "a", "v").alias("av"))
    assert sorted(r.av for r in derived.collect()) == ["1/1", "2/1"] and derived.columns == ["av"]


def test_derived_columns_travel_instead_of_their_rows(spark, lake):
    from tarn.functions.ids import uuid5

    rows = spark.range(50).select(uuid5(F.col("id").cast("string")).alias("k"), F.repeat(F.lit("x"), 1000).alias("wide"), F.lit(0).alias("v"))
    lake.write("raw", "t", rows)
    lake.write("raw", "t", rows.limit(20).withColumn("v", F.lit(1)), "merge", pk="k")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = lake.read_derived("raw/t", F.length("wide").alias("n"), "v")
        join = sizes._jdf.queryExecution().optimizedPlan().toString().partition("Join LeftAnti")
        assert "length(wide" in join[2] and "length(wide" not in join[0]
        assert sorted(map(tuple, sizes.collect())) == [(1000, 0)] * 30 + [(1000, 1)] * 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_packed_texts_are_told_apart_and_come_back(spark):
    from tarn.functions.ids import packed_text, unpacked_text

    known = "4cd605e7-afa2-5360-b5b9-c5e9fb5c76f4"
    texts = [known, known.upper(), f"{known}\n", known[:-1], f"g{known[1:]}", "", "x" * 14, "x" * 15, "x" * 15 + "\1", "x" * 15 + "\2", "x" * 16, "\2\2", "é" * 18, None]
    packed = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", packed_text("t"))
    found = packed.withColumn("u", unpacked_text("p")).collect()
    assert all(r.t == r.u for r in found) and len({bytes(r.p) for r in found if r.p is not None}) == len(texts) - 1
    assert [len(r.p) for r in found if r.t == known] == [16]
