"""Tables by key, stateful change feeds, and the session's scratch folder."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tarn.lake.keyed import BUCKET, KeyedTable, Rewrite, buckets_for
from tarn.session import scratch_path
from tarn.streaming.feeds import stream_into_keyed
from tarn.streaming.landed import landed_files

SCHEMA = "id bigint, v string, at int"


def keyed(spark, rows, buckets=8):
    return KeyedTable.create(spark.createDataFrame(rows, SCHEMA), scratch_path(spark, "keyed"), "id", buckets, "at")


def content(table):
    return sorted((tuple(r) for r in table.rows().collect()), key=repr)


def files(table):
    """Files and their times by bucket."""
    top = table.path.removeprefix("file://")
    return {
        folder: sorted((f, os.path.getmtime(f"{top}/{folder}/{f}")) for f in os.listdir(f"{top}/{folder}"))
        for folder in os.listdir(top) if folder.startswith(BUCKET)
    }


def test_buckets_follow_the_size():
    assert [buckets_for(n, 100) for n in (0, 100, 101, 800, 801)] == [1, 1, 2, 8, 16]


def test_merge_and_delete_touch_only_the_buckets_of_their_keys(spark):
    table = keyed(spark, [(i, "old", 0) for i in range(200)] + [(7, "older", -1), (None, "nobody", 0)])
    before = files(table)
    batch = spark.createDataFrame([(3, "new", 2), (3, "newest", 3), (500, "added", 1), (None, "somebody", 1)], SCHEMA)
    touched = table.touched(batch)
    done = table.merge(batch, "at")
    assert done == Rewrite(len(touched), 0, 8) and len(touched) < 4
    after = files(table)
    assert {f"{BUCKET}={b}" for b in touched} == {k for k in after if after[k] != before.get(k)}
    expected = [(i, "old", 0) for i in range(200) if i != 3] + [(3, "newest", 3), (500, "added", 1), (None, "somebody", 1)]
    assert content(table) == sorted(expected, key=repr)
    table.merge(batch, "at")
    assert content(table) == sorted(expected, key=repr)
    table.delete(spark.createDataFrame([(3,), (4,), (10_000,)], "id bigint"))
    assert {r[0] for r in content(table)} == {None, 500, *range(200)} - {3, 4}


def test_a_bucket_that_loses_all_rows_loses_its_folder(spark):
    table = keyed(spark, [(i, "x", 0) for i in range(40)])
    last = table.touched(spark.createDataFrame([(11,)], "id bigint"))
    gone = table.read(last).select("id")
    assert table.delete(gone) == Rewrite(1, 1, 8)
    assert f"{BUCKET}={last[0]}" not in files(table)
    assert table.read(last).count() == 0 and table.rows().count() < 40
    assert table.delete(spark.createDataFrame([], "id bigint")) == Rewrite(0, 0, 8)
    table.merge(spark.createDataFrame([(11, "back", 0)], SCHEMA))
    assert (11, "back", 0) in content(table)


def test_plans_read_the_touched_folders_only(spark, capsys):
    table = keyed(spark, [(i, "x", 0) for i in range(40)])
    keys = spark.createDataFrame([(1,), (2,)], "id bigint")
    table.lookup(keys).explain("formatted")
    plan = capsys.readouterr().out
    assert f"PartitionFilters: [{BUCKET}" in plan.replace("isnotnull(", "").replace("#", " ") or "PartitionFilters: [bucket" in plan
    table.rows().explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and "Exchange" not in plan
    assert sorted(r[0] for r in table.lookup(keys).collect()) == [1, 2]


def test_rebucket_and_refusals(spark):
    table = keyed(spark, [(i, "x", 0) for i in range(40)])
    assert content(table.rebucket(scratch_path(spark, "more"), 16)) == content(table)
    empty = keyed(spark, [])
    assert content(empty) == [] and empty.merge(spark.createDataFrame([(1, "a", 1)], SCHEMA)).rewritten == 1
    with pytest.raises(ValueError, match="not in the table"):
        table.merge(spark.createDataFrame([(1, 2)], "id bigint, other int"))
    with pytest.raises(ValueError, match="may not be called"):
        KeyedTable.create(spark.range(3).withColumn(BUCKET, F.lit(1)), scratch_path(spark, "bad"), "id", 2)


def test_a_feed_keeps_what_a_key_has_seen(spark):
    table = keyed(spark, [(1, "base", 0), (2, "base", 0), (9, "base", 0)])
    landed, checkpoint = scratch_path(spark, "landed"), scratch_path(spark, "feed")
    schema = "id bigint, v string, at int, seq bigint, op string"

    def land(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landed)
        stream = landed_files(spark, landed, spark.createDataFrame([], schema).schema, max_files=1)
        return stream_into_keyed(table, stream, "seq", "op", checkpoint, slots=2)

    done = land((1, "five", 1, 5, "upsert"), (1, "four", 1, 4, "upsert"), (2, None, None, 7, "delete"), (None, "none", 1, 1, "upsert"))
    assert [n for n, _ in done] == [3]
    assert content(table) == sorted([(1, "five", 1), (9, "base", 0), (None, "none", 1)], key=repr)
    # Late and equal changes are not accepted, after another start of the stream as well.
    done = land((1, "late", 1, 3, "delete"), (2, "late", 1, 6, "upsert"), (1, "same", 1, 5, "upsert"), (3, "fresh", 1, None, "upsert"))
    assert [n for n, _ in done] == [1]
    assert content(table) == sorted([(1, "five", 1), (3, "fresh", 1), (9, "base", 0), (None, "none", 1)], key=repr)
    done = land((2, "back", 1, 8, "upsert"), (9, None, None, 1, "delete"))
    assert [n for n, _ in done] == [2]
    assert content(table) == sorted([(1, "five", 1), (2, "back", 1), (3, "fresh", 1), (None, "none", 1)], key=repr)


def test_a_session_without_a_shared_folder_gets_one(tmp_path):
    script = (
        "from tarn import build_session\n"
        "from tarn.session import cut_lineage, shared_root\n"
        "spark = build_session('own', 'local[2]', 2)\n"
        "assert spark.conf.get('spark.checkpoint.dir', None) is None\n"
        "assert cut_lineage(spark.range(5)).count() == 5 and shared_root(spark) == shared_root(spark)\n"
        "print('fine')\n"
    )
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    done = subprocess.run([sys.executable, "-c", script], env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in done.stdout, done.stderr[-2000:]
