"""Views kept by delta against rebuilds, and the landed source."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.operators.maintained import CountedView, EntityIndex, RankedTable
from tarn.session import scratch_path
from tarn.sources.landed_source import LandedReader, register


def test_ranks_counts_by_delta_equal_a_rebuild(spark):
    draw = random.Random(4)
    schema = "id bigint, g string, v double"
    rows = {i: (i, draw.choice(["a", "b", None]), draw.choice([None, 1.0, 1.0, draw.random()])) for i in range(300)}
    df = spark.createDataFrame(list(rows.values()), schema)
    ranks, counts = RankedTable.create(df, scratch_path(spark, "ranks"), "id", ["g"], "v", 8), CountedView(df, ["g"])
    for gone_ids, fresh_ids in ((range(0, 60, 3), [*range(0, 60, 6), 1000, 1001]), ([], [2000]), (range(100, 300), [])):
        gone = [rows.pop(i) for i in gone_ids if i in rows]
        fresh = [(i, draw.choice(["a", "c", None]), draw.choice([None, 0.5, 9.0, draw.random()])) for i in fresh_ids]
        rows |= {r[0]: r for r in fresh}
        removed, added = spark.createDataFrame(gone, schema), spark.createDataFrame(fresh, schema)
        ranks.apply(removed, added)
        counts.apply(removed, added)
        now = spark.createDataFrame(list(rows.values()), schema)
        plain = now.withColumn("rank", F.rank().over(Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last())).cast("bigint"))
        assert sorted(map(repr, ranks.ranked().collect())) == sorted(map(repr, plain.collect()))
        assert sorted(map(repr, counts.counts.collect())) == sorted(map(repr, now.groupBy("g").agg(F.count("*").alias("n")).collect()))
    assert ranks.apply(spark.createDataFrame([], schema), spark.createDataFrame([], schema)) == 0


def test_entities_by_delta_equal_a_rebuild(spark):
    draw = random.Random(5)
    schema = "id bigint, mail string, phone string"

    def record(i):
        return i, draw.choice([None, *[f"m{draw.randrange(25)}"] * 3]), draw.choice([None, *[f"p{draw.randrange(25)}"] * 2])

    rows = {i: record(i) for i in range(40)}
    index = EntityIndex(spark.createDataFrame(list(rows.values()), schema), "id", ["mail", "phone"])
    for changed_ids, deleted_ids in (([3, 4, 50, 51], [7, 8, 9]), ([], list(range(20, 40, 2)))):
        changed = [record(i) for i in changed_ids]
        for i in deleted_ids:
            rows.pop(i, None)
        rows |= {r[0]: r for r in changed}
        done = index.apply(spark.createDataFrame(changed, schema), spark.createDataFrame([(i,) for i in deleted_ids], "id bigint"))
        rebuilt = EntityIndex(spark.createDataFrame(list(rows.values()), schema), "id", ["mail", "phone"])
        assert {r["key"]: r["entity"] for r in index.state.collect()} == {r["key"]: r["entity"] for r in rebuilt.state.collect()}
        assert done <= len(rows)


def test_the_source_prunes_row_groups_and_streams_files_once(spark, tmp_path):
    register(spark)
    table = pa.table({"id": list(range(1000)), "v": [str(i) for i in range(1000)]})
    pq.write_table(table, tmp_path / "a.parquet", row_group_size=100)
    read = spark.read.format("landed").option("path", str(tmp_path)).option("cursor", "id").load()
    assert sorted(r["id"] for r in read.where("id > 949 AND v <> '960'").collect()) == [i for i in range(950, 1000) if i != 960]
    reader = LandedReader({"path": str(tmp_path), "cursor": "id"}, read.schema)
    reader.comparisons = [("GreaterThan", "id", 949)]
    assert [p.groups for p in reader.partitions()] == [[9]]
    reader.comparisons = []
    assert len(reader.partitions()) == 10
    landing, target, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at")
    for go in range(3):
        if go < 2:
            spark.createDataFrame([(go, "x")], "id bigint, v string").coalesce(1).write.mode("append").json(landing)
        stream = spark.readStream.format("landed").schema("id bigint, v string").option("path", landing).option("format", "json").load()
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [0, 1]
