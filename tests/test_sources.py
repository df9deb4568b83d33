"""Sources: files, documents, pages, JDBC options, federation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarn.plans.clean import clean_customers, clean_order_lines, clean_orders
from tarn.session import scratch_path
from tarn.sources.federation import CatalogRemote, FolderRemote, JdbcRemote, federate
from tarn.sources.files import flatten_pages, parse_fields, read_documents, read_open_table, read_parquet_dir
from tarn.sources.generate import gen_contracts, gen_customers, gen_partners, gen_products
from tarn.sources.jdbc import bounds_query, increment_query, jdbc_options, partition_options, read_increment
from tarn.sources.landed_source import register

def goods(spark):
    """Five goods, priced by number."""
    return spark.range(1, 6).select(
        F.concat(F.lit("G"), "id").alias("sku"), F.concat(F.lit("good "), "id").alias("product_name"),
        F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("category"),
        (F.col("id") * F.lit("10.25").cast("decimal(6,2)")).cast("decimal(10,2)").alias("unit_price"),
    )


def purchases(spark):
    """Twelve purchases, of the goods in turn."""
    return spark.range(12).select(
        F.col("id").cast("int").alias("order_id"), F.concat(F.lit("G"), F.col("id") % 5 + 1).alias("product_sku"),
        F.concat(F.lit("buyer"), F.col("id") % 4, F.lit("@mail.test")).alias("customer_email"),
        (F.col("id") % 3 + 1).cast("int").alias("qty"),
    )


def test_federated_join_gives_lines_with_decimals(spark, lake):
    path = scratch_path(spark, "customer-lake")
    goods(spark).write.parquet(f"{path}/fed/products")
    lake.write("raw", "orders", purchases(spark))
    remote = FolderRemote(spark, path)
    lake.attach_federation("products", lambda: federate(remote, schema="fed", table="products"))
    lines = clean_order_lines(lake.read("raw/orders"), lake.read("fed/products"))
    assert lines.count() == 12
    assert dict(lines.dtypes)["line_total"].startswith("decimal")
    assert str(lines.where("order_id = 8").first().line_total) == "123.00"  # 3 of good 4


def test_federation_modes(spark):
    path = scratch_path(spark, "customer-lake")
    spark.range(50).select(F.col("id"), (F.col("id") * 1.5).alias("amount")).write.parquet(f"{path}/orders")
    remote = FolderRemote(spark, path)
    assert federate(remote, relation="orders").count() == 50
    assert federate(remote, query="SELECT count(*) AS n FROM {o}", o="orders").first().n == 50
    delta = federate(remote, relation="orders", watermark=40, cursor="id")
    assert delta.count() == 9
    assert "GreaterThan(id,40)" in delta._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        federate(remote)


def test_jdbc_options():
    assert jdbc_options("jdbc:x", table="t")["fetchsize"] == "10000"
    assert jdbc_options("jdbc:x", query="SELECT 1")["query"] == "SELECT 1"
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", table="t", query="SELECT 1")
    assert partition_options("id", 1, 100, 8) == {
        "partitionColumn": "id", "lowerBound": "1", "upperBound": "100", "numPartitions": "8",
    }
    assert bounds_query("t", "id") == "SELECT min(id) AS lo, max(id) AS hi FROM t"
    assert increment_query("t", "at", dt.datetime(2026, 1, 2, 3)) == "SELECT * FROM t WHERE at > TIMESTAMP '2026-01-02 03:00:00'"
    assert increment_query("t", "k", "o'x") == "SELECT * FROM t WHERE k > 'o''x'"
    assert JdbcRemote(None, "jdbc:x").qualified("s", "t") == "s.t"
    assert CatalogRemote.settings("pg", "jdbc:x")["spark.sql.catalog.pg.url"] == "jdbc:x"


def test_increment_is_strict(spark):
    df = spark.range(5)
    assert read_increment(df, "id", 2).count() == 2 and read_increment(df, "id", None).count() == 5


def test_absent_table_formats_say_so(spark):
    for name in ("delta", "iceberg"):
        with pytest.raises(RuntimeError, match="class path"):
            read_open_table(spark, "/nowhere", name)
    with pytest.raises(ValueError):
        read_open_table(spark, "/nowhere", "hudi")


def test_documents_and_opaque_fields(spark):
    path = scratch_path(spark, "docs")
    spark.sql("""SELECT '{"_id": {"$oid": "abc"}, "v": 1}' AS value UNION ALL SELECT '{"_id": {"$oid": "def"}, "v": 2}'""").write.text(path)
    assert {r._id: r.v for r in read_documents(spark, path).collect()} == {"abc": 1, "def": 2}
    with pytest.raises(ValueError, match="_id"):
        read_documents(spark, path, "v int")
    raw = spark.sql("""SELECT 1 AS record_id, '{"a": 5, "b": "x"}' AS fields_json""")
    assert tuple(parse_fields(raw, "fields_json", "a int, b string").first()) == (1, 5, "x")


def test_overlapping_pages_keep_the_latest(spark):
    pages = spark.sql(
        """SELECT '{"result": {"items": [{"id": 1, "at": 1}, {"id": 2, "at": 1}]}}' AS body
           UNION ALL SELECT '{"result": {"items": [{"id": 2, "at": 2}, {"id": 3, "at": 1}]}}'"""
    )
    got = flatten_pages(pages, "body", "result.items", "id int, at int", "id", "at")
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 2), (3, 1)]


def test_parquet_glob(spark):
    path = scratch_path(spark, "glob")
    for part in ("a", "b"):
        spark.range(3).write.parquet(f"{path}/raw/{part}")
    assert read_parquet_dir(spark, path, "raw/*").count() == 6


def test_generators(spark):
    partners = gen_partners(spark).orderBy("partner_id").collect()
    assert len(partners) == 1000 and partners[0].partner_tier == "platinum" and partners[1].commission_rate == 0.015
    assert gen_products(spark).count() == 500
    contracts = gen_contracts(spark, 1000, 50, 10)
    assert contracts.selectExpr("max(first_party) < 50 AND max(product_id) < 10 AS ok").first().ok
    assert gen_customers(spark, 10).first().email == "  User0@Mail.Test "


def test_wide_model_has_every_customer_with_a_partner(spark):
    raw = gen_customers(spark, 3000).withColumn("created_at", F.lit("2026-06-25 23:59:00").cast("timestamp_ntz"))
    model = clean_customers(raw, gen_partners(spark), "2026-06-27", passthrough=["updated_at"])
    assert model.count() == 3000 and model.where("partner_name IS NULL").isEmpty()
    top = model.where("segment = 'Sg9' AND balance_rank_in_segment = 1").first()
    assert top.balance == max(i % 997 * 2.25 for i in range(9, 3000, 10)) and top.balance_tier == "high" and top.account_age_days == 2
    assert top.email_domain == "mail.test"


def test_orders_fixture_grows_from_100_to_120(spark, lake):
    from tarn.plans.models import Model, run_model

    def rows(first, last, day):
        return spark.range(first, last).select(
            F.col("id").cast("string"), F.concat(F.lit(day), F.lit("T10:00:"), F.lpad((F.col("id") % 60).cast("string"), 2, "0")).alias("updated_at"),
            (F.col("id") * 1.5).cast("string").alias("amount"), F.concat(F.lit("  U"), "id", F.lit("@X.com ")).alias("email"),
        )

    model = Model("orders", ["raw/orders"], clean_orders, materialized="incremental", unique_key=("external_id",))
    lake.write("raw", "orders", rows(0, 100, "2026-01-01"), "merge", pk="id", order="updated_at")
    run_model(lake, model)
    assert lake.count("clean/orders") == 100
    lake.write("raw", "orders", rows(100, 120, "2026-02-01"), "merge", pk="id", order="updated_at")
    assert run_model(lake, model) == "merged"
    assert lake.count("raw/orders") == 120 and lake.count("clean/orders") == 120
    assert lake.read("clean/orders").where("external_id = 119").first().email == "u119@x.com"


def test_landed_json_may_be_empty_and_documents_long(spark, tmp_path):
    register(spark)
    rows = [(1, "a", None), (2, "b" * 3_000_000, None), (3, None, "2024-01-01"), (4, "d\ne", "x")]
    landing, target = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()
    (landing / "0.json").touch()
    (landing / "1.json").write_text("\n")
    spark.createDataFrame(rows, "id bigint, v string, w string").coalesce(1).write.mode("append").json(str(landing))
    (landing / "2.json").write_text('{"id": 5, "other": {"a": 1}}\n{"id": 6, "other": 2}')
    options = {"path": str(landing), "format": "json"}
    stream = spark.readStream.format("landed").schema("id bigint, v string, w string").options(**options).load()
    written = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", str(tmp_path / "at"))
    written.trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == [*rows, (5, None, None), (6, None, None)]
    (landing / "2.json").unlink()
    read = spark.read.format("landed").options(**options).option("cursor", "id").load()
    assert [(f.name, f.dataType.simpleString()) for f in read.schema] == [("id", "bigint"), ("v", "string"), ("w", "string")]
    assert sorted(r["id"] for r in read.where("id > 2").collect()) == [3, 4]


def test_turns_stream_when_the_first_partition_has_none_of_a_go(spark, tmp_path):
    from tarn.queries.scans import source_stream

    rows = [(i, 0, "user", f"t{i}") for i in range(1, 40, 2)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    assert sorted(map(tuple, source_stream(spark, str(tmp_path)).collect())) == rows
