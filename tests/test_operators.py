"""Merges, windows, functions, quality, access, enrichment, serving on small fixtures."""

import datetime as dt
import json
import random
import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn import functions as fn
from tarn.operators import access, enrich, merge, quality
from tarn.operators.privacy import protect
from tarn.operators.serving import RefusedQuery, preview, run_sql
from tarn.operators.windows import rank_in_group, running_total


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- merge --------------------------------------------------------------------------


def test_keep_latest_breaks_ties_and_filters_before_the_shuffle(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 5, 'a'), (1, 5, 'b'), (2, NULL, 'c'), (2, 1, 'd') AS t(id, seq, v)")
    latest = merge.keep_latest(df, "id", "seq")
    assert rows(latest) == [(1, 5, "b"), (2, 1, "d")]
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_upsert_columns_keeps_unlisted_values(spark):
    target = spark.sql("SELECT * FROM VALUES (1, 'a', 1.0D), (2, 'b', 2.0D) AS t(id, name, v)")
    source = spark.sql("SELECT * FROM VALUES (2, 'B', 9.0D), (3, 'C', 3.0D) AS t(id, name, v)")
    assert rows(merge.upsert_columns(target, source, "id", ["v"])) == [
        (1, "a", 1.0), (2, "b", 9.0), (3, "C", 3.0),
    ]


def test_union_relaxed_widens(spark):
    left, right = spark.sql("SELECT 1 AS a, 'x' AS b"), spark.sql("SELECT 2L AS a, 1.5D AS c")
    out = merge.union_relaxed(left, right)
    assert dict(out.dtypes) == {"a": "bigint", "b": "string", "c": "double"}
    assert rows(out) == [(1, "x", None), (2, None, 1.5)]
    assert dict(merge.union_relaxed(spark.sql("SELECT 1 AS a"), spark.sql("SELECT 'k' AS a")).dtypes) == {"a": "string"}


def test_table_diff_sees_moved_nulls(spark):
    left = spark.sql("SELECT 1 AS id, CAST(NULL AS STRING) AS a, 'x' AS b")
    right = spark.sql("SELECT 1 AS id, 'x' AS a, CAST(NULL AS STRING) AS b")
    assert rows(merge.table_diff(left, right, "id")) == [(1, "changed")]
    assert rows(merge.table_diff(left, left, "id")) == []


def test_changed_by_content(spark):
    before = spark.range(5).select("id", (F.col("id") * 2).alias("v"))
    after = before.withColumn("v", F.when(F.col("id") == 3, 0).otherwise(F.col("v"))).unionByName(
        spark.sql("SELECT 9L AS id, 9L AS v")
    )
    assert rows(merge.changed_by_content(after, before, "id")) == [(3, 0), (9, 9)]


# --- windows ------------------------------------------------------------------------


def test_rank_of_hot_groups_equals_the_window(spark):
    random.seed(3)
    data = [(random.choice("aab"), random.choice([1.0, 2.0, 3.5, None]), i) for i in range(500)]
    df = spark.createDataFrame(data, "g string, v double, i int").union(
        spark.createDataFrame([("z", 7.0, 900 + i) for i in range(200)], "g string, v double, i int")
    )
    df = df.union(spark.createDataFrame([(None, v, 2000 + i) for i, v in enumerate([4.0, None, 4.0, 1.0])], df.schema))
    order = Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last())
    plain = df.withColumn("r", F.rank().over(order).cast("bigint"))
    assert rows(rank_in_group(df, ["g"], "v", "r")) == rows(plain)


def test_running_total_keeps_null_groups(spark):
    df = spark.sql("SELECT * FROM VALUES (NULL, 1, 5), (NULL, 2, 6), ('a', 1, 7), ('a', 2, 8) AS t(g, i, v)")
    got = running_total(df, "v", [F.col("i").asc()], ["g"], "before").select("g", "i", "before")
    assert {tuple(r) for r in got.collect()} == {(None, 1, 0), (None, 2, 5), ("a", 1, 0), ("a", 2, 7)}


def test_running_total_over_one_huge_group(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    got = {r.id: r.before for r in running_total(df, "v", [F.col("id").asc()], (), "before", 6).collect()}
    total = 0
    for i in range(1000):
        assert got[i] == total
        total += i % 7


# --- functions ----------------------------------------------------------------------


def test_uuid5_equals_the_standard_library(spark):
    names = ["", "a", "José Ünïcode", "User:12", "x" * 300, None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for name, got in df.select("n", fn.uuid5("n")).collect():
        assert got == (None if name is None else str(uuid.uuid5(uuid.NAMESPACE_URL, name)))


def test_normalisers(spark):
    df = spark.createDataFrame(
        [("  Ana@Mail.Test ", "+55 (11) 98888-7777", "12.345.678/0001-95"), ("\tb@x.com\n", "0055 11 3333-4444", "")],
        "email string, phone string, cnpj string",
    )
    got = df.select(*[fn.normalize_field(c) for c in ("email", "phone", "cnpj")]).collect()
    assert tuple(got[0]) == ("ana@mail.test", "11988887777", "12345678000195")
    assert got[1][1] == "1133334444" and got[1][2] is None
    assert df.select(fn.normalize_email("email", all_whitespace=True)).collect()[1][0] == "b@x.com"


@pytest.mark.parametrize(
    "cpf, good",
    [("529.982.247-25", True), ("52998224725", True), ("529.982.247-24", False), ("111.111.111-11", False), ("1", False), ("", False)],
)
def test_cpf(spark, cpf, good):
    assert spark.range(1).select(fn.is_valid_cpf(F.lit(cpf))).first()[0] is good


def test_cnpj(spark):
    got = spark.range(1).select(fn.is_valid_cnpj(F.lit("11.222.333/0001-81")), fn.is_valid_cnpj(F.lit("11.222.333/0001-82"))).first()
    assert tuple(got) == (True, False)


def test_age_counts_calendar_days(spark):
    stamp = F.lit("2026-06-25 23:59:00").cast("timestamp_ntz")
    assert spark.range(1).select(fn.age_in_days(stamp, "2026-06-27")).first()[0] == 2


def test_money_rounds_the_decimal_value(spark):
    assert spark.range(1).select(fn.round_money(F.lit(1.005))).first()[0] == 1.01


def test_record_parsing_marks_violations(spark):
    schema = {
        "type": "object",
        "properties": {
            "title": {"type": "string"}, "pages": {"type": "integer"},
            "shelf": {"type": "string", "enum": ["north", "south"]},
            "marks": {"type": "array", "items": {"type": "string"}},
        },
        "required": ["title", "shelf"],
    }
    texts = ['{"title": "A", "shelf": "north", "pages": 3, "marks": ["t"]}', '{"shelf": "attic"}', "oops", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.p for r in df.select(fn.parse_record("t", schema).alias("p")).collect()]
    assert got[0].record.pages == 3 and got[0].record.marks == ["t"] and got[0].errors == []
    assert got[1].errors == ["missing:title", "enum:shelf"]
    assert got[2].errors == ["malformed"] and got[3].errors == ["malformed"]


# --- quality ------------------------------------------------------------------------


def test_gate_lists_every_reason_and_a_report(spark):
    parent = spark.sql("SELECT * FROM VALUES (1), (2) AS t(k)")
    df = spark.sql(
        "SELECT * FROM VALUES (1, 'a@x.com', 5, 1), (2, 'broken', 50, 1), (3, NULL, 5, 9), (4, 'd@x.com', 5, NULL),"
        "(4, 'e@x.com', NULL, 2) AS t(id, email, n, ref)"
    )
    suite = [
        quality.not_null("email"), quality.email_format("email"), quality.in_range("n", 0, 10),
        quality.unique("id"), quality.references("ref", parent, "k"),
    ]
    ok, bad = quality.gate(df, suite)
    assert [r.id for r in ok.collect()] == [1]
    reasons = {(r.id, r.email): set(r.reasons) for r in bad.collect()}
    assert reasons[(2, "broken")] == {"email:email", "range:n"}
    assert reasons[(3, None)] == {"not_null:email", "reference:ref"}
    assert reasons[(4, "d@x.com")] == {"unique:id"} and reasons[(4, "e@x.com")] == {"unique:id"}
    assert {r.check_name: r.failed_rows for r in quality.gate_report(bad).collect()}["unique:id"] == 2


def test_injected_dirt_is_found_in_full(spark):
    df = spark.range(1000).select("id", F.concat(F.lit("u"), "id", F.lit("@x.com")).alias("email"))
    dirty = quality.inject_dirty(df, "id", {"email": (F.lit("nope"), 9)})
    flagged = quality.flag(dirty, [quality.email_format("email")])
    got = quality.confusion(flagged, F.size("injected") > 0, F.size("reasons") > 0).first()
    assert got.recall == 1.0 and got.precision == 1.0 and 60 < got.true_positive < 180
    assert rows(dirty) == rows(quality.inject_dirty(df, "id", {"email": (F.lit("nope"), 9)}))


def test_unknown_check_is_refused():
    with pytest.raises(ValueError, match="unknown check"):
        quality.suite_from_config([{"check": "vibes", "args": ["x"]}])


# --- privacy ------------------------------------------------------------------------


def test_protect(spark):
    df = spark.sql("SELECT 'a' AS mail, 'b' AS phone, 1 AS id")
    got = protect(df, {"mail": "hash", "phone": "drop"}, "s")
    assert got.columns == ["mail", "id"] and len(got.first().mail) == 64
    with pytest.raises(ValueError):
        protect(df, {"mail": "blur"})


# --- access -------------------------------------------------------------------------


def membership(spark):
    return spark.sql(
        "SELECT * FROM VALUES ('g1', 'g2'), ('g2', 'g3'), ('g3', 'g1'), ('g3', 'ana'), ('g9', 'bob') AS t(group_id, member_principal_id)"
    )


def acl(spark):
    return spark.sql(
        "SELECT o AS source_object_id, p AS principal_id, l AS access_level, e AS effect, 'direct' AS grant_type,"
        " CAST(NULL AS STRING) AS granted_via, TIMESTAMP '2026-01-01' AS extracted_at"
        " FROM VALUES ('space', 'g1', 'read', 'allow'), ('page', 'bob', 'read', 'allow'), ('page', 'ana', 'read', 'deny'),"
        " ('space', 'bob', 'read', 'deny') AS t(o, p, l, e)"
    )


def test_nested_groups_with_a_cycle(spark):
    got = {tuple(r) for r in access.expand_membership(membership(spark)).collect()}
    groups = {(a, b) for a in ("g1", "g2", "g3") for b in ("g1", "g2", "g3") if a != b}
    assert got == groups | {("g1", "ana"), ("g2", "ana"), ("g3", "ana"), ("g9", "bob")}


def test_inherited_grants_and_deny_wins(spark):
    parents = spark.sql("SELECT * FROM VALUES ('page', 'space'), ('note', 'page') AS t(object_id, parent_id)")
    full = access.inherit_acl(acl(spark), parents)
    kinds = {(r.source_object_id, r.principal_id, r.effect): r.grant_type for r in full.collect()}
    assert kinds[("page", "bob", "allow")] == "direct" and kinds[("note", "bob", "allow")] == "inherited"
    assert kinds[("note", "g1", "allow")] == "inherited"
    items = spark.sql("SELECT * FROM VALUES ('space'), ('page'), ('note'), ('loose') AS t(o)")
    people = spark.sql("SELECT * FROM VALUES ('ana', 'ana@x.com'), ('bob', 'bob@x.com') AS t(id, email)")

    def seen(mail, **options):
        who = access.principals_of(membership(spark), people, mail)
        return [r.o for r in access.visible_by_grants(items, "o", full, who, **options).orderBy("o").collect()]

    assert seen("Ana@x.com ") == ["space"]
    assert seen("bob@x.com") == []
    assert seen("ana@x.com", default="public") == ["loose", "space"]


def test_stamped_rows_filter_like_the_grant_table(spark):
    items = spark.sql("SELECT * FROM VALUES ('space'), ('page'), ('loose') AS t(o)")
    stamped = access.apply_acl(items, "o", acl(spark))
    assert stamped.count() == 3
    seen = access.visible_to(stamped, ["bob", "g9"])
    assert [r.o for r in seen.collect()] == ["page"]


def test_acl_diff(spark):
    old, new = acl(spark).where("effect = 'allow'"), acl(spark).where("source_object_id = 'page'")
    got = {(r.source_object_id, r.principal_id): r.change for r in access.acl_diff(old, new).collect()}
    assert got == {("space", "g1"): "revoked", ("page", "ana"): "added"}


# --- enrichment ---------------------------------------------------------------------

SCHEMA = {
    "type": "object",
    "properties": {"opening": {"type": "string"}, "ending": {"type": "string", "enum": ["full", "open"]}},
    "required": ["opening"],
}


def notes(spark):
    return spark.sql("SELECT * FROM VALUES (1, 'Rain falls on hills.'), (2, 'boom'), (3, 'later'), (4, 'Rain falls on hills.') AS t(note_id, body)")


@pytest.fixture
def extractor():
    def answer(texts):
        if any(t == "boom" for t in texts):
            raise RuntimeError("no answer")
        return [json.dumps({"opening": t.split(" ")[0] if " " in t else None, "ending": "full"}) for t in texts]

    return answer


def test_failures_are_retried_and_kept_apart(spark, extractor):
    out = enrich.extract_records(notes(spark), "note_id", "body", SCHEMA, extractor, batch_size=8, max_retries=1)
    good, bad = enrich.split_dead_letters(out)
    assert {r.note_id: r.profile.opening for r in good.collect()} == {1: "Rain", 4: "Rain"}
    errors = {r.note_id: r.errors for r in bad.collect()}
    assert errors[3] == ["missing:opening"] and "no answer" in errors[2][0]


def test_second_run_asks_nothing_but_failures(spark, lake, extractor):
    def run(where, **options):
        return enrich.enrich_table(lake, "notes", notes(spark).where(where), "note_id", "body", SCHEMA, extractor, model="own", **options)

    assert run("note_id <> 2") == {"misses": 2, "held_back": 0, "dead_letters": 1}
    assert {r.model for r in lake.read("state/notes__usage").collect()} == {"own"}
    assert run("note_id IN (1, 4)") == {"misses": 0, "held_back": 0, "dead_letters": 0}
    assert lake.count("enrichment/notes") == 2
    before = lake.current_version("enrichment/notes")
    assert run("note_id IN (1, 4)")["misses"] == 0 and lake.current_version("enrichment/notes") == before
    assert run("note_id = 1", version="2")["misses"] == 1
    assert lake.count("enrichment/notes") == 1


def test_budget_stops_calls_until_the_next_run(spark, lake, extractor):
    texts = spark.range(6).select("id", F.concat(F.lit("Note "), F.col("id").cast("string"), F.lit(" " * 34)).alias("t"))

    def run(budget):
        return enrich.enrich_table(lake, "b", texts, "id", "t", SCHEMA, extractor, budget_tokens=budget)

    assert run(25) == {"misses": 2, "held_back": 4, "dead_letters": 0}
    assert lake.count("enrichment/b") == 2
    assert run(None) == {"misses": 4, "held_back": 0, "dead_letters": 0}
    assert lake.count("enrichment/b") == 6 and enrich.is_enriched(lake, "b", texts, "id", "t", SCHEMA)
    assert not enrich.is_enriched(lake, "b", texts.withColumn("t", F.lit("other text")), "id", "t", SCHEMA)


def test_a_failing_batch_is_halved(spark):
    def model(texts):
        with open(log, "a") as file:
            file.write(f"{len(texts)}\n")
        if "boom" in texts:
            raise RuntimeError("no answer")
        return ["{}" for _ in texts]

    import tempfile

    log = tempfile.mktemp()
    texts = spark.createDataFrame([(i, "boom" if i == 5 else f"t{i}") for i in range(16)], "id int, t string").coalesce(1)
    shape = {"type": "object", "properties": {}}
    out = enrich.extract_records(texts, "id", "t", shape, model, batch_size=16, max_retries=0, backoff_seconds=0.0)
    failed = [r.id for r in out.where("size(errors) > 0").collect()]
    with open(log) as file:
        calls = [int(line) for line in file]
    assert failed == [5] and len(calls) <= 9


def test_budget_stops_issuing(spark):
    df = spark.range(10).select("id", F.lit("x" * 40).alias("t"))
    got = {r.id: r.issued for r in enrich.within_budget(df, "id", "t", 35).collect()}
    assert [i for i, issued in sorted(got.items()) if issued] == [0, 1, 2]


def test_embedding_model_answers(spark):
    def model(texts):
        return [json.dumps([float(len(t)), 1.0]) for t in texts]

    got = enrich.embed_texts(notes(spark), "note_id", "body", model)
    assert {r.note_id: list(r.embedding) for r in got.collect()}[2] == [4.0, 1.0]


# --- serving ------------------------------------------------------------------------


def test_run_sql_is_read_only_and_capped(spark, lake):
    lake.write("clean", "t", spark.range(2000))
    served = run_sql(lake, "SELECT * FROM clean_t")
    assert served.rows.count() == 500 and served.truncated
    served = run_sql(lake, "WITH x AS (SELECT max(id) AS m FROM clean_t) SELECT m FROM x")
    assert served.rows.first().m == 1999 and not served.truncated
    wide = ", ".join(f"id + {i} AS c{i}" for i in range(40))
    for text in (
        "DROP TABLE clean_t", "DELETE FROM clean_t", "UPDATE clean_t SET id = 1",
        "INSERT INTO clean_t VALUES (1)", "CREATE TABLE x AS SELECT 1", "SET a=b",
        "SELECT reflect('java.lang.System', 'exit', 0)",
        f"SELECT {wide}, reflect('java.lang.System', 'nanoTime') AS r FROM clean_t",
        "SELECT id FROM clean_t WHERE id IN (SELECT max(java_method('java.lang.System', 'nanoTime')) FROM clean_t)",
        "SELECT system.builtin.reflect('java.lang.System', 'nanoTime')",
        "SELECT * FROM (SELECT (SELECT try_reflect('java.lang.System', 'nanoTime')) AS x)", "SELECT * FROM nowhere",
    ):
        with pytest.raises(RefusedQuery):
            run_sql(lake, text)
    with pytest.raises(RefusedQuery, match="parquet"):
        run_sql(lake, f"SELECT * FROM parquet.`{lake.root}/clean/t/data`")


def test_preview_pages_and_search(spark):
    df = spark.range(25).select("id", F.concat(F.lit("Row_"), "id").alias("name"), (F.col("id") % 3).alias("g"))
    page = preview(df, "id", sort="g", desc=True, page=2, size=4)
    assert [(r.g, r.id) for r in page.collect()] == [(2, 14), (2, 17), (2, 20), (2, 23)]
    assert preview(df, "id", search="row_1").count() == 11
    assert preview(df, "id", search="rowx1").count() == 0


def test_deep_pages_go_on_where_earlier_ones_end(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("g"))
    pages = [preview(df, "id", sort="g", desc=True, page=p, size=30).collect() for p in range(1, 19)]
    assert [r.id for page in pages for r in page] == [r.id for r in df.orderBy(F.desc("g"), "id").collect()]


def test_interval_and_marks(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2026-01-01' AS ts UNION ALL SELECT TIMESTAMP_NTZ '2026-01-02'")
    assert df.where(fn.beyond(df, "ts", dt.datetime(2026, 1, 1))).count() == 1
    assert df.where("false").agg(fn.watermark_or("ts")).first()[0] == dt.datetime(1900, 1, 1)


def test_many_grants_of_one_object_stay_rows(spark, sf_dir):
    from __spark_entry__ import queries
    from tarn.operators.access import grant_counts

    found = queries()["acl_many_grants"](spark, sf_dir)
    assert "collect_set" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    grants = [("a", "p", "allow"), ("a", "p", "allow"), ("a", "q", "allow"), ("a", "p", "deny"), ("b", None, "allow"), ("c", "p", "deny")]
    acl = spark.createDataFrame(grants, "source_object_id string, principal_id string, effect string")
    assert {tuple(r) for r in grant_counts(acl).collect()} == {("a", 2, 1), ("c", 0, 1)}


def test_long_phones_of_every_customer(spark, tmp_path):
    """Also keys 0 and 5 and those that begin with 55, against the SQL."""
    import duckdb
    from __spark_entry__ import oracle_sql, queries

    keys = [0, 1, 5, 7, 54, 55, 505, 550, 5512, 55555, 123456]
    spark.createDataFrame([(k,) for k in keys], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    found = queries()["normalize_all_long_phones"](spark, str(tmp_path)).select("c_custkey", "long_phone", "long_local").collect()
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    expected = connection.execute(oracle_sql()["normalize_all_long_phones"]).fetchall()
    assert len(found) == len(keys) and sorted(map(tuple, found)) == sorted(expected)


def test_ranks_of_frequent_values_and_nulls(spark, monkeypatch):
    """Many ranges, values that fill several of them, NULL groups, NaN and infinity: as one window has it."""
    import random

    from pyspark.sql import Window

    from tarn.operators import windows

    monkeypatch.setattr(windows, "RANGE_ROWS", 50)
    draw = random.Random(2)
    values = [None, float("nan"), float("inf"), 0.0, 0.0, 0.0, 0.0]
    rows = [(draw.choice(["a", "b", None]), draw.choice([*values, draw.random(), draw.random(), float(draw.randrange(5))])) for _ in range(6000)]
    df = spark.createDataFrame(rows, "g string, v double")
    bounds, frequent = windows.value_bounds(df, "v")
    assert len(bounds) > 5 and 0.0 in frequent
    plain = Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last())
    expected = df.withColumn("r", F.rank().over(plain).cast("bigint"))
    found = windows.rank_in_group(df, ["g"], "v", "r")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))
