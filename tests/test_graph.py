"""Ontology, projection, entity resolution, graph questions."""

import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tarn.graph import query as graph_query
from tarn.graph.entities import connected_components, resolve_entities
from tarn.graph.ontology import OntologyHistory, merge_fragments, parse_ontology, validate_ontology
from tarn.graph.project import Graph, build_graph, refresh_graph, sanitize_props
from tarn.session import scratch_path
from tarn.sources.generate import gen_contracts, gen_customers, gen_products

USERS, CONTRACTS, PRODUCTS = 300, 500, 40

MAP = {
    "nodes": [
        {"label": "User", "source": "clean/users", "id_field": "id", "properties": ["name"]},
        {"label": "Contract", "source": "clean/contracts", "id_field": "contract_id", "properties": ["status"], "cursor": "updated_at"},
        {"label": "Product", "source": "clean/products", "id_field": "product_id", "properties": ["product_name"]},
    ],
    "edges": [
        {"type": "FIRST", "source": "clean/contracts", "from_label": "Contract", "from_key": "contract_id", "to_label": "User", "to_key": "first_party"},
        {"type": "SECOND", "source": "clean/contracts", "from_label": "Contract", "from_key": "contract_id", "to_label": "User", "to_key": "second_party"},
        {"type": "ABOUT", "source": "clean/contracts", "from_label": "Contract", "from_key": "contract_id", "to_label": "Product", "to_key": "product_id"},
    ],
    "timeline": [
        {"type": "SIGNED", "source": "clean/contracts", "label": "User", "key": "first_party", "timestamp": "updated_at", "properties": ["contract_id"]},
    ],
}


@pytest.fixture
def filled(spark, lake):
    lake.write("clean", "users", gen_customers(spark, USERS))
    lake.write("clean", "contracts", gen_contracts(spark, CONTRACTS, USERS, PRODUCTS))
    lake.write("clean", "products", gen_products(spark, PRODUCTS))
    return lake


def test_build_is_complete_repeatable_and_free_of_orphans(spark, filled):
    graph = build_graph(filled, parse_ontology(MAP))
    assert graph.nodes.count() == USERS + CONTRACTS + PRODUCTS
    assert graph.edges.count() == 3 * CONTRACTS
    assert graph.events.count() == CONTRACTS
    quality = graph_query.edge_quality(graph).collect()
    assert {(r.type, r.orphan_edges, r.resolved_edges) for r in quality} == {(t, 0, CONTRACTS) for t in ("FIRST", "SECOND", "ABOUT")}
    one = graph.nodes.where("label = 'User' AND entity_key = '7'").first()
    assert one.entity_id == str(uuid.uuid5(uuid.NAMESPACE_URL, "User:7"))
    before = {tuple(r) for r in graph.nodes.collect()}
    again = build_graph(filled, parse_ontology(MAP), reset=False)
    assert {tuple(r) for r in again.nodes.collect()} == before and again.edges.count() == 3 * CONTRACTS


def test_refresh_touches_only_the_delta(spark, filled):
    ontology = parse_ontology(MAP)
    build_graph(filled, ontology)
    mark = filled.read("clean/contracts").agg(F.max("updated_at")).first()[0]
    one = filled.read("clean/contracts").where("contract_id = 3").withColumn("status", F.lit("void"))
    late = one.withColumn("updated_at", F.timestamp_add("DAY", F.lit(500), F.col("updated_at")))
    filled.write("clean", "contracts", late, "merge", pk="contract_id")
    later = filled.read("clean/users").agg(F.max("updated_at")).first()[0]
    graph = refresh_graph(filled, ontology, {"clean/contracts": mark, "clean/users": later})
    assert graph.nodes.count() == USERS + CONTRACTS + PRODUCTS
    assert "void" in graph.nodes.where("label = 'Contract' AND entity_key = '3'").first().props
    assert graph.nodes.where("props LIKE '%void%'").count() == 1


def test_refresh_equals_a_rebuild_after_moves_and_deletes(spark, filled):
    ontology = parse_ontology(MAP)
    build_graph(filled, ontology)
    contracts = filled.read("clean/contracts")
    mark = contracts.agg(F.max("updated_at")).first()[0]
    later = filled.read("clean/users").agg(F.max("updated_at")).first()[0]
    other = contracts.where("contract_id = 4").first().product_id
    moved = contracts.where("contract_id = 3").withColumns(
        {"product_id": F.lit(other).cast(contracts.schema["product_id"].dataType), "updated_at": F.timestamp_add("DAY", F.lit(500), F.col("updated_at"))}
    )
    filled.write("clean", "contracts", moved, "merge", pk="contract_id")
    filled.delete_where_in("clean/contracts", "contract_id", spark.sql("SELECT 5 AS contract_id"))
    graph = refresh_graph(filled, ontology, {"clean/contracts": mark, "clean/users": later})
    fresh = build_graph(filled, ontology, suffix="_again")
    for part in ("nodes", "edges"):
        assert {tuple(r) for r in getattr(graph, part).collect()} == {tuple(r) for r in getattr(fresh, part).collect()}
    assert graph.edges.count() == 3 * (CONTRACTS - 1)


def test_ontology_is_checked_versioned_and_rolled_back(spark, filled):
    history = OntologyHistory(filled)
    assert history.save(MAP) == 1
    bad = {**MAP, "nodes": [{**MAP["nodes"][0], "properties": ["nickname"]}, *MAP["nodes"][1:]]}
    with pytest.raises(ValueError, match="nickname"):
        history.save(bad)
    assert history.save({"nodes": MAP["nodes"][:1]}) == 2
    assert history.rollback(1) == 3
    assert len(history.load().edges) == 3 and history.load(2).edges == ()
    with pytest.raises(ValueError, match="unknown table"):
        validate_ontology(filled, parse_ontology('{"nodes": [{"label": "X", "source": "clean/none", "id_field": "id"}]}'))


def test_yaml_maps_and_fragments():
    ontology = parse_ontology("version: 4\nnodes:\n  - {label: A, source: clean/a, id_field: id, er_fields: [email]}\n")
    assert ontology.version == 4 and ontology.node("A").er_fields == ("email",)
    merged = merge_fragments(2, {"nodes": [{"label": "A", "source": "clean/a", "id_field": "id"}]}, {"nodes": [{"label": "B", "source": "clean/b", "id_field": "id"}]})
    assert [n.label for n in merged.nodes] == ["A", "B"]


def test_shared_email_collapses_two_sources(spark, lake):
    people = spark.sql(
        "SELECT * FROM VALUES ('postgres', 1, 'ana@x.com'), ('postgres', 2, 'b@x.com'), ('postgres', 3, 'c@x.com'), ('postgres', 4, 'd@x.com'),"
        "('mongodb', 1, ' ANA@x.com'), ('mongodb', 2, 'f@x.com'), ('mongodb', 3, 'g@x.com'), ('mongodb', 4, NULL) AS t(source, id, email)"
    )
    lake.write("clean", "people", people)
    lake.write("clean", "tickets", spark.sql("SELECT * FROM VALUES (1, 2), (2, 3) AS t(ticket, person)"))
    ontology = parse_ontology({
        "nodes": [{"label": "Person", "source": "clean/people", "id_field": "id", "er_fields": ["email"], "origin": "source", "properties": ["email"]}],
    })
    graph = build_graph(lake, ontology)
    assert graph.nodes.count() == 7
    assert "mongodb:4" in {r.entity_key for r in graph.nodes.collect()}


def test_edges_follow_resolved_entities(spark, lake):
    lake.write("clean", "people", spark.sql("SELECT * FROM VALUES ('p1', 'ana@x.com'), ('p2', 'ANA@x.com '), ('p3', NULL) AS t(id, email)"))
    lake.write("clean", "tickets", spark.sql("SELECT * FROM VALUES (1, 'p1'), (2, 'p2'), (3, 'p3'), (4, 'p9') AS t(ticket, person)"))
    graph = build_graph(lake, parse_ontology({
        "nodes": [
            {"label": "Person", "source": "clean/people", "id_field": "id", "er_fields": ["email"]},
            {"label": "Ticket", "source": "clean/tickets", "id_field": "ticket"},
        ],
        "edges": [{"type": "BY", "source": "clean/tickets", "from_label": "Ticket", "from_key": "ticket", "to_label": "Person", "to_key": "person"}],
    }))
    assert graph.nodes.where("label = 'Person'").count() == 2
    assert graph.edges.select("dst").distinct().count() == 3
    assert graph_query.edge_quality(graph).first().orphan_edges == 1


def test_components_of_chains_stars_and_cycles(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    star = [("s0", f"s{i}") for i in range(1, 200)]
    cycle = [("x", "y"), ("y", "z"), ("z", "x")]
    edges = spark.createDataFrame(chain + star + cycle + [("q", "q")], "a string, b string")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert {got[f"c{i:03}"] for i in range(61)} == {"c000"}
    assert {got[f"s{i}"] for i in range(200)} == {"s0"}
    assert got["z"] == "x" and len(got) == 61 + 200 + 3


def test_components_equal_brute_force(spark):
    import random

    random.seed(11)
    pairs = [(f"n{random.randrange(120)}", f"n{random.randrange(120)}") for _ in range(110)]
    parent = {n: n for pair in pairs for n in pair}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    loops = {n for a, b in pairs if a == b for n in (a,)}
    want = {n: find(n) for n in parent}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert {n: c for n, c in want.items() if n in got} == got
    assert set(want) - set(got) <= loops


def test_two_fields_join_entities(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, 'a@x.com', '1'), (2, 'b@x.com', '1'), (3, 'b@x.com', NULL), (4, NULL, '9'), (5, NULL, NULL)"
        " AS t(id, email, phone)"
    )
    got = {r.id: r.entity_id for r in resolve_entities(df, "P", "id", ["email", "phone"]).collect()}
    assert got[1] == got[2] == got[3] and len({got[1], got[4], got[5]}) == 3


def test_sample_neighbours_slice_and_export(spark, filled):
    graph = build_graph(filled, parse_ontology(MAP))
    sample = graph_query.edge_seeded_sample(graph, 25)
    ends = {r.src for r in sample.edges.collect()} | {r.dst for r in sample.edges.collect()}
    assert {r.entity_id for r in sample.nodes.collect()} == ends
    user = graph.nodes.where("label = 'User' AND entity_key = '5'").select("entity_id")
    wanted = filled.read("clean/contracts").selectExpr("count_if(first_party = 5) + count_if(second_party = 5) AS n").first().n
    assert graph_query.neighbors(graph, user).edges.count() == wanted
    part = graph_query.slice_graph(graph, "Contract", 10)
    assert part.edges.count() == 30
    path = scratch_path(spark, "csv")
    graph_query.export_csv(graph, path)
    back = graph_query.import_csv(spark, path)
    assert back.nodes.exceptAll(graph.nodes.select(*back.nodes.columns)).isEmpty()
    assert back.edges.count() == 3 * CONTRACTS


def test_pattern_match(spark, filled):
    graph = build_graph(filled, parse_ontology(MAP))
    got = graph_query.match_star(graph, "Contract", {"FIRST": "first", "SECOND": "second", "ABOUT": "item"}, {"Contract": "status", "first": "name"})
    row = got.where("center_key = '42'").first()
    want = filled.read("clean/contracts").where("contract_id = 42").first()
    assert (row.first_key, row.second_key, row.item_key) == (str(want.first_party), str(want.second_party), str(want.product_id))
    assert row.status == want.status and row.first_name == f"Buyer {want.first_party}"
    assert got.count() == CONTRACTS


def test_properties_become_primitives(spark):
    df = spark.sql("SELECT DATE '2026-01-02' AS d, TIMESTAMP '2026-01-02 03:04:05' AS t, 1.50BD AS n, X'0aff' AS b, true AS f, array(1) AS a, 7 AS i")
    row = sanitize_props(df).first()
    assert tuple(row) == ("2026-01-02", "2026-01-02T03:04:05.000000Z", 1.5, "0aff", True, "[1]", 7)


def test_graph_without_edges_counts(spark, filled):
    graph = build_graph(filled, parse_ontology({"nodes": MAP["nodes"][:1]}))
    assert isinstance(graph, Graph) and graph.edges is None and graph.nodes.count() == USERS


PEOPLE = {
    "nodes": [
        {"label": "Person", "source": "clean/people", "id_field": "id", "er_fields": ["email", "phone"], "origin": "source", "properties": ["email"], "cursor": "updated_at"},
        {"label": "Sale", "source": "clean/sales", "id_field": "sale", "properties": ["amount"], "cursor": "updated_at"},
    ],
    "edges": [
        {"type": "BUYER", "source": "clean/sales", "from_label": "Sale", "from_key": "sale", "to_label": "Person", "to_key": "person"},
        {"type": "BOUGHT", "source": "clean/sales", "from_label": "Person", "from_key": "person", "to_label": "Sale", "to_key": "sale"},
        {"type": "VOUCHES", "source": "clean/people", "from_label": "Person", "from_key": "id", "to_label": "Person", "to_key": "friend"},
    ],
    "timeline": [{"type": "PAID", "source": "clean/sales", "label": "Person", "key": "person", "timestamp": "updated_at", "properties": ["sale"]}],
}
PEOPLE_COLUMNS = "id int, source string, email string, phone string, friend int, updated_at timestamp_ntz"


def _people(rng, day, count=40):
    """Rows whose few values make components of several rows; some have none, some no id."""
    stamp = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)
    for i in range(count):
        email = rng.choice([None, f"m{rng.randrange(30)}@x.org"])
        phone = rng.choice([None, None, f"+5511{rng.randrange(900000010, 900000035)}"])
        yield (i if i % 13 else None, "ab"[i % 2], email, phone, rng.randrange(count + 3), stamp + datetime.timedelta(seconds=i))


@pytest.mark.parametrize("fields", [["email", "phone"], ["email"]])
def test_refresh_with_identity_fields_equals_a_rebuild(spark, lake, fields):
    rng = random.Random(len(fields))
    document = {**PEOPLE, "nodes": [{**PEOPLE["nodes"][0], "er_fields": fields}, PEOPLE["nodes"][1]]}
    ontology = parse_ontology(document)
    rows = list(_people(rng, 0))
    lake.write("clean", "people", spark.createDataFrame(rows, PEOPLE_COLUMNS))
    sales = [(s, rng.randrange(45), float(s), datetime.datetime(2024, 1, 1, 0, 0, s)) for s in range(50)]
    lake.write("clean", "sales", spark.createDataFrame(sales, "sale int, person int, amount double, updated_at timestamp_ntz"))
    build_graph(lake, ontology)
    step = 1
    since = {"clean/people": max(r[-1] for r in rows), "clean/sales": datetime.datetime(2024, 1, 1, 0, 0, 59)}
    other = list(_people(rng, step, len(rows)))
    rows = [new if rng.random() < 0.15 else old for old, new in zip(rows, other, strict=True) if rng.random() > 0.08]
    joins = datetime.datetime(2024, 1, 1 + step, 1)
    rows.append((100 + step, "a", "m1@x.org", "+5511900000012", 3, joins))
    lake.write("clean", "people", spark.createDataFrame(rows, PEOPLE_COLUMNS))
    graph = refresh_graph(lake, ontology, since)
    fresh = build_graph(lake, ontology, suffix=f"_again{step}")
    for part in ("nodes", "edges", "events"):
        found, expected = ({tuple(r) for r in getattr(g, part).collect()} for g in (graph, fresh))
        assert found == expected, (part, step, found ^ expected)


def test_refresh_without_stored_state_makes_everything_anew(spark, lake):
    ontology = parse_ontology(PEOPLE)
    lake.write("clean", "people", spark.createDataFrame(list(_people(random.Random(9), 0)), PEOPLE_COLUMNS))
    lake.write("clean", "sales", spark.createDataFrame([(1, 2, 3.0, datetime.datetime(2024, 1, 1))], "sale int, person int, amount double, updated_at timestamp_ntz"))
    never = datetime.datetime(2030, 1, 1)
    graph = refresh_graph(lake, ontology, {"clean/people": never})
    fresh = build_graph(lake, ontology, suffix="_again")
    for part in ("nodes", "edges", "events"):
        assert {tuple(r) for r in getattr(graph, part).collect()} == {tuple(r) for r in getattr(fresh, part).collect()}


def test_edges_without_a_start_are_looked_up_once_for_types_of_the_same_rows(spark, monkeypatch):
    from tarn.graph import project
    from tarn.graph.entities import node_id

    ontology = parse_ontology({
        "version": 1,
        "nodes": [{"label": "A", "source": "clean/a", "id_field": "id"}, {"label": "B", "source": "clean/b", "id_field": "id"}],
        "edges": [
            {"type": t, "source": s, "from_label": "A", "from_key": "id", "to_label": "B", "to_key": k}
            for t, s, k in (("ONE", "clean/a", "x"), ("TWO", "clean/a", "y"), ("BOTH", "clean/a", "x"), ("BOTH", "clean/b", "x"))
        ],
    })
    tables = {"clean/a": spark.createDataFrame([(1,), (1,), (None,)], "id int"), "clean/b": spark.createDataFrame([(2,)], "id int")}
    origins, asked = {}, []
    for e in ontology.edges:
        origins.setdefault(e.type, {})[e.source, e.from_key, e.from_label] = e
    starts = project._starts
    monkeypatch.setattr(project, "_starts", lambda e, *rest: asked.append(e.source) or starts(e, *rest))
    kept = spark.createDataFrame([(t, k) for t in ("ONE", "TWO", "BOTH", "OLD") for k in (1, 2, 3)], "type string, k int")
    kept = kept.withColumn("src", node_id("A", "k"))
    gone = project._without_start(kept.select("type", "src"), ontology, origins, tables, {}).join(kept, ["type", "src"])
    assert sorted((r["type"], r["k"]) for r in gone.collect()) == [("BOTH", 3), ("OLD", 1), ("OLD", 2), ("OLD", 3), ("ONE", 2), ("ONE", 3), ("TWO", 2), ("TWO", 3)]
    assert sorted(asked) == ["clean/a", "clean/a", "clean/b"]


def test_lake_files_are_zstd_and_digests_keep_rows_apart(spark, lake):
    from tarn.queries.graphs import _same_rows

    lake.write("graph", "nodes", spark.range(3))
    assert all(".zstd.parquet" in r["file_path"] for r in lake.data_files("graph/nodes").collect())
    rows = [("a", "bc"), ("ab", "c"), ("1:", "x"), (None, "n")]
    stored = spark.createDataFrame(rows, "u string, v string")
    other = spark.createDataFrame([("a", "bc"), (":1", "x"), (None, "n")], "u string, v string")
    assert tuple(_same_rows(stored, other).first()) == (4, 1)


def test_contracts_are_dealt_by_their_rows(spark, tmp_path, monkeypatch):
    from tarn.queries.inputs import contracts

    monkeypatch.setattr("tarn.session.ROWS_A_TASK", 10)
    spark.range(40).selectExpr("id % 20 l_orderkey", "id l_suppkey", "id l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(30).selectExpr(
        "id o_orderkey", "id o_custkey", "'O' o_orderstatus", "1.0D o_totalprice", "timestamp_ntz'2020-01-01 00:00:00' o_orderdate"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    found = contracts(spark, str(tmp_path))
    assert found.count() == 30 and found.where("second_party = external_id").count() == 20
    assert found.rdd.getNumPartitions() == 7


def test_refreshed_edges_are_hidden_by_one_join_and_their_rows_read_once(spark, filled, monkeypatch):
    from tarn.graph import project

    ontology = parse_ontology(MAP)
    build_graph(filled, ontology)
    contracts = filled.read("clean/contracts")
    mark = contracts.agg(F.max("updated_at")).first()[0]
    late = F.timestamp_add("DAY", F.lit(500), F.col("updated_at"))
    moved = contracts.where("contract_id IN (3, 4)").withColumns({"product_id": F.lit(1).cast(contracts.schema["product_id"].dataType), "updated_at": late})
    filled.write("clean", "contracts", moved, "merge", pk="contract_id")
    read = []
    cut = project.cut_lineage
    monkeypatch.setattr(project, "cut_lineage", lambda df: read.append(df.columns) or cut(df))
    graph = refresh_graph(filled, ontology, {"clean/contracts": mark})
    assert read.count(["_touched"]) == 1
    segments = filled._require("graph", "edges").segments
    assert {tuple(s.keys) for s in segments[1:]} == {("type", "src")}
    assert graph.edges._jdf.queryExecution().optimizedPlan().toString().count("Join LeftAnti") == 1
    fresh = build_graph(filled, ontology, suffix="_again")
    for part in ("nodes", "edges"):
        assert sorted(map(tuple, getattr(graph, part).collect())) == sorted(map(tuple, getattr(fresh, part).collect()))


def test_maps_of_one_type_leave_one_edge_a_key_after_a_refresh(spark, lake):
    stamp = datetime.datetime(2024, 1, 1)
    for name in ("a", "b"):
        lake.write("clean", name, spark.createDataFrame([(1, 2, stamp), (None, 2, stamp)], "id int, to int, updated_at timestamp_ntz"))
    ontology = parse_ontology({
        "nodes": [{"label": "A", "source": "clean/a", "id_field": "id"}],
        "edges": [{"type": "T", "source": s, "from_label": "A", "from_key": "id", "to_label": "A", "to_key": "to"} for s in ("clean/a", "clean/b")],
    })
    graph = refresh_graph(lake, ontology, {})
    assert (graph.nodes.count(), graph.edges.count()) == (1, 1)


def test_equal_events_are_one_and_clocks_put_back_make_no_second_id(spark):
    from tarn.graph import project
    from tarn.graph.ontology import NodeMap, TimelineMap

    rows = spark.sql(
        "SELECT * FROM VALUES (1, 1730611800L, 'x', 1), (1, 1730611800L, 'x', 2), (1, 1730615400L, 'x', 3), (2, 1730611800L, 'x', 4),"
        " (1, 1730611800L, NULL, 5), (1, 1730611800L, NULL, 6), (NULL, 1730611800L, 'x', 7), (1, NULL, 'x', 8) AS t(k, s, kind, n)"
    ).select("k", F.timestamp_seconds("s").alias("at_time"), "kind", "n")
    event, node = TimelineMap("E", "clean/e", "A", "k", "at_time", ("kind",)), NodeMap("A", "clean/a", "id")
    zone = spark.conf.get("spark.sql.session.timeZone")
    for place, ids in (("UTC", 4), ("America/Los_Angeles", 4), ("America/New_York", 3)):
        spark.conf.set("spark.sql.session.timeZone", place)
        try:
            found = [r.event_id for r in project.project_events(event, rows, node).collect()]
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)
        assert len(found) == len(set(found)) == ids


def test_rows_are_compared_by_sums_and_only_parts_that_differ_are_joined(spark):
    from tarn.queries.graphs import _same_rows

    rows = spark.range(3000).selectExpr("CAST(id % 2900 AS STRING) u", "'v' v")
    assert tuple(_same_rows(rows, rows).first()) == (3000, 3000)
    assert tuple(_same_rows(rows, rows.distinct()).first()) == (3000, 3000)
    assert tuple(_same_rows(rows, rows.where("u NOT IN ('7', '2899')")).first()) == (3000, 2997)
    assert tuple(_same_rows(rows, rows.withColumn("v", F.lit("w"))).first()) == (3000, 0)
    assert tuple(_same_rows(rows.limit(0), rows).first()) == (0, 0)
