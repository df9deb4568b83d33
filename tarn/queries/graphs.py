"""Clean tables to a graph, and questions asked of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.graph import query as graph_query
from tarn.graph.entities import resolve_entities
from tarn.graph.ontology import OntologyHistory, ontology_problems, parse_ontology
from tarn.graph.project import Graph, build_graph, ghost_entities as ghosts
from tarn.graph.project import project_graph, refresh_graph
from tarn.graph.project import sanitize_props as sanitize
from tarn.queries.columns import unified
from tarn.queries.inputs import CONTRACTS, RECENT, contracts, products, users
from tarn.queries.registry import new_lake, query, row_counts_of, table, uuid5_sql
from tarn.session import cut_lineage, scratch_path

ONTOLOGY = {
    "version": 1,
    "nodes": [
        {"label": "User", "source": "clean/users", "id_field": "external_id", "properties": ["name"], "cursor": "updated_at"},
        {"label": "Product", "source": "clean/products", "id_field": "product_id", "properties": ["product_name"]},
        {"label": "Contract", "source": "clean/contracts", "id_field": "external_id", "properties": ["status"], "cursor": "updated_at"},
    ],
    "edges": [
        {"type": "FIRST_PARTY", "source": "clean/contracts", "from_label": "Contract", "from_key": "external_id", "to_label": "User", "to_key": "first_party"},
        {"type": "SECOND_PARTY", "source": "clean/contracts", "from_label": "Contract", "from_key": "external_id", "to_label": "User", "to_key": "second_party"},
        {"type": "ABOUT", "source": "clean/contracts", "from_label": "Contract", "from_key": "external_id", "to_label": "Product", "to_key": "product_id"},
    ],
    "timeline": [
        {"type": "ACTION", "source": "clean/events", "label": "User", "key": "user_id", "timestamp": "ts", "properties": ["event_type"]},
    ],
}

NODES = f"""
SELECT {uuid5_sql("label || ':' || entity_key")} AS entity_id, label, entity_key, name FROM (
  SELECT 'User' AS label, c_custkey::VARCHAR AS entity_key, trim(c_name) AS name FROM customer
  UNION ALL SELECT 'Product', p_partkey::VARCHAR, p_name FROM part
  UNION ALL SELECT 'Contract', o_orderkey::VARCHAR, o_orderstatus FROM orders)
"""
EDGE_KEYS = f"""
SELECT 'FIRST_PARTY' AS type, 'Contract:' || external_id AS s, 'User:' || first_party AS t FROM ({CONTRACTS})
UNION ALL SELECT 'SECOND_PARTY', 'Contract:' || external_id, 'User:' || second_party FROM ({CONTRACTS}) WHERE second_party IS NOT NULL
UNION ALL SELECT 'ABOUT', 'Contract:' || external_id, 'Product:' || product_id FROM ({CONTRACTS}) WHERE product_id IS NOT NULL
"""
EDGES = f"SELECT type, {uuid5_sql('s')} AS src, {uuid5_sql('t')} AS dst FROM ({EDGE_KEYS})"


def _digest(*columns: str):
    """128 bits of the SHA-256 of the texts of a row, NULL if one of them is: 16 bytes to compare instead of the row."""
    text = F.concat(*[part for c in columns for part in (F.length(c), F.lit(":"), F.col(c))])
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("_row")


#: Parts that rows are compared by; those of equal sums need no join.
PARTS_COMPARED = 1024


def _part():
    """Part of a digest; NULL ones, which equal nothing, are one of their own."""
    return F.when(F.col("_row").isNotNull(), F.pmod(F.xxhash64("_row"), F.lit(PARTS_COMPARED)))


def _sums(rows: DataFrame) -> dict[int | None, tuple[int, ...]]:
    """Count of the rows of each part, and sums of two hashes of each digest, 32 bits at a time."""
    halves = [F.xxhash64(F.lit(i), "_row") for i in (1, 2)]
    words = [w for h in halves for w in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    found = rows.groupBy(_part().alias("part")).agg(F.count("*"), *[F.sum(w) for w in words])
    return {r[0]: tuple(r[1:]) for r in found.collect()}


def _same_digests(stored: DataFrame, anew: DataFrame) -> DataFrame:
    """``stored`` rows and those of them that are in ``anew``, by their digests.

    Each side is summed up by parts of its digests where it lies. Parts that have the same rows
    have the same sums; the rows of the others, and only they, are joined.
    """
    held, made = _sums(stored), _sums(anew)
    other = [p for p, sums in held.items() if p is not None and made.get(p) != sums]
    same = sum(sums[0] for p, sums in held.items() if p is not None and p not in other)
    if other:
        differ = _part().isin(other)
        same += stored.where(differ).join(anew.where(differ), "_row", "left_semi").count()
    total = sum(sums[0] for sums in held.values())
    return stored.sparkSession.createDataFrame([(total, same)], "stored bigint, same bigint")


def _same_rows(stored: DataFrame, anew: DataFrame) -> DataFrame:
    row = _digest(*stored.columns)
    return _same_digests(stored.select(row), anew.select(row))


def clean_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {
        "clean/users": users(spark, d),
        "clean/products": products(spark, d),
        "clean/contracts": contracts(spark, d),
        "clean/events": table(spark, d, "events"),
    }


def projected(spark: SparkSession, d: str, *parts: str) -> Graph:
    return project_graph(parse_ontology(ONTOLOGY), clean_tables(spark, d).__getitem__, parts)


def _clean_lake(spark: SparkSession, d: str):
    lake = new_lake(spark)
    for name, df in clean_tables(spark, d).items():
        lake.write(*name.split("/"), df)
    return lake


def stored(spark: SparkSession, d: str) -> Graph:
    """The graph as tables, for questions that read it more than once."""
    lake, graph = new_lake(spark), projected(spark, d, "nodes", "edges")
    lake.write("graph", "nodes", graph.nodes)
    lake.write("graph", "edges", graph.edges)
    return Graph(lake.read("graph/nodes"), lake.read("graph/edges"))


@query(NODES)
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    name = F.coalesce(*[F.get_json_object("props", f"$.{p}") for p in ("name", "product_name", "status")])
    return projected(spark, d, "nodes").nodes.select("entity_id", "label", "entity_key", name.alias("name"))


@query(EDGES)
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return projected(spark, d, "edges").edges.select("type", "src", "dst")


_EVENT = """'ACTION|' || entity_id || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '|{"event_type":"' || event_type || '"}'"""


@query(f"""
SELECT {uuid5_sql(_EVENT)} AS event_id, entity_id, event_type FROM (
  SELECT {uuid5_sql("'User:' || user_id")} AS entity_id, ts, event_type FROM events)
""")
def graph_events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.get_json_object("props", "$.event_type").alias("event_type")
    return projected(spark, d, "events").events.select("event_id", "entity_id", kind)


@query(f"""
SELECT 'node' AS kind, label AS name, count(*) AS elements FROM ({NODES}) GROUP BY label
UNION ALL SELECT 'edge', type, count(*) FROM ({EDGE_KEYS}) GROUP BY type
""")
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph_query.graph_counts(projected(spark, d, "nodes", "edges"))


@query(f"""
SELECT out_degree, in_degree, count(*) AS n_nodes FROM (
  SELECT e, sum(o) AS out_degree, sum(i) AS in_degree FROM (
    SELECT s AS e, 1 AS o, 0 AS i FROM ({EDGE_KEYS}) UNION ALL SELECT t, 0, 1 FROM ({EDGE_KEYS})) GROUP BY e)
GROUP BY out_degree, in_degree
""")
def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    degrees = graph_query.degrees(projected(spark, d, "edges"))
    return degrees.groupBy("out_degree", "in_degree").agg(F.count("*").alias("n_nodes"))


def _partial(spark: SparkSession, d: str) -> Graph:
    """The graph when the users of one segment are missing."""
    graph = stored(spark, d)
    gone = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").cast("string").alias("entity_key"), F.lit("User").alias("label")
    )
    return Graph(graph.nodes.join(gone, ["entity_key", "label"], "left_anti"), graph.edges)


_ORPHAN = "t IN (SELECT 'User:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"


@query(f"""
SELECT type, count(*) AS total_edges, count(*) FILTER (WHERE NOT {_ORPHAN}) AS resolved_edges,
       count(*) FILTER (WHERE {_ORPHAN}) AS orphan_edges FROM ({EDGE_KEYS}) GROUP BY type
""")
def edge_resolution(spark: SparkSession, d: str) -> DataFrame:
    return graph_query.edge_quality(_partial(spark, d))


@query(f"SELECT type, {uuid5_sql('s')} AS src, {uuid5_sql('t')} AS dst FROM ({EDGE_KEYS}) WHERE {_ORPHAN}")
def orphan_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph_query.orphan_edges(_partial(spark, d)).select("type", "src", "dst")


@query("""
SELECT entity_key, count(*) AS n_rows, true AS id_repeats FROM (
  SELECT CASE WHEN c_acctbal < 0 THEN 'postgres:postgres:' || c_custkey ELSE 'user' || c_custkey || '@mail.test' END AS entity_key
  FROM customer UNION ALL SELECT 'user' || s_suppkey || '@mail.test' FROM supplier) GROUP BY entity_key
""")
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two sources that share an e-mail are one entity; no e-mail, own entity."""
    poor = table(spark, d, "customer").where("c_acctbal < 0").select(
        F.concat(F.lit("postgres:"), "c_custkey").alias("external_id"), F.lit(True).alias("poor")
    )
    rows = unified(spark, d).join(poor, "external_id", "left")
    rows = rows.withColumn("email", F.when(F.col("poor").isNull(), F.col("email")))
    resolved = resolve_entities(rows, "Person", "external_id", ["email"], origin="source")
    return resolved.groupBy("entity_key").agg(
        F.count("*").alias("n_rows"), (F.countDistinct("entity_id") == 1).alias("id_repeats")
    )


@query("""
WITH s AS (SELECT count(*) AS n FROM supplier)
SELECT entity_size, count(*) AS n_entities FROM (
  SELECT CASE WHEN c_custkey <= n THEN -1 ELSE c_custkey END AS e, count(*)
         + CASE WHEN min(c_custkey) <= max(n) THEN max(n) ELSE 0 END AS entity_size
  FROM customer, s GROUP BY e) GROUP BY entity_size
""")
def entity_components(spark: SparkSession, d: str) -> DataFrame:
    """Two identity fields: suppliers tie the e-mail of one customer to the phone of the next."""
    key = F.col("c_custkey")
    people = table(spark, d, "customer").select(
        F.concat(F.lit("c"), key).alias("id"),
        F.concat(F.lit("User"), key, F.lit("@mail.test")).alias("email"), key.cast("string").alias("phone"),
    )
    firm = F.col("s_suppkey")
    firms = table(spark, d, "supplier").select(
        F.concat(F.lit("s"), firm).alias("id"),
        F.concat(F.lit("user"), firm, F.lit("@mail.test")).alias("email"), (firm + 1).cast("string").alias("phone"),
    )
    resolved = resolve_entities(people.unionByName(firms), "Person", "id", ["email", "phone"])
    return (
        resolved.groupBy("entity_id").agg(F.count("*").alias("entity_size"))
        .groupBy("entity_size").agg(F.count("*").alias("n_entities"))
    )


@query(f"""
SELECT c.external_id::VARCHAR AS center_key, c.status, trim(a.c_name) AS first_name, trim(b.c_name) AS second_name,
       p_name AS product_product_name, first_party::VARCHAR AS first_key, second_party::VARCHAR AS second_key,
       product_id::VARCHAR AS product_key
FROM ({CONTRACTS}) c JOIN customer a ON first_party = a.c_custkey JOIN customer b ON second_party = b.c_custkey
JOIN part ON product_id = p_partkey
""")
def contract_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Contracts with both parties and their product, matched in the graph."""
    return graph_query.match_star(
        stored(spark, d), "Contract",
        {"FIRST_PARTY": "first", "SECOND_PARTY": "second", "ABOUT": "product"},
        {"Contract": "status", "first": "name", "second": "name", "product": "product_name"},
        {"FIRST_PARTY": "User", "SECOND_PARTY": "User", "ABOUT": "Product"},
    )


@query(f"""
SELECT least(1000, count(*)) AS n_edges, least(1000, count(*)) AS n_known, true AS ends_present, true AS connected FROM ({EDGE_KEYS})
""")
def edge_sample(spark: SparkSession, d: str) -> DataFrame:
    """An edge-seeded sample: both ends of every edge are in it, and no other node."""
    graph = stored(spark, d)
    sample = graph_query.edge_seeded_sample(graph, 1000)
    ends = sample.edges.select(F.col("src").alias("entity_id")).union(sample.edges.select("dst")).distinct()
    loose = sample.nodes.join(ends, "entity_id", "left_anti")
    known = sample.edges.join(graph.edges.select("type", "src", "dst"), ["type", "src", "dst"], "left_semi")
    counts = row_counts_of(n_edges=sample.edges, n_known=known, n_nodes=sample.nodes, n_ends=ends, n_loose=loose)
    return counts.select(
        "n_edges", "n_known", (F.col("n_nodes") == F.col("n_ends")).alias("ends_present"),
        (F.col("n_loose") == 0).alias("connected"),
    )


@query(f"""
SELECT type, {uuid5_sql('s')} AS src, {uuid5_sql('t')} AS dst FROM ({EDGE_KEYS})
WHERE t IN (SELECT 'User:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
""")
def graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """One hop around the users of a segment; incoming edges are found too."""
    graph = stored(spark, d)
    segment = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    keys = segment.select(F.col("c_custkey").cast("string").alias("entity_key"))
    seeds = graph.nodes.where("label = 'User'").join(keys, "entity_key", "left_semi").select("entity_id")
    return graph_query.neighbors(graph, seeds).edges.select("type", "src", "dst")


@query(f"""
WITH slice AS (SELECT o_orderkey FROM orders ORDER BY o_orderkey::VARCHAR LIMIT 500),
e AS (SELECT * FROM ({EDGE_KEYS}) WHERE s IN (SELECT 'Contract:' || o_orderkey FROM slice))
SELECT split_part(x, ':', 1) AS label, count(DISTINCT x) AS n_nodes
FROM (SELECT s AS x FROM e UNION ALL SELECT t FROM e) GROUP BY 1
""")
def graph_slice(spark: SparkSession, d: str) -> DataFrame:
    """A representative slice: contracts with everything they link to."""
    sliced = graph_query.slice_graph(stored(spark, d), "Contract", 500)
    return sliced.nodes.groupBy("label").agg(F.count("*").alias("n_nodes"))


@query(f"""
SELECT 'nodes' AS part, label AS name, count(*) AS n_rows FROM ({NODES}) GROUP BY label
UNION ALL SELECT 'edges', type, count(*) FROM ({EDGE_KEYS}) GROUP BY type
""")
def graph_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Bulk-load files read back; every row that comes back unchanged is counted."""
    path = scratch_path(spark, "csv")
    graph = stored(spark, d)
    graph_query.export_csv(graph, path)
    back = graph_query.import_csv(spark, path)
    node = _digest("entity_id", "entity_key", "props", "label")
    nodes = back.nodes.select("label", node).join(graph.nodes.select(node), "_row", "left_semi")
    edge = _digest("type", "src", "dst", "props")
    edges = back.edges.select("type", edge).join(graph.edges.select(edge), "_row", "left_semi")
    count = F.count("*").alias("n_rows")
    return nodes.groupBy(F.lit("nodes").alias("part"), F.col("label").alias("name")).agg(count).unionByName(
        edges.groupBy(F.lit("edges").alias("part"), F.col("type").alias("name")).agg(count)
    )


@query(f"""
SELECT entity_id, label FROM ({NODES}) WHERE label = 'Product'
""")
def ghost_entities(spark: SparkSession, d: str) -> DataFrame:
    """Nodes stored under an older map that the current one no longer makes."""
    lake = _clean_lake(spark, d)
    stored = build_graph(lake, parse_ontology(ONTOLOGY)).nodes
    smaller = {
        "version": 2,
        "nodes": [n for n in ONTOLOGY["nodes"] if n["label"] != "Product"],
        "edges": [e for e in ONTOLOGY["edges"] if e["to_label"] != "Product"],
    }
    current = project_graph(parse_ontology(smaller), clean_tables(spark, d).__getitem__)
    return ghosts(stored, current.nodes).select("entity_id", "label")


@query(f"""
SELECT 'first' AS build, 'Contract' AS label, count(*) AS n_nodes FROM orders
UNION ALL SELECT 'first', 'Product', count(*) FROM part UNION ALL SELECT 'first', 'User', count(*) FROM customer
UNION ALL SELECT 'second', 'Contract', count(*) FROM orders WHERE o_orderdate < TIMESTAMP '{RECENT}'
UNION ALL SELECT 'second', 'User', count(*) FROM customer
""")
def graph_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Graph of (clean snapshot x ontology version): yesterday's can be built again."""
    lake = _clean_lake(spark, d)
    history = OntologyHistory(lake)
    first = history.save(ONTOLOGY)
    old = lake.read("clean/contracts").where(F.col("updated_at") < F.lit(RECENT).cast("timestamp_ntz"))
    lake.write("clean", "contracts", old)
    second = history.save(
        {
            "nodes": [n for n in ONTOLOGY["nodes"] if n["label"] != "Product"],
            "edges": [e for e in ONTOLOGY["edges"] if e["to_label"] != "Product"],
        }
    )
    builds = {
        "second": build_graph(lake, None, {}, second, suffix="_second"),
        "first": build_graph(lake, None, {"clean/contracts": 1}, first, suffix="_first"),
    }
    frames = [
        g.nodes.groupBy("label").agg(F.count("*").alias("n_nodes")).withColumn("build", F.lit(n))
        for n, g in builds.items()
    ]
    return frames[0].unionByName(frames[1])


@query(f"""
SELECT 'edges' AS part, count(*) AS stored, count(*) AS same FROM ({EDGE_KEYS}) WHERE s NOT IN (SELECT 'Contract:' || o_orderkey FROM orders WHERE o_orderkey % 11 = 0)
UNION ALL SELECT 'nodes', count(*), count(*) FROM ({NODES}) WHERE label <> 'Contract' OR entity_key NOT IN (SELECT o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 11 = 0)
""")
def graph_refresh_equals_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Contracts that moved to another product, and deleted ones: refreshed as if built anew."""
    lake = _clean_lake(spark, d)
    ontology = parse_ontology(ONTOLOGY)
    build_graph(lake, ontology)
    contracts = lake.read("clean/contracts")
    mark = contracts.agg(F.max("updated_at")).first()[0]
    latest = lake.read("clean/users").agg(F.max("updated_at")).first()[0]
    moved = contracts.where("external_id % 11 = 1 AND product_id IS NOT NULL").withColumns({
        "product_id": (F.col("product_id") % 50 + 1).cast(contracts.schema["product_id"].dataType),
        "updated_at": F.timestamp_add("DAY", F.lit(1), F.lit(mark).cast("timestamp_ntz")),
    })
    lake.write("clean", "contracts", moved, "merge", pk="external_id")
    gone = contracts.where("external_id % 11 = 0").select("external_id")
    lake.delete_where_in("clean/contracts", "external_id", gone)
    graph = refresh_graph(lake, ontology, {"clean/contracts": mark, "clean/users": latest})
    fresh = build_graph(lake, ontology, suffix="_fresh")
    frames = []
    for part in ("edges", "nodes"):
        row = _digest(*[c for c in getattr(graph, part).columns if c != "updated_at"])
        counts = _same_digests(lake.read_derived(("graph", part), row), getattr(fresh, part).select(row))
        frames.append(counts.select(F.lit(part).alias("part"), "stored", "same"))
    return frames[0].unionByName(frames[1])


IDENTITIES = {
    "nodes": [
        {"label": "Person", "source": "clean/people", "id_field": "id", "er_fields": ["household", "badge"], "cursor": "updated_at"},
        {"label": "Sale", "source": "clean/sales", "id_field": "sale"},
    ],
    "edges": [{"type": "BUYER", "source": "clean/sales", "from_label": "Sale", "from_key": "sale", "to_label": "Person", "to_key": "person"}],
}


@query("""
WITH people AS (
  SELECT c_custkey AS id, c_custkey // 3 AS house FROM customer WHERE c_custkey % 30 <> 7
), entities AS (
  SELECT id, CASE house % 4 WHEN 0 THEN 'alone ' || house WHEN 2 THEN 'left ' || house
    WHEN 1 THEN 'joined ' || (house // 4) ELSE 'joined ' || (house // 4 + 1) END AS entity FROM people
), counts AS (
  SELECT 'nodes' AS part, (SELECT count(DISTINCT entity) FROM entities) + (SELECT count(*) FROM orders) AS n
  UNION ALL SELECT 'edges', count(*) FROM orders WHERE o_custkey IS NOT NULL
  UNION ALL SELECT 'buyers', count(DISTINCT coalesce(entity, 'none ' || o_custkey)) FROM orders LEFT JOIN entities ON o_custkey = id
)
SELECT part, n AS stored, n AS same FROM counts
""")
def graph_refresh_identities(spark: SparkSession, d: str) -> DataFrame:
    """Households joined by the badge of one member: badges move, members go, and the graph follows by delta.

    Every two households share a badge at first. Then one of four loses it and is alone, and
    another takes that of a household it had nothing to do with.
    """
    lake, ontology = new_lake(spark), parse_ontology(IDENTITIES)
    house = F.floor(F.col("id") / 3)
    first = F.col("id") % 3 == 0
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("id")).select(
        "id", house.cast("string").alias("household"), F.when(first, F.floor(F.col("id") / 6)).cast("string").alias("badge"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("updated_at"),
    )
    lake.write("clean", "people", people)
    lake.write("clean", "sales", table(spark, d, "orders").select(F.col("o_orderkey").alias("sale"), F.col("o_custkey").alias("person")).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp_ntz")))
    build_graph(lake, ontology)
    moved = lake.read("clean/people").where(first & (house % 4).isin(0, 3)).withColumns({
        "badge": F.when(house % 4 == 3, F.floor((F.col("id") + 3) / 6)).cast("string"),
        "updated_at": F.lit("2024-01-02").cast("timestamp_ntz"),
    })
    gone = lake.read("clean/people").where("id % 30 = 7").select("id")
    lake.write("clean", "people", moved, "merge", pk="id")
    lake.delete_where_in("clean/people", "id", gone)
    mark = "2024-01-01 00:00:00"
    graph = refresh_graph(lake, ontology, {"clean/people": mark, "clean/sales": mark})
    fresh = build_graph(lake, ontology, suffix="_fresh")
    edges = cut_lineage(graph.edges.select("type", "src", "dst"))
    frames = []
    for part, old, new in (
        ("nodes", graph.nodes.select("entity_id", "entity_key"), fresh.nodes.select("entity_id", "entity_key")),
        ("edges", edges, fresh.edges.select("type", "src", "dst")),
        ("buyers", edges.select("dst").distinct(), fresh.edges.select("dst").distinct()),
    ):
        counts = _same_rows(old, new)
        frames.append(counts.select(F.lit(part).alias("part"), "stored", "same"))
    return reduce(DataFrame.unionByName, frames)


@query(f"""
SELECT label, status, count(*) AS n_nodes FROM (
  SELECT 'Contract' AS label, CASE WHEN o_orderdate >= TIMESTAMP '{RECENT}' THEN 'X' ELSE o_orderstatus END AS status FROM orders
  UNION ALL SELECT 'Product', NULL FROM part UNION ALL SELECT 'User', NULL FROM customer) GROUP BY label, status
""")
def graph_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Only contracts changed after the mark are projected again, and merged by id."""
    lake = _clean_lake(spark, d)
    ontology = parse_ontology(ONTOLOGY)
    build_graph(lake, ontology)
    mark = lake.read("clean/contracts").agg(F.max("updated_at")).first()[0]
    recent = lake.read("clean/contracts").where(F.col("updated_at") >= F.lit(RECENT).cast("timestamp_ntz"))
    changed = recent.withColumns(
        {"status": F.lit("X"), "updated_at": F.timestamp_add("DAY", F.lit(400), F.col("updated_at"))}
    )
    lake.write("clean", "contracts", changed, "merge", pk="external_id")
    latest = lake.read("clean/users").agg(F.max("updated_at")).first()[0]
    graph = refresh_graph(lake, ontology, {"clean/contracts": mark, "clean/users": latest})
    status = F.get_json_object("props", "$.status").alias("status")
    return graph.nodes.groupBy("label", status).agg(F.count("*").alias("n_nodes"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS o_orderdate,
       o_totalprice AS price, lower(hex(encode(o_orderpriority))) AS raw, strftime(o_orderdate, '%Y-%m-%d') AS day
FROM orders
""")
def sanitize_props(spark: SparkSession, d: str) -> DataFrame:
    """Dates, decimals and bytes as primitives."""
    orders = table(spark, d, "orders").select(
        "o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        F.col("o_orderpriority").cast("binary").alias("raw"), F.col("o_orderdate").cast("date").alias("day"),
    )
    return sanitize(orders)


@query("""
SELECT 'ABOUT' AS entry, 'clean/contracts has no column sku' AS problem, count(*) AS n_rows FROM orders
UNION ALL SELECT 'ABOUT', 'unknown label Item', count(*) FROM orders
""")
def ontology_validation(spark: SparkSession, d: str) -> DataFrame:
    """A map checked against the real columns of the clean tables."""
    edges = [{**e, "to_label": "Item", "to_key": "sku"} if e["type"] == "ABOUT" else e for e in ONTOLOGY["edges"]]
    tables = clean_tables(spark, d)
    problems = ontology_problems(
        parse_ontology({**ONTOLOGY, "edges": edges}), {n: t.columns for n, t in tables.items()}
    )
    frames = [
        tables["clean/contracts"].agg(F.count("*").alias("n_rows")).select(
            F.lit(entry).alias("entry"), F.lit(problem).alias("problem"), "n_rows"
        )
        for entry, problem in problems
    ]
    return reduce(DataFrame.unionByName, frames)
