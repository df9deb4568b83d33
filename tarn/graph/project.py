"""Clean tables to node, edge and event tables, in sets and never row by row."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.ids import packed_text, unpacked_text, uuid5
from tarn.graph.entities import fallback_key, node_id, with_entity_key
from tarn.graph.identity import (
    EntityChange,
    keys_of_same_entities,
    refresh_entities,
    rows_of_entities,
    state_index,
    store_entities,
)
from tarn.graph.ontology import EdgeMap, NodeMap, Ontology, OntologyHistory, TimelineMap, validate_ontology
from tarn.lake.store import LakeStore
from tarn.operators.merge import keep_latest, without_keys
from tarn.session import cut_lineage

NODE_COLUMNS = ["entity_id", "label", "entity_key", "props", "updated_at"]
EDGE_KEY = ["type", "src", "dst"]
EDGE_START = ["type", "src"]
#: Types whose values differ exactly where their texts do.
PLAIN_TYPES = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.StringType())


def primitive(field: T.StructField) -> Column:
    """Column as a primitive a graph property can hold."""
    col = F.col(field.name)
    if isinstance(field.dataType, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    if isinstance(field.dataType, T.TimestampNTZType):
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(field.dataType, T.TimestampType):
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    if isinstance(field.dataType, T.DecimalType):
        return col.cast("double")
    if isinstance(field.dataType, T.BinaryType):
        return F.lower(F.hex(col))
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col)
    return col


def sanitize_props(df: DataFrame) -> DataFrame:
    """Every column as text, number or boolean."""
    return df.select(*[primitive(f).alias(f.name) for f in df.schema])


def _props(df: DataFrame, properties: Sequence[str]) -> Column:
    if not properties:
        return F.lit("{}")
    fields = [primitive(df.schema[p]).alias(p) for p in properties]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _plain(df: DataFrame, key: str) -> bool:
    return df.schema[key].dataType in PLAIN_TYPES


def _cursor(name: str | None) -> Column:
    return (F.col(name) if name else F.lit(None)).cast("timestamp").alias("updated_at")


def keyed_rows(node: NodeMap, clean: DataFrame) -> DataFrame:
    """The mapped columns of a clean table plus the ``entity_key`` of each row."""
    return with_entity_key(
        clean.select(*node.columns()), node.id_field, node.er_fields, node.origin
    ).where("entity_key IS NOT NULL")


def project_nodes(node: NodeMap, keyed: DataFrame) -> DataFrame:
    """One node per entity; of several rows of one entity the latest gives the properties.

    Rows are reduced to one per key before ids and property texts are made, so the
    shuffle carries only the mapped columns.
    """
    if node.by_key and not node.origin and node.id_field != "entity_key" and _plain(keyed, node.id_field):
        # The key as it is: rows that a merge has just placed by it stay where they are.
        latest = keep_latest(keyed.drop("entity_key"), node.id_field, node.cursor)
        latest = latest.withColumn("entity_key", fallback_key(node.id_field, None))
    else:
        latest = keep_latest(keyed, "entity_key", node.cursor)
    return latest.select(
        node_id(node.label, "entity_key").alias("entity_id"),
        F.lit(node.label).alias("label"),
        "entity_key",
        _props(latest, node.properties).alias("props"),
        _cursor(node.cursor),
    )


def key_index(node: NodeMap, keyed: DataFrame) -> DataFrame:
    """``key -> entity_id`` of a node type whose id comes from its identity fields."""
    index = keyed.select(
        F.col(node.id_field).cast("string").alias("_key"),
        node_id(node.label, "entity_key").alias("_entity"),
    )
    # A key that several origins share has the least of their entities, on every run.
    return index.where("_key IS NOT NULL").groupBy("_key").agg(F.min("_entity").alias("_entity"))


def _endpoint(
    rows: DataFrame, name: str, node: NodeMap, key: str, index: DataFrame | None
) -> DataFrame:
    """Entity id of an edge end: a hash of its key, or a lookup where ER decides.

    A key that resolves to nothing keeps the id it would have: it shows as an orphan.
    """
    by_hash = node_id(node.label, F.col(key).cast("string"))
    if index is None:
        return rows.withColumn(name, by_hash)
    found = index.select(F.col("_key").alias(f"_{name}_key"), F.col("_entity").alias(f"_{name}"))
    joined = rows.join(found, F.col(key).cast("string") == F.col(f"_{name}_key"), "left")
    return joined.withColumn(name, F.coalesce(f"_{name}", by_hash)).drop(f"_{name}", f"_{name}_key")


def project_edges(
    edge: EdgeMap,
    clean: DataFrame,
    source: NodeMap,
    target: NodeMap,
    indexes: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """One edge per (type, src, dst)."""
    indexes = indexes or {}
    rows = clean.select(*edge.columns()).where(
        F.col(edge.from_key).isNotNull() & F.col(edge.to_key).isNotNull()
    )
    looked_up = source.label in indexes or target.label in indexes
    if not looked_up:
        # Ids follow from the keys, so equal edges are found by the (short) keys.
        rows = keep_latest(rows, list(dict.fromkeys([edge.from_key, edge.to_key])))
    rows = _endpoint(rows, "src", source, edge.from_key, indexes.get(source.label))
    rows = _endpoint(rows, "dst", target, edge.to_key, indexes.get(target.label))
    edges = rows.select(
        F.lit(edge.type).alias("type"),
        "src",
        "dst",
        F.lit(edge.from_label).alias("src_label"),
        F.lit(edge.to_label).alias("dst_label"),
        _props(rows, edge.properties).alias("props"),
    )
    return keep_latest(edges, EDGE_KEY, "props") if looked_up else edges


def project_events(event: TimelineMap, clean: DataFrame, node: NodeMap, index: DataFrame | None = None) -> DataFrame:
    """Timeline events; the id hashes all of an event, so two at one instant stay two.

    Equal events are found by what the id is made of, which is shorter than the ids.
    """
    rows = clean.where(F.col(event.key).isNotNull() & F.col(event.timestamp).isNotNull())
    rows = rows.withColumns({
        "_at": F.col(event.timestamp).cast("timestamp"),
        "_props": _props(clean, event.properties),
    })
    if index is None:
        key = F.col(event.key) if _plain(clean, event.key) else F.col(event.key).cast("string").alias(event.key)
        rows = rows.select(key, "_at", "_props")
        # The id has the time of day, which two instants share when clocks are put back.
        rows = rows.withColumn("_clock", F.col("_at").cast("timestamp_ntz")).dropDuplicates([event.key, "_clock", "_props"])
    rows = _endpoint(rows, "entity_id", node, event.key, index)
    events = rows.select(
        F.lit(event.type).alias("type"), "entity_id", F.col("_at").alias("at"), F.col("_props").alias("props")
    )
    identity = F.concat_ws(
        "|", "type", "entity_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "props"
    )
    events = events.withColumn("event_id", uuid5(identity))
    return events if index is None else events.dropDuplicates(["event_id"])


class Graph:
    """``nodes``, ``edges`` and ``events`` DataFrames; of a projection also its rows with entity keys by label."""

    def __init__(self, nodes: DataFrame | None, edges: DataFrame | None, events: DataFrame | None = None):
        self.nodes, self.edges, self.events = nodes, edges, events
        self.keyed: dict[str, DataFrame] = {}


def _union(frames: Sequence[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, frames) if frames else None


PARTS = ("nodes", "edges", "events")


def _project(
    ontology: Ontology, tables: dict[str, DataFrame], indexes: dict[str, DataFrame], parts: Sequence[str]
) -> Graph:
    """Edges and events of the given tables."""
    edges, events = [], []
    if "edges" in parts:
        edges = [
            project_edges(
                e, tables[e.source], ontology.node(e.from_label), ontology.node(e.to_label), indexes
            )
            for e in ontology.edges
        ]
    if "events" in parts:
        events = [
            project_events(t, tables[t.source], ontology.node(t.label), indexes.get(t.label))
            for t in ontology.timeline
        ]
    return Graph(None, _union(edges), _union(events))


def _sources(ontology: Ontology) -> set[str]:
    return {e.source for e in (*ontology.nodes, *ontology.edges, *ontology.timeline)}


def _looked_up(ontology: Ontology) -> list[NodeMap]:
    return [n for n in ontology.nodes if not n.by_key or n.origin]


def project_graph(ontology: Ontology, read, parts: Sequence[str] = PARTS) -> Graph:
    """The graph of an ontology; ``read(source)`` returns a clean table.

    Entities are resolved once per node type, for its nodes and for the edges' lookups.
    """
    tables = {s: read(s) for s in _sources(ontology)}
    keyed = {n.label: keyed_rows(n, tables[n.source]) for n in ontology.nodes}
    indexes = {n.label: key_index(n, keyed[n.label]) for n in _looked_up(ontology)}
    graph = _project(ontology, tables, indexes, parts)
    graph.keyed = keyed
    if "nodes" in parts:
        graph.nodes = _union([project_nodes(n, keyed[n.label]) for n in ontology.nodes])
    return graph


def build_graph(
    lake: LakeStore,
    ontology: Ontology | None = None,
    snapshots: dict[str, int] | None = None,
    ontology_version: int | None = None,
    reset: bool = True,
    suffix: str = "",
) -> Graph:
    """Project and store the graph of (clean snapshots x ontology version).

    ``reset`` rewrites the tables, which drops ghosts of older maps; without it nodes and
    edges are merged by id, which leaves a repeated build unchanged.
    """
    if ontology is None:
        ontology = OntologyHistory(lake).load(ontology_version)
    validate_ontology(lake, ontology)
    pinned = snapshots or {}
    graph = project_graph(ontology, lambda s: lake.read(s, snapshot=pinned.get(s)))
    for node in _looked_up(ontology):
        store_entities(lake, node, graph.keyed[node.label], suffix)
    return _store(lake, graph, "overwrite" if reset else "merge", suffix)


def _one_row_an_id(ontology: Ontology, tables: dict[str, DataFrame]) -> set[str]:
    """Parts whose projected rows have different ids: no two maps make the same, each makes it once."""
    named = {"nodes": (":", [n.label for n in ontology.nodes]), "events": ("|", [t.type for t in ontology.timeline])}
    parts = {p for p, (mark, names) in named.items() if len(set(names)) == len(names) and mark not in "".join(names)}
    types = {e.type for e in ontology.edges}
    if len(types) == len(ontology.edges) and all(
        _plain(tables[e.source], k) for e in ontology.edges for k in (e.from_key, e.to_key)
    ):
        parts.add("edges")
    return parts


def _store(
    lake: LakeStore, graph: Graph, mode: str, suffix: str = "", single: Collection[str] = (), by_start: bool = False
) -> Graph:
    """Write the parts. Those in ``single`` have one row an id already; ``by_start`` merges all edges of a start together."""
    parts = {"nodes": "entity_id", "edges": EDGE_KEY, "events": "event_id"}
    for part, key in parts.items():
        frame = getattr(graph, part)
        if frame is None:
            continue
        unique = part not in single
        if part == "edges" and by_start:
            frame = keep_latest(frame, EDGE_KEY) if unique else frame
            key, unique = EDGE_START, False
        lake.write("graph", f"{part}{suffix}", frame, mode, pk=key, unique=unique, skip_empty=mode == "merge")
    read = {p: ("graph", f"{p}{suffix}") for p in parts}
    have = {p: lake.read(s) if lake.table_exists(s) else None for p, s in read.items()}
    return Graph(have["nodes"], have["edges"], have["events"])


def refresh_graph(lake: LakeStore, ontology: Ontology, since: dict[str, object], cursor: str = "updated_at") -> Graph:
    """Maintain the stored graph from the rows changed after each source's mark.

    All edges that start at a key of a changed row are made anew and replace the stored ones
    of that start, so an edge whose end moved leaves nothing behind; maps that start at the same
    key of the same rows have these looked up once. Nodes and edges whose
    key is in no row any more are removed; only keys are compared for that. Where identity
    fields or origins decide an id, ``refresh_entities`` tells which entities merged, split or
    changed; their nodes, the edges at either end and their events are made anew.
    """
    tables = {s: lake.read(s) for s in _sources(ontology)}
    changed = {s: lake.read(s, watermark=since.get(s), cursor=cursor) for s in tables}
    changes = {n.label: refresh_entities(lake, n, tables[n.source]) for n in _looked_up(ontology)}
    indexes = {label: state_index(ontology.node(label), c.state) for label, c in changes.items()}
    moved = {label: c.keys.select(F.col("key").alias("_moved")) for label, c in changes.items()}
    edges, groups, origins = [], [], {}
    for alike in _same_rows_touched(ontology, moved):
        edge = alike[0]
        source, target = ontology.node(edge.from_label), ontology.node(edge.to_label)
        key, rows = F.col(edge.from_key).cast("string"), tables[edge.source]
        touched = [changed[edge.source].select(key.alias("_touched"))]
        if source.label in moved:
            touched.append(moved[source.label].select(F.col("_moved").alias("_touched")))
        if target.label in moved:
            touched.append(_rows_with(rows, edge.to_key, moved[target.label]).select(key.alias("_touched")))
        touched = _union(touched).where("_touched IS NOT NULL").distinct()
        if source.label in indexes:
            touched = keys_of_same_entities(cut_lineage(touched), indexes[source.label])
        touched = cut_lineage(touched)
        rows = rows.select(*dict.fromkeys(c for e in alike for c in e.columns()))
        same = key == F.col("_touched")
        if source.label not in moved and _plain(rows, edge.from_key):
            # All touched keys are from this column; as values they follow the join that hides older rows.
            same = F.col(edge.from_key) == F.col("_touched").cast(rows.schema[edge.from_key].dataType)
        rows = rows.join(touched, same, "left_semi")
        if len(alike) > 1:
            rows = cut_lineage(rows)
        for e in alike:
            edges.append(project_edges(e, rows, source, ontology.node(e.to_label), indexes))
            groups.append(_starts(e, touched.select(F.col("_touched").alias(e.from_key)), source, indexes))
            origins.setdefault(e.type, {})[e.source, e.from_key, e.from_label] = e
    stored = {p: lake.pin(("graph", p)) if lake.table_exists(("graph", p)) else None for p in PARTS}
    if edges and stored["edges"] is not None:
        gone = _without_start(stored["edges"].select("type", "src"), ontology, origins, tables, indexes)
        lake.delete_where_in(("graph", "edges"), ["type", "src"], _union(groups).unionByName(gone))
    if stored["nodes"] is not None:
        present = [_present(n, tables[n.source], changes.get(n.label)) for n in ontology.nodes]
        kept, present = (_packed(f, "entity_id") for f in (stored["nodes"].select("entity_id"), _union(present)))
        gone = cut_lineage(_unpacked(without_keys(kept, present, "entity_id"), "entity_id"))
        if not gone.isEmpty():
            lake.delete_where_in(("graph", "nodes"), "entity_id", gone)
    events = []
    for event in ontology.timeline:
        node, rows = ontology.node(event.label), changed[event.source]
        if node.label in changes:
            if stored["events"] is not None:
                old = [changes[node.label].entities.select(F.col("entity").alias("_name")), moved[node.label].select(F.col("_moved").alias("_name"))]
                ids = _union(old).select(F.lit(event.type).alias("type"), node_id(node.label, "_name").alias("entity_id"))
                lake.delete_where_in(("graph", "events"), ["type", "entity_id"], ids)
            rows = rows.unionByName(_rows_with(tables[event.source], event.key, moved[node.label]))
        events.append(project_events(event, rows, node, indexes.get(node.label)))
    nodes = []
    for n in ontology.nodes:
        if n.label in changes:
            keyed = rows_of_entities(n, tables[n.source], changes[n.label], changed[n.source])
        else:
            keyed = keyed_rows(n, changed[n.source])
        nodes.append(project_nodes(n, keyed))
    graph = Graph(_union(nodes), _union(edges), _union(events))
    return _store(lake, graph, "merge", single=_one_row_an_id(ontology, tables), by_start=True)


def _same_rows_touched(ontology: Ontology, moved: Collection[str]) -> list[list[EdgeMap]]:
    """Edge maps in lists whose edges are made anew for the same rows: those of one start, and of one end where it moved."""
    alike: dict[tuple, list[EdgeMap]] = {}
    for e in ontology.edges:
        end = (e.to_label, e.to_key) if e.to_label in moved else None
        alike.setdefault((e.source, e.from_key, e.from_label, end), []).append(e)
    return list(alike.values())


def _packed(ids: DataFrame, column: str) -> DataFrame:
    return ids.withColumn(column, packed_text(column))


def _unpacked(ids: DataFrame, column: str) -> DataFrame:
    return ids.withColumn(column, unpacked_text(column))


def _rows_with(rows: DataFrame, key: str, moved: DataFrame) -> DataFrame:
    return rows.join(moved, F.col(key).cast("string") == F.col("_moved"), "left_semi")


def _present(node: NodeMap, clean: DataFrame, change: EntityChange | None) -> DataFrame:
    """``entity_id`` of all entities the source has."""
    if change is not None:
        return change.state.select(node_id(node.label, "entity").alias("entity_id"))
    return keyed_rows(node, clean).select(node_id(node.label, "entity_key").alias("entity_id"))


def _starts(edge: EdgeMap, keys: DataFrame, source: NodeMap, indexes: dict[str, DataFrame]) -> DataFrame:
    """``type, src`` of the edges that rows with these keys can start."""
    rows = keys.where(F.col(edge.from_key).isNotNull()).distinct()
    rows = _endpoint(rows, "src", source, edge.from_key, indexes.get(source.label))
    return rows.select(F.lit(edge.type).alias("type"), "src")


def _without_start(
    kept: DataFrame, ontology: Ontology, origins: dict[str, dict[tuple, EdgeMap]],
    tables: dict[str, DataFrame], indexes: dict[str, DataFrame],
) -> DataFrame:
    """``type, src`` of stored edges that no row starts any more; types that start at the same rows are looked up in them once."""
    types: dict[frozenset, list[str]] = {}
    for name, found in origins.items():
        types.setdefault(frozenset(found), []).append(name)
    known = F.coalesce(F.col("type").isin(list(origins)), F.lit(False))
    gone = [kept.where(~known)]
    for names in types.values():
        maps = origins[names[0]].values()
        starts = [_starts(e, tables[e.source].select(e.from_key), ontology.node(e.from_label), indexes).select("src") for e in maps]
        there = _packed(kept.where(F.col("type").isin(names)), "src")
        gone.append(_unpacked(without_keys(there, _packed(_union(starts), "src"), "src"), "src"))
    return _union(gone)


def ghost_entities(stored: DataFrame, projected: DataFrame) -> DataFrame:
    """Stored nodes the current ontology no longer produces."""
    return without_keys(stored, projected, "entity_id")
