"""Questions asked of the graph: quality, counts, samples, patterns, neighbours, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.graph.project import Graph
from tarn.operators.merge import without_keys
from tarn.session import cut_lineage


def resolved_edges(graph: Graph) -> DataFrame:
    """Edges plus ``resolved``: both ends exist as nodes.

    The ends that exist nowhere are found once, over distinct ids, and written; that list
    is normally tiny, so marking the edges with it moves no edge.
    """
    ends = graph.edges.select(F.col("src").alias("entity_id")).unionByName(
        graph.edges.select(F.col("dst").alias("entity_id"))
    )
    missing = cut_lineage(without_keys(ends.distinct(), graph.nodes, "entity_id"))
    edges = graph.edges
    for end in ("src", "dst"):
        lost = missing.select(F.col("entity_id").alias(f"_{end}"))
        edges = edges.join(lost, F.col(end) == F.col(f"_{end}"), "left")
    both = F.col("_src").isNull() & F.col("_dst").isNull()
    return edges.withColumn("resolved", both).drop("_src", "_dst")


def edge_quality(graph: Graph) -> DataFrame:
    """Resolution rate and orphans per edge type."""
    return (
        resolved_edges(graph)
        .groupBy("type")
        .agg(
            F.count("*").alias("total_edges"),
            F.count_if("resolved").alias("resolved_edges"),
            F.count_if(~F.col("resolved")).alias("orphan_edges"),
        )
    )


def orphan_edges(graph: Graph) -> DataFrame:
    return resolved_edges(graph).where(~F.col("resolved")).drop("resolved")


def graph_counts(graph: Graph) -> DataFrame:
    """Nodes per label and edges per type."""
    nodes = graph.nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name"))
    edges = graph.edges.groupBy(F.lit("edge").alias("kind"), F.col("type").alias("name"))
    return nodes.agg(F.count("*").alias("elements")).unionByName(
        edges.agg(F.count("*").alias("elements"))
    )


def degrees(graph: Graph) -> DataFrame:
    """Out- and in-degree of every node that has an edge."""
    out = graph.edges.select(F.col("src").alias("entity_id"), F.lit(1).alias("_out"), F.lit(0).alias("_in"))
    into = graph.edges.select(F.col("dst").alias("entity_id"), F.lit(0).alias("_out"), F.lit(1).alias("_in"))
    return out.unionByName(into).groupBy("entity_id").agg(
        F.sum("_out").alias("out_degree"), F.sum("_in").alias("in_degree")
    )


def edge_seeded_sample(graph: Graph, k: int) -> Graph:
    """``k`` edges in hash order plus their end nodes: a sample that opens connected.

    The sample is written, so its nodes and every later use read the same ``k`` rows.
    """
    order = F.xxhash64("type", "src", "dst")
    edges = cut_lineage(graph.edges.orderBy(order, "type", "src", "dst").limit(k))
    return Graph(_ends(graph, edges), edges)


def _ends(graph: Graph, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("entity_id")).unionByName(
        edges.select(F.col("dst").alias("entity_id"))
    )
    return graph.nodes.join(ends, "entity_id", "left_semi")


def neighbors(graph: Graph, ids: DataFrame) -> Graph:
    """One hop around the given ``entity_id`` values, both directions."""
    seeds = ids.select(F.col("entity_id").alias("_seed")).distinct()
    out = graph.edges.join(seeds, F.col("src") == F.col("_seed"), "left_semi")
    into = graph.edges.join(seeds, F.col("dst") == F.col("_seed"), "left_semi")
    # An edge between two seeds is found from both ends.
    inner = out.join(seeds, F.col("dst") == F.col("_seed"), "left_anti")
    edges = inner.unionByName(into)
    return Graph(_ends(graph, edges), edges)


def slice_graph(graph: Graph, label: str, n: int) -> Graph:
    """The first ``n`` nodes of a label in key order, with everything they link to."""
    seeds = graph.nodes.where(F.col("label") == label).orderBy("entity_key").limit(n)
    return neighbors(graph, cut_lineage(seeds.select("entity_id")))


def match_star(
    graph: Graph,
    center: str,
    roles: dict[str, str],
    properties: dict[str, str],
    labels: dict[str, str] | None = None,
) -> DataFrame:
    """Fixed pattern: a center node with one edge of each type in ``roles``.

    ``roles`` maps edge types to output prefixes, ``properties`` maps a prefix (or the
    center label) to the property to return. An edge type links a center to one node.
    ``labels`` gives the label an edge type ends in: then only those nodes are joined. Of
    node properties only the wanted one is read out, before rows are shuffled.
    """
    def prop(name: str, column: str = "props"):
        return F.get_json_object(column, f"$.{name}")

    result = graph.nodes.where(F.col("label") == center).select(
        F.col("entity_id").alias("_center"),
        F.col("entity_key").alias("center_key"),
        *([prop(properties[center]).alias(properties[center])] if center in properties else []),
    )
    for edge_type, name in roles.items():
        ends = graph.nodes
        if labels and edge_type in labels:
            ends = ends.where(F.col("label") == labels[edge_type])
        wanted = prop(properties[name]) if name in properties else F.lit(None).cast("string")
        ends = ends.select("entity_id", F.col("entity_key").alias(f"{name}_key"), wanted.alias("_property"))
        hop = (
            graph.edges.where(F.col("type") == edge_type)
            .select(F.col("src").alias("_src"), F.col("dst").alias("_dst"))
            .join(ends, F.col("_dst") == F.col("entity_id"))
            .select(
                "_src",
                f"{name}_key",
                *([F.col("_property").alias(f"{name}_{properties[name]}")] if name in properties else []),
            )
        )
        result = result.join(hop, F.col("_center") == F.col("_src")).drop("_src")
    return result.drop("_center")


def export_csv(graph: Graph, path: str) -> None:
    """Bulk-load files: nodes per label and edges per type, with headers."""
    options = {"header": True, "escape": '"', "mode": "overwrite"}
    graph.nodes.select("entity_id", "entity_key", "props", "label").write.partitionBy("label").csv(
        f"{path}/nodes", **options
    )
    graph.edges.select("src", "dst", "props", "type").write.partitionBy("type").csv(
        f"{path}/edges", **options
    )


def import_csv(spark, path: str) -> Graph:
    def load(part: str, columns: str) -> DataFrame:
        return spark.read.csv(f"{path}/{part}", header=True, escape='"', schema=columns)

    return Graph(
        load("nodes", "entity_id string, entity_key string, props string, label string"),
        load("edges", "src string, dst string, props string, type string"),
    )
