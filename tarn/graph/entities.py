"""Deterministic entity resolution.

With one identity field an entity is its normalised value, so the id is a hash and no
rows have to meet. With several fields, values that occur in one row belong together;
entities are the connected components of those values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.identity import normalize_field
from tarn.functions.ids import uuid5
from tarn.session import cut_lineage


def node_id(label: str, key: Column | str) -> Column:
    """Entity id of a key under a label; the same on every run."""
    key = F.col(key) if isinstance(key, str) else key
    return uuid5(F.concat(F.lit(f"{label}:"), key.cast("string")))


def fallback_key(id_field: str, origin: str | None) -> Column:
    """Key of a row without identity value: its own source and key, never a random id."""
    own = F.col(id_field).cast("string")
    return F.concat(F.col(origin), F.lit(":"), own) if origin else own


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of undirected ``a, b`` pairs; the component is its least node.

    Nodes get a number first: rounds then aggregate by hash and shuffle 16 bytes per edge.
    The numbers differ between runs, so the name of a component is taken from its nodes.
    """
    pairs = edges.where("a <> b").select("a", "b").distinct()
    ends = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a")))
    nodes = cut_lineage(
        ends.select(F.col("a").alias("node")).distinct()
        .withColumn("id", F.monotonically_increasing_id())
    )
    numbered = pairs
    for end in ("a", "b"):
        number = nodes.select(F.col("node").alias(end), F.col("id").alias(f"_{end}"))
        numbered = numbered.join(number, end)
    stars = star_rounds(numbered.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    tops = stars.select(F.col("b").alias("id")).distinct().withColumn("top", F.col("id"))
    placed = stars.select(F.col("a").alias("id"), F.col("b").alias("top")).unionByName(tops)
    named = nodes.join(placed, "id").select("node", "top")
    least = named.groupBy("top").agg(F.min("node").alias("component"))
    return named.join(least, "top").select("node", "component")


def star_rounds(edges: DataFrame) -> DataFrame:
    """Pairs of numbers to ``a -> b`` stars around the least number of each component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): O(log^2 n)
    rounds on any shape. A node's minimum is a partial aggregate and neighbours are
    never gathered in a list, so a value shared by a third of the rows stays a stream
    of edges that the skew join can split.
    """
    edges = cut_lineage(edges)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: every larger neighbour is tied to the least node around.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.where("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        # Small star: a node and its smaller neighbours are tied to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        hashed = F.xxhash64("a", "b").cast("decimal(38,0)")
        state = edges.agg(F.count("*").alias("n"), F.sum(hashed).alias("h")).first()
        if state == seen:
            return edges
        seen = state


def resolve_entities(
    df: DataFrame,
    label: str,
    id_field: str,
    er_fields: Sequence[str],
    origin: str | None = None,
) -> DataFrame:
    """``df`` plus ``entity_key`` and ``entity_id``."""
    keyed = with_entity_key(df, id_field, er_fields, origin)
    return keyed.withColumn("entity_id", node_id(label, "entity_key"))


def with_entity_key(
    df: DataFrame, id_field: str, er_fields: Sequence[str], origin: str | None = None
) -> DataFrame:
    """``df`` plus ``entity_key``: equal for the rows of one entity."""
    own = fallback_key(id_field, origin)
    if not er_fields:
        return df.withColumn("entity_key", own)
    if len(er_fields) == 1:
        return df.withColumn("entity_key", F.coalesce(normalize_field(er_fields[0]), own))
    return _by_components(df, er_fields, own)


def _by_components(df: DataFrame, er_fields: Sequence[str], own: Column) -> DataFrame:
    tagged = [
        F.concat(F.lit(f"{field}="), normalize_field(field)) for field in er_fields
    ]
    named = {f"_er{i}": t for i, t in enumerate(tagged)}
    rows = df.withColumns({**named, "_first": F.coalesce(*tagged)})
    # Values of one row: a star from its first value, deduplicated over all rows.
    pairs = [
        rows.select(F.col("_first").alias("a"), F.col(c).alias("b")).where("a <> b").distinct()
        for c in named
    ]
    components = connected_components(reduce(DataFrame.unionByName, pairs))
    found = components.select(F.col("node").alias("_first"), F.col("component").alias("_component"))
    return (
        rows.join(found, "_first", "left")
        .withColumn("entity_key", F.coalesce("_component", "_first", own))
        .select(*df.columns, "entity_key")
    )
