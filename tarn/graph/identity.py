"""Entities of a node type kept from one refresh to the next.

The state is a table of the graph layer: each distinct (key, identity values) of the source with
the entity it belongs to. A refresh compares these short records with the source, takes up the
components that lost a record and those that a new value occurs in, and resolves them alone:
components merge through new values and split where a record is gone, as in a rebuild. A refresh
that dies half way leaves records out of the state; the next one finds them as new.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.identity import normalize_field
from tarn.graph.entities import connected_components, fallback_key, node_id
from tarn.graph.ontology import NodeMap
from tarn.lake.store import LakeStore
from tarn.operators.merge import without_keys
from tarn.session import cut_lineage

RECORD = ["own", "key", "held"]


class EntityChange(NamedTuple):
    """``state`` after a refresh, the names of entities it touched (old and new), their keys."""

    state: DataFrame
    entities: DataFrame
    keys: DataFrame


def state_table(label: str, suffix: str = "") -> str:
    return re.sub(r"\W", "_", f"entities_{label}{suffix}").lower()


def _values() -> Column:
    """The identity values of a record, which are kept as JSON text."""
    return F.from_json("held", "array<string>")


def records(node: NodeMap) -> dict[str, Column]:
    """Columns of a row's record: its own name, its key and its identity values."""
    values = [normalize_field(f) for f in node.er_fields]
    if len(values) > 1:
        values = [F.concat(F.lit(f"{f}="), v) for f, v in zip(node.er_fields, values, strict=True)]
    held = F.array_compact(F.array(*values)) if values else F.array().cast("array<string>")
    return {"own": fallback_key(node.id_field, node.origin), "key": F.col(node.id_field).cast("string"), "held": F.to_json(held)}


def _records_of(node: NodeMap, rows: DataFrame) -> DataFrame:
    found = rows.select(*[c.alias(n) for n, c in records(node).items()])
    return found.where("own IS NOT NULL OR held <> '[]'").distinct()


def _resolved(node: NodeMap, found: DataFrame) -> DataFrame:
    """The records plus ``entity``: their component's least value, their first value, or their own name."""
    first = F.get(_values(), F.lit(0))
    if len(node.er_fields) < 2:
        return found.select(*RECORD, F.coalesce(first, "own").alias("entity"))
    found = cut_lineage(found.withColumn("_first", first))
    pairs = found.select(F.col("_first").alias("a"), F.explode(_values()).alias("b")).where("a <> b").distinct()
    parts = connected_components(pairs).select(F.col("node").alias("_first"), "component")
    return found.join(parts, "_first", "left").select(*RECORD, F.coalesce("component", "_first", "own").alias("entity"))


def store_entities(lake: LakeStore, node: NodeMap, keyed: DataFrame, suffix: str = "") -> None:
    """The state of a build, from its rows with their ``entity_key``."""
    columns = [c.alias(n) for n, c in records(node).items()]
    lake.write("graph", state_table(node.label, suffix), keyed.select(*columns, F.col("entity_key").alias("entity")).distinct())


def refresh_entities(lake: LakeStore, node: NodeMap, clean: DataFrame) -> EntityChange:
    """Bring the state up to the source; the work follows the records that differ."""
    source = ("graph", state_table(node.label))
    now = cut_lineage(_records_of(node, clean.select(*node.columns())))
    if not lake.table_exists(source):  # a graph from before the state was kept: all records are new
        lake.write(*source, _resolved(node, now.limit(0)))
    before = lake.pin(source)
    added, removed = cut_lineage(without_keys(now, before, RECORD)), cut_lineage(without_keys(before, now, RECORD))
    values = added.select(F.explode(_values()).alias("value")).distinct()
    met = before.select("entity", F.explode(_values()).alias("value")).join(values, "value", "left_semi")
    touched = cut_lineage(removed.select("entity").unionByName(met.select("entity")).distinct())
    left = without_keys(before.join(touched, "entity", "left_semi"), removed, RECORD)
    again = cut_lineage(_resolved(node, left.select(*RECORD).unionByName(added)))
    if not touched.isEmpty():
        lake.delete_where_in(source, "entity", touched)
    if not again.isEmpty():
        lake.write(*source, again, "append")
    entities = cut_lineage(touched.unionByName(again.select("entity")).distinct())
    keys = cut_lineage(removed.select("key").unionByName(again.select("key")).where("key IS NOT NULL").distinct())
    return EntityChange(lake.pin(source), entities, keys)


def state_index(node: NodeMap, state: DataFrame) -> DataFrame:
    """``_key, _entity`` of the state; a key that several origins share has the least of their entities."""
    index = state.where("key IS NOT NULL").select(F.col("key").alias("_key"), node_id(node.label, "entity").alias("_entity"))
    return index.groupBy("_key").agg(F.min("_entity").alias("_entity"))


def rows_of_entities(node: NodeMap, clean: DataFrame, change: EntityChange, changed: DataFrame) -> DataFrame:
    """All rows, with ``entity_key``, of the touched entities and of those that a changed row belongs to."""
    here = _records_of(node, changed.select(*node.columns()))
    theirs = change.state.join(here, _same(change.state, here, RECORD), "left_semi").select("entity")
    wanted = change.state.join(theirs.unionByName(change.entities).distinct(), "entity", "left_semi")
    wanted = cut_lineage(wanted.select(*[F.col(c).alias(f"_of_{c}") for c in RECORD], F.col("entity").alias("entity_key")))
    rows = clean.select(*node.columns())
    same = reduce(Column.__and__, [c.eqNullSafe(F.col(f"_of_{n}")) for n, c in records(node).items()])
    return rows.join(wanted, same).select(*rows.columns, "entity_key")


def _same(a: DataFrame, b: DataFrame, on: Sequence[str]) -> Column:
    return reduce(Column.__and__, [a[c].eqNullSafe(b[c]) for c in on])


def keys_of_same_entities(touched: DataFrame, index: DataFrame) -> DataFrame:
    """``_touched`` keys and all other keys of their entities, whose edges start at the same node."""
    mine = index.join(touched, F.col("_key") == F.col("_touched"), "left_semi").select("_entity").distinct()
    others = index.join(mine, "_entity", "left_semi").select(F.col("_key").alias("_touched"))
    return touched.unionByName(others).distinct()
