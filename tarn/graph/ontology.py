"""Declarative map from clean tables to nodes, edges and timeline events."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from tarn.lake.store import LakeStore


@dataclass(frozen=True)
class NodeMap:
    label: str
    source: str
    id_field: str
    er_fields: tuple[str, ...] = ()
    properties: tuple[str, ...] = ()
    cursor: str | None = None
    origin: str | None = None
    """Column that names the row's source system; part of the id of rows without ER value."""

    @property
    def by_key(self) -> bool:
        """The id follows from the key alone, so edges can compute it without a join."""
        return not self.er_fields

    def columns(self) -> list[str]:
        extra = [c for c in (self.cursor, self.origin) if c]
        return list(dict.fromkeys([self.id_field, *self.er_fields, *self.properties, *extra]))


@dataclass(frozen=True)
class EdgeMap:
    type: str
    source: str
    from_label: str
    from_key: str
    to_label: str
    to_key: str
    properties: tuple[str, ...] = ()

    def columns(self) -> list[str]:
        return list(dict.fromkeys([self.from_key, self.to_key, *self.properties]))


@dataclass(frozen=True)
class TimelineMap:
    type: str
    source: str
    label: str
    key: str
    timestamp: str
    properties: tuple[str, ...] = ()

    def columns(self) -> list[str]:
        return list(dict.fromkeys([self.key, self.timestamp, *self.properties]))


@dataclass(frozen=True)
class Ontology:
    version: int
    nodes: tuple[NodeMap, ...]
    edges: tuple[EdgeMap, ...] = ()
    timeline: tuple[TimelineMap, ...] = ()
    raw: Mapping = field(default_factory=dict)

    def node(self, label: str) -> NodeMap:
        for node in self.nodes:
            if node.label == label:
                return node
        raise KeyError(label)


def parse_ontology(document: Mapping | str) -> Ontology:
    """From a dict, or from JSON or YAML text."""
    if isinstance(document, str):
        try:
            document = json.loads(document)
        except ValueError:
            import yaml

            document = yaml.safe_load(document)

    def tupled(entry: Mapping) -> dict:
        return {k: tuple(v) if isinstance(v, list) else v for k, v in entry.items()}

    return Ontology(
        int(document.get("version", 1)),
        tuple(NodeMap(**tupled(n)) for n in document.get("nodes", [])),
        tuple(EdgeMap(**tupled(e)) for e in document.get("edges", [])),
        tuple(TimelineMap(**tupled(t)) for t in document.get("timeline", [])),
        document,
    )


def merge_fragments(version: int, *fragments: Mapping) -> Ontology:
    """One map out of per-connector fragments."""
    merged = {"version": version, "nodes": [], "edges": [], "timeline": []}
    for fragment in fragments:
        for part in ("nodes", "edges", "timeline"):
            merged[part] += fragment.get(part, [])
    return parse_ontology(merged)


def ontology_problems(ontology: Ontology, columns: Mapping[str, list[str]]) -> list[tuple[str, str]]:
    """(entry, problem) pairs against the real columns of the clean tables."""
    problems = []
    labels = [n.label for n in ontology.nodes]
    problems += [
        (label, "label declared twice") for label in sorted(set(labels)) if labels.count(label) > 1
    ]
    entries = (
        [(n.label, n) for n in ontology.nodes]
        + [(e.type, e) for e in ontology.edges]
        + [(t.type, t) for t in ontology.timeline]
    )
    for name, entry in entries:
        if entry.source not in columns:
            problems.append((name, f"unknown table {entry.source}"))
            continue
        problems += [
            (name, f"{entry.source} has no column {c}")
            for c in entry.columns()
            if c not in columns[entry.source]
        ]
    ends = [(e.type, label) for e in ontology.edges for label in (e.from_label, e.to_label)]
    ends += [(t.type, t.label) for t in ontology.timeline]
    problems += [(name, f"unknown label {label}") for name, label in ends if label not in labels]
    return problems


def lake_columns(lake: LakeStore, ontology: Ontology) -> dict[str, list[str]]:
    sources = {e.source for e in (*ontology.nodes, *ontology.edges, *ontology.timeline)}
    return {s: lake.schema_of(s).names for s in sources if lake.table_exists(s)}


def validate_ontology(lake: LakeStore, ontology: Ontology) -> None:
    problems = ontology_problems(ontology, lake_columns(lake, ontology))
    if problems:
        raise ValueError("; ".join(f"{name}: {text}" for name, text in problems))


class OntologyHistory:
    """Explicit versions of the map, kept in the lake; supports rollback."""

    TABLE = ("state", "ontology")

    def __init__(self, lake: LakeStore):
        self.lake = lake

    def save(self, document: Mapping) -> int:
        validate_ontology(self.lake, parse_ontology(document))
        version = self.latest_version() + 1
        body = json.dumps({**document, "version": version})
        row = self.lake.spark.createDataFrame([(version, body)], "version int, document string")
        self.lake.write(*self.TABLE, row.coalesce(1), "append")
        return version

    def latest_version(self) -> int:
        if not self.lake.table_exists(self.TABLE):
            return 0
        return self.lake.read(self.TABLE).agg({"version": "max"}).first()[0]

    def load(self, version: int | None = None) -> Ontology:
        version = version or self.latest_version()
        row = self.lake.read(self.TABLE).where(f"version = {int(version)}").first()
        if row is None:
            raise LookupError(f"no ontology version {version}")
        return parse_ontology(row["document"])

    def rollback(self, version: int) -> int:
        """An old version becomes the newest one; history is never rewritten."""
        return self.save(self.load(version).raw)
