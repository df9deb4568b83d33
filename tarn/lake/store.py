"""Versioned Parquet tables addressed as ``<layer>/<table>``.

Layout: ``<root>/<layer>/<table>/data/commit_id=<id>/*.parquet`` holds the rows and
``versions/v<n>.json`` lists the commits that make up version *n*. A merge or a delete
stores only the delta; reading hides the older rows it replaces with one anti-join on
the key, so the cost of a write tracks the delta. ``compact`` folds the deltas in.
Where Delta or Iceberg is on the class path, their tables can be read next to these
(``tarn.sources.files``); on object stores without rename they are the better home.
"""

from __future__ import annotations

import datetime as dt
import json
import random
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.ids import packed_text
from tarn.functions.scalars import beyond
from tarn.lake.files import SharedFiles
from tarn.lake.sqltext import parsed_query
from tarn.operators.merge import common_schema, conform, keep_latest, require_columns, upsert_delta, widest

# The layers of the lake, plus one for the state of its own jobs.
LAYERS = ("raw", "enrichment", "clean", "graph", "state")
FEDERATED = "fed"
COMMIT = "commit_id"
MAX_RETRIES = 8
# Hidden columns: tombstones, and the sequence of a row that a change feed brought.
DELETED, SEQUENCE = "_deleted", "_seq"

Source = str | tuple[str, str]


class CommitConflict(RuntimeError):
    """Another writer committed to the same table first and the retries ran out."""


class TableNotFound(LookupError):
    pass


@dataclass(frozen=True)
class Mark:
    """Highest value a cursor column has reached, kept as text together with its type."""

    text: str
    type: str

    @property
    def value(self) -> object:
        if self.type.startswith("timestamp"):
            return dt.datetime.fromisoformat(self.text)
        if self.type == "date":
            return dt.date.fromisoformat(self.text)
        if self.type in ("tinyint", "smallint", "int", "bigint"):
            return int(self.text)
        if self.type in ("float", "double"):
            return float(self.text)
        return Decimal(self.text) if self.type.startswith("decimal") else self.text

    @property
    def _rank(self) -> tuple[str, object]:
        """Kind and value to compare by: numbers with numbers, days with instants, else text."""
        value = self.value
        if isinstance(value, dt.datetime):
            return "time", value
        if isinstance(value, dt.date):
            return "time", dt.datetime(value.year, value.month, value.day)
        return ("text", value) if isinstance(value, str) else ("number", value)

    def advanced(self, new: Mark | None) -> Mark:
        """The higher of this mark and a newer one, also when the column's type has widened.

        A column whose old and new values cannot be compared starts over with the new mark.
        """
        if new is None:
            return self
        (kind, value), (new_kind, new_value) = self._rank, new._rank
        return self if kind == new_kind and value > new_value else new


@dataclass
class Segment:
    """One commit's files: plain ``rows``, a ``merge`` (rows + keys) or a ``delete`` (keys).

    ``null_keys`` counts the rows that lack a key column's value; None where nobody counted.
    """

    commit: str
    kind: str
    keys: list[str] = field(default_factory=list)
    rows: int = 0
    schema: dict = field(default_factory=dict)
    null_keys: int | None = None


@dataclass
class Version:
    version: int
    operation: str
    committed_at: str
    schema: dict
    segments: list[Segment]
    changed_rows: int = 0
    batches: dict[str, int] = field(default_factory=dict)
    marks: dict[str, Mark] = field(default_factory=dict)

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(self.schema)

    @staticmethod
    def load(text: str) -> Version:
        raw = json.loads(text)
        raw["segments"] = [Segment(**s) for s in raw["segments"]]
        raw["marks"] = {c: Mark(**m) for c, m in raw["marks"].items()}
        return Version(**raw)


def _now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat()


def split_source(source: Source) -> tuple[str, str]:
    layer, table = source if isinstance(source, tuple) else source.split("/", 1)
    return layer, table


def _packed(key: T.StructField) -> Column:
    return packed_text(key.name) if key.dataType == T.StringType() else F.col(key.name)


# Parquet files written with the left type can be read as the right one.
READ_WIDENINGS = {
    (T.ByteType, T.ShortType), (T.ByteType, T.IntegerType), (T.ByteType, T.LongType),
    (T.ShortType, T.IntegerType), (T.ShortType, T.LongType), (T.IntegerType, T.LongType),
    (T.IntegerType, T.DoubleType), (T.FloatType, T.DoubleType), (T.DateType, T.TimestampNTZType),
}


class LakeStore:
    """The only door to the lake: reads, writes, catalog questions, federated sources."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        on_missing_cursor: str = "full",
        fold_ratio: float = 0.1,
        fold_segments: int = 50,
    ):
        if on_missing_cursor not in ("full", "error"):
            raise ValueError("on_missing_cursor must be 'full' or 'error'")
        self.spark = spark
        self.root = root.rstrip("/")
        self.on_missing_cursor = on_missing_cursor
        self.fold_ratio = fold_ratio
        self.fold_segments = fold_segments
        self._files = SharedFiles(spark, self.root)
        self._federated: dict[str, Callable[[], DataFrame]] = {}

    # --- layout ---------------------------------------------------------------------

    def bootstrap(self) -> LakeStore:
        """Create the layer folders once, before any writer; safe to repeat."""
        for layer in LAYERS:
            self._files.make_dirs(f"{self.root}/{layer}")
        return self

    def _table_path(self, layer: str, table: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"unknown layer: {layer}")
        return f"{self.root}/{layer}/{table}"

    def _commit_path(self, layer: str, table: str, commit: str) -> str:
        return f"{self._table_path(layer, table)}/data/{COMMIT}={commit}"

    def _version_numbers(self, layer: str, table: str) -> list[int]:
        names = [n for n, _ in self._files.children(f"{self._table_path(layer, table)}/versions")]
        return sorted(
            int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")
        )

    def _load(self, layer: str, table: str, snapshot: int | None = None) -> Version | None:
        numbers = self._version_numbers(layer, table)
        if snapshot is not None and snapshot not in numbers:
            raise TableNotFound(f"{layer}/{table} has no snapshot {snapshot}")
        if not numbers:
            return None
        number = numbers[-1] if snapshot is None else snapshot
        path = f"{self._table_path(layer, table)}/versions/v{number}.json"
        return Version.load(self._files.read_text(path))

    def _require(self, layer: str, table: str, snapshot: int | None = None) -> Version:
        version = self._load(layer, table, snapshot)
        if version is None:
            raise TableNotFound(f"{layer}/{table}")
        return version

    # --- writes ---------------------------------------------------------------------

    def write(
        self,
        layer: str,
        table: str,
        df: DataFrame,
        mode: str = "overwrite",
        pk: str | Sequence[str] | None = None,
        order: str | Sequence[str] | None = None,
        unique: bool = True,
        sort_by: str | None = None,
        max_records_per_file: int | None = None,
        skip_empty: bool = False,
        batch: tuple[str, int] | None = None,
        track: str | None = None,
    ) -> Version | None:
        """Commit ``df`` as a new version.

        ``overwrite`` replaces rows and schema, ``append`` adds rows by name, ``merge``
        replaces rows by ``pk`` (a first merge creates the table). ``order`` picks the
        winner among incoming rows of one key; ``unique=False`` merges whole groups.
        ``batch=(stream, id)`` makes a repeated streaming batch a no-op. ``track`` names a
        cursor column; its highest value is part of the commit, so the watermark moves
        exactly when the data lands.
        """
        if mode not in ("overwrite", "append", "merge"):
            raise ValueError(f"unknown mode: {mode}")
        pk = [pk] if isinstance(pk, str) else list(pk or [])
        if mode == "merge":
            if not pk:
                raise ValueError("merge needs a key")
            require_columns(df, pk, "merge key")
            if unique:
                df = keep_latest(df, pk, order)
        current = self._load(layer, table)
        if batch and current and current.batches.get(batch[0], -1) >= batch[1]:
            return None
        if mode == "append" and current is not None:
            df = self._aligned(df, current)
        segment, mark = self._stage(layer, table, df, mode, pk, sort_by, max_records_per_file, track)
        if skip_empty and segment.rows == 0:
            self._files.delete(self._commit_path(layer, table, segment.commit))
            return None
        marks = {track: mark} if mark is not None else {}
        return self._commit(layer, table, mode, segment, batch, marks)

    def _aligned(self, df: DataFrame, current: Version) -> DataFrame:
        """Incoming columns take the table's type where that is already wide enough."""
        known = {f.name: f.dataType for f in current.struct}
        return df.select(
            *[
                F.col(f.name).cast(known[f.name]).alias(f.name)
                if f.name in known and widest(known[f.name], f.dataType) == known[f.name]
                else F.col(f.name)
                for f in df.schema
            ]
        )

    def _stage(
        self,
        layer: str,
        table: str,
        df: DataFrame,
        mode: str,
        keys: list[str],
        sort_by: str | None = None,
        max_records_per_file: int | None = None,
        track: str | None = None,
    ) -> tuple[Segment, Mark | None]:
        """Write the files of a commit; nothing is visible until a version lists them.

        Rows, NULL keys and the cursor's maximum are counted in the pass that writes them.
        """
        commit = uuid.uuid4().hex
        path = self._commit_path(layer, table, commit)
        if sort_by and sort_by in df.columns:
            df = df.sortWithinPartitions(sort_by)
        tracked = track is not None and track in df.columns
        measures = [F.count(F.lit(1)).alias("rows")]
        if keys:
            lacking = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
            measures.append(F.count_if(lacking).alias("null_keys"))
        if tracked:
            measures.append(F.max(track).cast("string").alias("top"))
        seen = Observation()
        writer = df.observe(seen, *measures).write.option("compression", "zstd")
        if max_records_per_file:
            writer = writer.option("maxRecordsPerFile", max_records_per_file)
        writer.parquet(path)
        found = seen.get
        mark = None
        if tracked and found["top"] is not None:
            mark = Mark(found["top"], df.schema[track].dataType.simpleString())
        kind = "rows" if mode in ("overwrite", "append") else mode
        lacking = found["null_keys"] if keys else None
        segment = Segment(commit, kind, keys, found["rows"], json.loads(df.schema.json()), lacking)
        return segment, mark

    def _commit(
        self,
        layer: str,
        table: str,
        mode: str,
        segment: Segment | None,
        batch: tuple[str, int] | None = None,
        marks: dict[str, Mark] | None = None,
        build: Callable[[Version], Segment] | None = None,
    ) -> Version | None:
        """Publish the next version; on a clash re-read the table and try again.

        Appends, merges and deletes do not depend on the base, so a retry only places
        the same files after the other writer's. ``build`` makes those that do, once
        for each version they may follow.
        """
        base_path = f"{self._table_path(layer, table)}/versions"
        self._files.make_dirs(base_path)
        base = None
        for attempt in range(MAX_RETRIES):
            current = self._load(layer, table)
            if batch and current and current.batches.get(batch[0], -1) >= batch[1]:
                return None
            if build is not None and current.version != base:
                segment, base = build(current), current.version
            version = self._next(current, mode, segment, batch, dict(marks or {}))
            text = json.dumps(asdict(version))
            if self._files.create_exclusive(f"{base_path}/v{version.version}.json", text):
                return version
            time.sleep(random.uniform(0.02, 0.1) * 2**attempt)
        raise CommitConflict(f"{layer}/{table}")

    def _next(
        self,
        current: Version | None,
        mode: str,
        segment: Segment | None,
        batch: tuple[str, int] | None,
        marks: dict[str, Mark],
    ) -> Version:
        number = 1 if current is None else current.version + 1
        if segment is None:
            moved = {**current.marks, **marks}
            return replace(current, version=number, operation=mode, committed_at=_now(), changed_rows=0, marks=moved)
        schema = T.StructType.fromJson(segment.schema)
        if mode in ("overwrite", "compact") or current is None:
            segments = [Segment(segment.commit, "rows", [], segment.rows, segment.schema)]
        else:
            if mode != "delete":
                schema = common_schema([current.struct, schema])
            else:
                schema = current.struct
            segments = [*current.segments, segment]
        batches = dict(current.batches) if current else {}
        if batch:
            batches[batch[0]] = batch[1]
        if current is not None and mode != "overwrite":
            kept = {c: m.advanced(marks.get(c)) for c, m in current.marks.items()}
            marks = {**marks, **kept}
        return Version(
            number,
            mode,
            _now(),
            json.loads(schema.json()),
            segments,
            segment.rows,
            batches,
            marks,
        )

    @staticmethod
    def _readable(segment: Segment, schema: T.StructType) -> bool:
        """Whether Parquet itself can read these files with the table's current types."""
        stored = {f.name: f.dataType for f in T.StructType.fromJson(segment.schema)}
        for f in schema:
            have = stored.get(f.name, f.dataType)
            if have != f.dataType and (type(have), type(f.dataType)) not in READ_WIDENINGS:
                return False
        return True

    def delete_where_in(self, source: Source, column: str | Sequence[str], keys: DataFrame) -> Version | None:
        """Remove the rows whose column (or columns) is in the key table; only the keys are stored."""
        layer, table = split_source(source)
        current = self._require(layer, table)
        columns = [column] if isinstance(column, str) else list(column)
        for c in columns:
            if c not in current.struct.names:
                raise ValueError(f"{c} not in {layer}/{table}")
        staged = keys.select(*[F.col(c).cast(current.struct[c].dataType).alias(c) for c in columns]).distinct()
        segment, _ = self._stage(layer, table, staged, "delete", columns)
        return self._commit(layer, table, "delete", segment)

    def upsert_columns(
        self, source: Source, df: DataFrame, on: str | Sequence[str], update: Sequence[str]
    ) -> Version | None:
        """MERGE with a column list; only the changed and new rows are stored.

        The rows are completed from the base, so a clash with another writer redoes them.
        """
        layer, table = split_source(source)
        keys = [on] if isinstance(on, str) else list(on)

        def build(base: Version) -> Segment:
            rows = upsert_delta(self._read_version(layer, table, base), df, keys, update)
            return self._stage(layer, table, rows, "merge", keys)[0]

        self._require(layer, table)
        return self._commit(layer, table, "merge", None, build=build)

    def apply_changes(
        self,
        source: Source,
        changes: DataFrame,
        pk: str | Sequence[str],
        seq: str | Sequence[str],
        op_col: str,
        delete_op: str = "delete",
        batch: tuple[str, int] | None = None,
        track: str | None = None,
    ) -> Version | None:
        """Change feed: the last change per key is merged, or removes its row.

        Rows and tombstones go into one commit, so readers see all of a batch or none. Each
        keeps its sequence, and a change behind the one its key has already seen is left
        out, so batches may arrive in any order. Only keys and sequences of the table are
        read for that, and a clash with another writer looks again.
        """
        layer, table = split_source(source)
        pk = [pk] if isinstance(pk, str) else list(pk)
        order = [seq] if isinstance(seq, str) else list(seq)
        places = {c: f"{SEQUENCE}_{i}" for i, c in enumerate(order)}
        last = keep_latest(changes, pk, seq).withColumns({name: F.col(c) for c, name in places.items()})
        current = self._load(layer, table)
        if current is not None:
            last = last.drop(*[c for c in order if c not in current.struct.names])
        staged = last.withColumn(DELETED, F.col(op_col).eqNullSafe(delete_op)).drop(op_col)
        if current is None:
            return self.write(layer, table, staged, "merge", pk=pk, unique=False, batch=batch, track=track)
        marks: dict[str, Mark] = {}

        def build(base: Version) -> Segment:
            fresh = self._not_behind(layer, table, base, staged, pk, list(places.values()))
            segment, mark = self._stage(layer, table, fresh, "merge", pk, track=track)
            if mark is not None:
                marks[track] = mark
            return segment

        return self._commit(layer, table, "merge", None, batch, marks, build)

    def _not_behind(
        self, layer: str, table: str, base: Version, staged: DataFrame, pk: list[str], places: list[str]
    ) -> DataFrame:
        """Changes whose key has no row or tombstone of a later sequence in ``base``."""
        if any(p not in base.struct.names for p in places):
            return staged
        known = self._read_version(layer, table, base, hidden=True).select(
            *[F.col(c).alias(f"_key_{c}") for c in pk], F.struct(*places).alias("_known")
        )
        later = (F.col("_known") > F.struct(*places)) & F.col(f"_known.{places[0]}").isNotNull()
        for c in pk:
            later = later & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
        return staged.join(known, later, "left_anti")

    def compact(self, source: Source, sort_by: str | None = None) -> Version:
        """Same rows in few, evenly sized files; deltas and deletes are folded in.

        Rows and tombstones of a change feed keep their sequences.
        """
        layer, table = split_source(source)

        def build(base: Version) -> Segment:
            rows = self._read_version(layer, table, base, hidden=True).hint("rebalance")
            return self._stage(layer, table, rows, "compact", [], sort_by)[0]

        self._require(layer, table)
        return self._commit(layer, table, "compact", None, build=build)

    def needs_compaction(self, source: Source) -> bool:
        """Whether the deltas have grown to ``fold_ratio`` of the base, or many await a fold."""
        segments = self._require(*split_source(source)).segments
        delta = sum(s.rows for s in segments[1:])
        return delta > self.fold_ratio * segments[0].rows or len(self._young(segments)) > self.fold_segments

    def fold(self, source: Source, sort_by: str | None = None) -> Version:
        """The fold that is due: of the whole table once its deltas are a share of it, else of
        the young deltas among themselves, so that many small commits never rewrite the base."""
        layer, table = split_source(source)
        segments = self._require(layer, table).segments
        if sum(s.rows for s in segments[1:]) > self.fold_ratio * segments[0].rows:
            return self.compact(source, sort_by)
        return self._fold_young(layer, table, sort_by)

    @staticmethod
    def _young(segments: Sequence[Segment]) -> list[Segment]:
        """The newest deltas of one kind and key; what an earlier fold made is as large as all
        of them together and stays apart until they have caught up with it."""
        young: list[Segment] = []
        rows = 0
        for segment in reversed(segments[1:]):
            first = young[0] if young else segment
            if (segment.kind, segment.keys) != (first.kind, first.keys):
                break
            if segment.rows > max(rows, 1) and len(young) > 1:
                break
            young.append(segment)
            rows += segment.rows
        return young[::-1]

    def _fold_young(self, layer: str, table: str, sort_by: str | None) -> Version:
        """One segment in place of the young ones; the rest of the version stays as it is."""
        for attempt in range(MAX_RETRIES):
            current = self._require(layer, table)
            young = self._young(current.segments)
            if len(young) < 2:
                return current
            alone = replace(current, segments=young)
            if young[0].kind == "delete":
                keys = T.StructType([current.struct[k] for k in young[0].keys])
                rows = self._scan(layer, table, young, keys).drop(COMMIT).distinct()
            else:
                rows = self._read_version(layer, table, alone, hidden=True)
            made, _ = self._stage(layer, table, rows.hint("rebalance"), young[0].kind, young[0].keys, sort_by)
            made = replace(made, kind=young[0].kind)
            kept = [s for s in current.segments if s not in young]
            version = replace(
                current, version=current.version + 1, operation="fold", committed_at=_now(), changed_rows=0,
                segments=[*kept, made],
            )
            path = f"{self._table_path(layer, table)}/versions/v{version.version}.json"
            if self._files.create_exclusive(path, json.dumps(asdict(version))):
                return version
            time.sleep(random.uniform(0.02, 0.1) * 2**attempt)
        raise CommitConflict(f"{layer}/{table}")

    def vacuum(self, source: Source, keep: int = 1, older_than_seconds: int = 3600) -> list[str]:
        """Drop old versions and the files only they used; returns the dropped commits.

        Files younger than ``older_than_seconds`` may belong to a running writer and stay.
        """
        layer, table = split_source(source)
        base = self._table_path(layer, table)
        numbers = self._version_numbers(layer, table)
        kept = [self._load(layer, table, n) for n in numbers[-keep:]]
        used = {s.commit for v in kept for s in v.segments}
        limit = (time.time() - older_than_seconds) * 1000
        for number in numbers[:-keep]:
            self._files.delete(f"{base}/versions/v{number}.json")
        dropped = []
        for name, modified in self._files.children(f"{base}/data"):
            commit = name.removeprefix(f"{COMMIT}=")
            if commit not in used and modified <= limit:
                self._files.delete(f"{base}/data/{name}")
                dropped.append(commit)
        return dropped

    # --- reads ----------------------------------------------------------------------

    def attach_federation(self, name: str, load: Callable[[], DataFrame]) -> None:
        """Register an external table; it is read with the same call as a lake table."""
        self._federated[name] = load
        load().createOrReplaceTempView(f"{FEDERATED}_{name}")

    def read(
        self,
        source: Source,
        columns: Sequence[str] | None = None,
        watermark: object | None = None,
        cursor: str = "updated_at",
        snapshot: int | None = None,
        on_missing_cursor: str | None = None,
    ) -> DataFrame:
        """Rows of a lake table or a federated source, as a DataFrame either way.

        ``watermark`` keeps rows with ``cursor > watermark``. A table without the cursor
        column is read whole, or refused with ``on_missing_cursor="error"``.
        """
        layer, table = split_source(source)
        if layer == FEDERATED:
            if table not in self._federated:
                raise TableNotFound(f"{FEDERATED}/{table}")
            df = self._federated[table]()
        else:
            df = self._read_version(layer, table, self._require(layer, table, snapshot))
        if watermark is not None:
            if cursor in df.columns:
                df = df.where(beyond(df, cursor, watermark))
            elif (on_missing_cursor or self.on_missing_cursor) == "error":
                raise ValueError(f"{layer}/{table} has no cursor column {cursor}")
        return df.select(*columns) if columns else df

    def read_derived(self, source: Source, *derived: Column) -> DataFrame:
        """``read(source).select(*derived)``, for columns far smaller than the rows they are made of.

        They are made before replaced rows are hidden, so they and the keys, not the rows, travel.
        """
        layer, table = split_source(source)
        return self._read_version(layer, table, self._require(layer, table), derived=derived)

    def _scan(
        self, layer: str, table: str, segments: Sequence[Segment], schema: T.StructType
    ) -> DataFrame:
        """All files of the given commits as one relation, plus their commit id.

        Files whose types only a cast can bridge (text against a number) are read apart.
        """
        native = [s for s in segments if self._readable(s, schema)]
        frames = [self._relation(layer, table, native, schema)] if native else []
        target = T.StructType([*schema.fields, T.StructField(COMMIT, T.StringType())])
        for segment in (s for s in segments if s not in native):
            names = [f for f in T.StructType.fromJson(segment.schema) if f.name in schema.names]
            own = self._relation(layer, table, [segment], T.StructType(names))
            frames.append(conform(own, target))
        return reduce(DataFrame.unionByName, frames)

    def _relation(
        self, layer: str, table: str, segments: Sequence[Segment], schema: T.StructType
    ) -> DataFrame:
        base = f"{self._table_path(layer, table)}/data"
        paths = [self._commit_path(layer, table, s.commit) for s in segments]
        with_commit = T.StructType([*schema.fields, T.StructField(COMMIT, T.StringType())])
        return self.spark.read.schema(with_commit).option("basePath", base).parquet(*paths)

    def _read_version(
        self, layer: str, table: str, version: Version | None, hidden: bool = False, derived: Sequence[Column] = ()
    ) -> DataFrame:
        """The rows of a version, or what is ``derived`` from them; ``hidden`` keeps tombstones and sequences."""
        if version is None:
            raise TableNotFound(f"{layer}/{table}")
        schema = version.struct
        holders = [s for s in version.segments if s.kind in ("rows", "merge")]
        # A delete or merge that comes first has nothing to hide.
        hiders = [s for s in version.segments[1:] if s.kind in ("merge", "delete")]
        rows = self._scan(layer, table, holders, schema)
        if derived:
            keys = sorted({k for s in hiders for k in s.keys})
            alive = [F.col(DELETED)] if DELETED in schema.names else []
            rows = rows.select(*derived, *[_packed(schema[k]).alias(f"_own_{k}") for k in keys], COMMIT, *alive)
        if hiders:
            rows = self._hide(layer, table, version, rows, hiders, bool(derived))
        if derived:
            rows = rows.drop(*[f"_own_{k}" for k in keys])
        if DELETED in schema.names and not hidden:
            rows = rows.where(f"{DELETED} IS NULL OR NOT {DELETED}").drop(DELETED)
        return rows.drop(COMMIT, *[n for n in schema.names if n.startswith(SEQUENCE) and not hidden])

    def _hide(
        self,
        layer: str,
        table: str,
        version: Version,
        rows: DataFrame,
        hiders: Sequence[Segment],
        packed: bool = False,
    ) -> DataFrame:
        """Drop rows replaced or removed by a later commit: one anti-join per key set.

        Keys without NULLs are compared plainly, which lets what follows use the join's partitions.
        """
        places = {s.commit: i for i, s in enumerate(version.segments)}
        pairs = [F.lit(x) for pair in places.items() for x in pair]
        place = F.element_at(F.create_map(*pairs), F.col(COMMIT))
        rows = rows.withColumn("_place", place)
        for keys in sorted({tuple(sorted(s.keys)) for s in hiders}):
            group = [s for s in hiders if tuple(sorted(s.keys)) == keys]
            key_schema = T.StructType([version.struct[k] for k in keys])
            marks = self._scan(layer, table, group, key_schema).select(
                *[(_packed(version.struct[k]) if packed else F.col(k)).alias(f"_key_{k}") for k in keys], place.alias("_later")
            )
            if any(s.kind == "merge" for s in group):
                # Groups repeat their key; keys of unique merges hardly do.
                marks = marks.groupBy(*[f"_key_{k}" for k in keys]).agg(
                    F.max("_later").alias("_later")
                )
            hit = F.col("_later") > F.col("_place")
            for k in keys:
                own, key = F.col(f"_own_{k}" if packed else k), F.col(f"_key_{k}")
                hit = hit & (own == key if all(s.null_keys == 0 for s in group) else own.eqNullSafe(key))
            rows = rows.join(marks, hit, "left_anti")
        return rows.drop("_place")

    def read_delta_of(self, source: Source, version: Version) -> DataFrame:
        """Only the rows a commit brought in."""
        layer, table = split_source(source)
        commit = version.segments[-1].commit
        own = [s for s in version.segments if s.commit == commit]
        return self._scan(layer, table, own, T.StructType.fromJson(own[0].schema)).drop(COMMIT)

    def mark(self, source: Source, cursor: str) -> object | None:
        """Highest value of a tracked cursor, from the version file alone."""
        version = self._load(*split_source(source))
        found = version.marks.get(cursor) if version else None
        return found.value if found else None

    def marks(self, source: Source) -> dict[str, Mark]:
        version = self._load(*split_source(source))
        return dict(version.marks) if version else {}

    def set_mark(self, source: Source, cursor: str, mark: Mark) -> Version:
        """Commit a mark without data; it may not move back."""
        layer, table = split_source(source)
        old = self._require(layer, table).marks.get(cursor)
        if old is not None and old.advanced(mark) != mark:
            raise ValueError(f"{layer}/{table}: {cursor} mark {mark.text} is behind {old.text}")
        return self._commit(layer, table, "mark", None, marks={cursor: mark})

    def pin(self, source: Source) -> DataFrame:
        """A stable snapshot: later commits do not change what it returns."""
        layer, table = split_source(source)
        return self.read(source, snapshot=self._require(layer, table).version)

    # --- catalog --------------------------------------------------------------------

    def table_names(self, layer: str) -> list[str]:
        return [
            name
            for name, _ in self._files.children(f"{self.root}/{layer}")
            if self._version_numbers(layer, name)
        ]

    def table_exists(self, source: Source) -> bool:
        layer, table = split_source(source)
        if layer == FEDERATED:
            return table in self._federated
        return bool(self._version_numbers(layer, table))

    def current_version(self, source: Source) -> int:
        return self._require(*split_source(source)).version

    def last_batch(self, source: Source, stream: str) -> int:
        version = self._load(*split_source(source))
        return version.batches.get(stream, -1) if version else -1

    def list_tables(self, layer: str) -> DataFrame:
        rows = [(layer, t, self.current_version((layer, t))) for t in self.table_names(layer)]
        return self.spark.createDataFrame(rows, "layer string, table_name string, version int")

    def schema_of(self, source: Source) -> T.StructType:
        """Schema of a table, from its version file."""
        layer, table = split_source(source)
        if layer == FEDERATED:
            return self.read(source).schema
        fields = self._require(layer, table).struct.fields
        return T.StructType([f for f in fields if f.name != DELETED and not f.name.startswith(f"{SEQUENCE}_")])

    def get_columns(self, source: Source) -> DataFrame:
        fields = self.schema_of(source)
        rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)]
        return self.spark.createDataFrame(rows, "position int, column_name string, data_type string")

    def count(self, source: Source) -> int:
        return self.read(source).count()

    def snapshots(self, source: Source) -> DataFrame:
        """One row per version: id, time, operation, schema size, rows brought in."""
        layer, table = split_source(source)
        self._require(layer, table)
        versions = self.spark.read.text(
            f"{self._table_path(layer, table)}/versions/v*.json", wholetext=True
        )
        shape = (
            "version int, operation string, committed_at string, changed_rows bigint, "
            "schema struct<fields: array<struct<name: string>>>, segments array<struct<commit: string>>"
        )
        parsed = versions.select(F.from_json("value", shape).alias("v"))
        return parsed.select(
            F.lit(f"{layer}/{table}").alias("table_name"),
            F.col("v.version").alias("snapshot_id"),
            F.to_timestamp("v.committed_at").alias("snapshot_time"),
            F.col("v.operation").alias("operation"),
            F.size("v.schema.fields").alias("columns"),
            F.size("v.segments").alias("segments"),
            F.col("v.changed_rows").alias("changed_rows"),
        )

    def snapshot_changes(self) -> DataFrame:
        """What every snapshot of every table did."""
        frames = [
            self.snapshots((layer, t)) for layer in LAYERS for t in self.table_names(layer)
        ]
        if not frames:
            raise TableNotFound("the lake is empty")
        changes = frames[0]
        for frame in frames[1:]:
            changes = changes.unionByName(frame)
        return changes.select("table_name", "snapshot_id", "operation", "changed_rows")

    def data_files(self, source: Source) -> DataFrame:
        """Record count and size of every data file of the current version."""
        layer, table = split_source(source)
        version = self._require(layer, table)
        scan = self._relation(layer, table, version.segments, T.StructType([]))
        return (
            scan.select(COMMIT, "_metadata.file_path", "_metadata.file_size")
            .groupBy(COMMIT, "file_path", "file_size")
            .agg(F.count("*").alias("record_count"))
        )

    def column_stats(self, source: Source, per_file: bool = False) -> DataFrame:
        """min / max / NULL count of every column, per table or per data file."""
        layer, table = split_source(source)
        if per_file:
            version = self._require(layer, table)
            holders = [s for s in version.segments if s.kind != "delete"]
            df = self._relation(layer, table, holders, version.struct).drop(COMMIT)
            return column_stats(df, F.col("_metadata.file_path").alias("file_path"))
        return column_stats(self.read(source))

    # --- SQL ------------------------------------------------------------------------

    def register_views(self, names: Sequence[str]) -> list[str]:
        """A temp view ``<layer>_<table>`` for each of ``names`` that is a table of the lake;
        federated ones (``fed_<name>``) are views already. Returns those found."""
        found = []
        for name in names:
            layer, _, table = name.partition("_")
            if layer == FEDERATED and table in self._federated:
                found.append(name)
            elif layer in LAYERS and table and self.table_exists((layer, table)):
                self.read((layer, table)).createOrReplaceTempView(name)
                found.append(name)
        return found

    def sql(self, text: str) -> DataFrame:
        """Any SQL over all layers; only the tables it names are opened."""
        self.register_views([".".join(n) for n in parsed_query(self.spark, text).relations])
        return self.spark.sql(text)

    # --- moving tables --------------------------------------------------------------

    def backfill_into(self, target: LakeStore, layers: Sequence[str] = LAYERS) -> None:
        """Copy every table of this lake into another one."""
        for layer in layers:
            for table in self.table_names(layer):
                target.write(layer, table, self.read((layer, table)), "overwrite")

    def verify_backfill(self, target: LakeStore, layers: Sequence[str] = LAYERS) -> DataFrame:
        """Row counts of both lakes side by side, flagged OK or DIVERGES; -1 is no table."""
        frames = []
        for side, store in (("source", self), ("target", target)):
            for layer in layers:
                frames += [
                    store.read((layer, table)).agg(F.count("*").alias("n")).select(
                        F.lit(f"{layer}/{table}").alias("table_name"), F.lit(side).alias("side"), "n"
                    )
                    for table in store.table_names(layer)
                ]
        if not frames:
            raise TableNotFound("nothing to verify")
        counts = reduce(DataFrame.unionByName, frames)

        def rows_of(side: str) -> Column:
            rows = F.max(F.when(F.col("side") == side, F.col("n")))
            return F.coalesce(rows, F.lit(-1).cast("bigint")).alias(f"{side}_rows")

        pairs = counts.groupBy("table_name").agg(rows_of("source"), rows_of("target"))
        same = F.col("source_rows") == F.col("target_rows")
        return pairs.withColumn("status", F.when(same, "OK").otherwise("DIVERGES"))


def column_stats(df: DataFrame, *group: Column) -> DataFrame:
    """One pass over ``df``: (column, min, max, null count) rows, values as text."""
    plain = [f for f in df.schema if not isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType))]
    measures = []
    for i, f in enumerate(plain):
        measures += [
            F.min(f.name).cast("string").alias(f"min_{i}"),
            F.max(f.name).cast("string").alias(f"max_{i}"),
            F.count_if(F.col(f.name).isNull()).alias(f"nulls_{i}"),
        ]
    wide = df.groupBy(*group).agg(*measures)
    stats = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.col(f"min_{i}").alias("min_value"),
                F.col(f"max_{i}").alias("max_value"),
                F.col(f"nulls_{i}").alias("null_count"),
            )
            for i, f in enumerate(plain)
        ]
    )
    keys = [c for c in wide.columns if c == "file_path"]
    return wide.select(*keys, F.inline(stats))


def dual_write(
    df: DataFrame,
    first: LakeStore,
    second: LakeStore,
    layer: str,
    table: str,
    **options,
) -> tuple[Version | None, Version | None]:
    """Write to two lakes during a cut-over; the second copy reads what the first landed."""
    left = first.write(layer, table, df, **options)
    if left is None:
        return None, None
    landed = first.read_delta_of((layer, table), left)
    return left, second.write(layer, table, landed, **options)
