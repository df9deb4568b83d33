"""Watermarks and the run log.

A watermark lives in the version file of the raw table it belongs to, so it is committed
together with the data it describes: a run that dies before the commit moved nothing.
Cursors per partition can be many, so they are rows of a table in the state layer.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.lake.files import SharedFiles
from tarn.lake.store import LakeStore, Mark
from tarn.operators.merge import keep_latest, union_relaxed

PARTITION_MARKS = ("state", "partition_marks")
RUNS = ("state", "sync_runs")
WATERMARK_SCHEMA = "connector string, resource string, cursor string, value string, value_type string"
PARTITION_SCHEMA = (
    "connector string, resource string, partition string, value string, value_type string, "
    "updated_at timestamp"
)
RUN_SCHEMA = (
    "run_id string, connector string, resource string, status string, records bigint, "
    "message string, at timestamp"
)
PARTITION_KEY = ["connector", "resource", "partition"]
# Type of a mark by the type of its Python value.
VALUE_TYPES = {int: "bigint", float: "double", str: "string", dt.date: "date"}
# Run-log files are folded into a table beyond this number.
LOG_FILES = 1000


class WatermarkMovedBack(ValueError):
    pass


def as_mark(value: object) -> Mark:
    """A mark from a Python value; its type travels with it."""
    if isinstance(value, dt.datetime):
        return Mark(value.isoformat(sep=" "), "timestamp" if value.tzinfo else "timestamp_ntz")
    return Mark(str(value), VALUE_TYPES[type(value)])


class SyncState:
    """Highest cursor value per (connector, resource), and per partition where asked."""

    def __init__(self, lake: LakeStore):
        self.lake = lake

    @staticmethod
    def _source(connector: str, resource: str) -> tuple[str, str]:
        return "raw", f"{connector}__{resource}"

    def get(self, connector: str, resource: str, cursor: str) -> object | None:
        return self.lake.mark(self._source(connector, resource), cursor)

    def advance(self, connector: str, resource: str, cursor: str, value: object) -> None:
        """Move a mark by hand; refuses to go backwards."""
        try:
            self.lake.set_mark(self._source(connector, resource), cursor, as_mark(value))
        except ValueError as error:
            raise WatermarkMovedBack(str(error)) from error

    def table(self) -> DataFrame:
        """All marks: one row per tracked cursor of a raw table."""
        rows = []
        for name in self.lake.table_names("raw"):
            connector, _, resource = name.partition("__")
            for cursor, mark in self.lake.marks(("raw", name)).items():
                rows.append((connector, resource, cursor, mark.text, mark.type))
        return self.lake.spark.createDataFrame(rows, WATERMARK_SCHEMA)

    def partition_marks(self, connector: str, resource: str, value_type: str) -> DataFrame:
        """``partition, mark`` with the mark in its own type."""
        if not self.lake.table_exists(PARTITION_MARKS):
            stored = self.lake.spark.createDataFrame([], PARTITION_SCHEMA)
        else:
            stored = self.lake.read(PARTITION_MARKS)
        mine = (F.col("connector") == connector) & (F.col("resource") == resource)
        return stored.where(mine).select("partition", F.col("value").cast(value_type).alias("mark"))

    def advance_partitions(self, connector: str, resource: str, marks: DataFrame) -> None:
        """Merge ``partition, mark`` rows; partitions that did not move keep theirs."""
        kind = dict(marks.dtypes)["mark"]
        known = self.partition_marks(connector, resource, kind)
        moved = (
            marks.join(known.withColumnRenamed("mark", "_old"), "partition", "left")
            .where("mark IS NOT NULL AND (_old IS NULL OR mark > _old)")
            .select(
                F.lit(connector).alias("connector"),
                F.lit(resource).alias("resource"),
                "partition",
                F.col("mark").cast("string").alias("value"),
                F.lit(kind).alias("value_type"),
                F.current_timestamp().alias("updated_at"),
            )
        )
        self.lake.write(*PARTITION_MARKS, moved, "merge", pk=PARTITION_KEY, skip_empty=True)
        if self.lake.needs_compaction(PARTITION_MARKS):
            self.lake.fold(PARTITION_MARKS)


class RunLog:
    """History of the syncs: running, then completed, skipped or failed.

    An entry is one small file, written without a Spark job; old entries are folded
    into a table.
    """

    def __init__(self, lake: LakeStore):
        self.lake = lake
        self._folder = f"{lake.root}/state/sync_run_entries"
        self._files = SharedFiles(lake.spark, lake.root)

    def start(self, connector: str, resource: str) -> str:
        run_id = str(uuid.uuid4())
        self._append(run_id, connector, resource, "running", None, None)
        return run_id

    def finish(
        self, run_id: str, connector: str, resource: str, status: str, records: int = 0,
        message: str | None = None,
    ) -> None:
        self._append(run_id, connector, resource, status, records, message)

    def _append(
        self, run_id: str, connector: str, resource: str, status: str, records: int | None,
        message: str | None,
    ) -> None:
        entry = {
            "run_id": run_id, "connector": connector, "resource": resource, "status": status,
            "records": records, "message": message,
            "at": dt.datetime.now(dt.timezone.utc).isoformat(),
        }
        self._files.make_dirs(self._folder)
        self._files.create_exclusive(f"{self._folder}/{run_id}-{status}.json", json.dumps(entry))

    def _entries(self) -> DataFrame:
        self._files.make_dirs(self._folder)
        return self.lake.spark.read.schema(RUN_SCHEMA).json(self._folder)

    def table(self) -> DataFrame:
        entries = self._entries()
        if self.lake.table_exists(RUNS):
            entries = union_relaxed(self.lake.read(RUNS), entries)
        return entries.distinct()

    def latest(self) -> DataFrame:
        """Last status of every run."""
        return keep_latest(self.table(), "run_id", "at")

    def fold(self, at_least: int = LOG_FILES) -> None:
        """Move the entry files into the run table once there are many of them."""
        names = [n for n, _ in self._files.children(self._folder) if n.endswith(".json")]
        if len(names) < at_least:
            return
        paths = [f"{self._folder}/{n}" for n in names]
        self.lake.write(*RUNS, self.lake.spark.read.schema(RUN_SCHEMA).json(paths), "append")
        for path in paths:
            self._files.delete(path)


def columns_with_cursor(tables: dict[str, Sequence[str]], cursor: str) -> list[tuple[str, bool]]:
    """Audit: which tables carry the cursor column."""
    return [(name, cursor in cols) for name, cols in sorted(tables.items())]
