"""Batch sync engine: source -> raw, with the watermark advanced after the data landed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.ids import load_stamp, row_id
from tarn.lake.store import LakeStore, Version
from tarn.operators.merge import union_relaxed
from tarn.session import tasks_for
from tarn.sources.jdbc import read_increment
from tarn.streaming.config import ResourceConfig, derive_mode
from tarn.streaming.state import RunLog, SyncState


@dataclass(frozen=True)
class SyncResult:
    status: str
    mode: str
    records: int
    watermark: object | None
    version: Version | None = None


def _since(last: object | None, lookback: object | None) -> object | None:
    """Start of the read: the mark, moved back by ``lookback`` to catch late rows."""
    return last if last is None or lookback is None else last - lookback


def sync_resource(
    lake: LakeStore, source: DataFrame, config: ResourceConfig, full_refresh: bool = False
) -> SyncResult:
    """One run for one resource.

    The watermark is part of the data commit and the run log comes last. A run that dies
    before the commit is repeated from the old mark; the merge makes a repeat harmless.
    """
    log = RunLog(lake)
    run_id = log.start(config.connector, config.resource)
    try:
        result = _sync(lake, source, config, full_refresh)
    except Exception as error:
        log.finish(run_id, config.connector, config.resource, "failed", 0, str(error))
        raise
    log.finish(run_id, config.connector, config.resource, result.status, result.records)
    log.fold()
    return result


def _sync(lake: LakeStore, source: DataFrame, config: ResourceConfig, full: bool) -> SyncResult:
    mode = derive_mode(config, source.columns)
    if config.stamp:
        source = source.withColumns({"_row_id": row_id(), "_loaded_at": load_stamp()})
    incremental = mode == "merge" and config.mode == "incremental" and config.supports_incremental
    if incremental and config.partition and not full:
        return _sync_by_partition(lake, source, config)
    target = ("raw", config.table)
    # One mark cannot stand for several sub-resources: without a partition they are read whole.
    marked = incremental and not full and config.cursor and not config.consolidated
    last = lake.mark(target, config.cursor) if marked else None
    rows = read_increment(source, config.cursor, _since(last, config.lookback))
    if full and mode == "merge" and not config.consolidated:
        mode = "overwrite"
    version = lake.write(
        *target,
        rows,
        mode,
        pk=list(config.pk) or None,
        order=config.cursor,
        unique=config.unique,
        sort_by=config.cursor,
        skip_empty=mode == "merge",
        track=config.cursor,
    )
    if version is None:
        return SyncResult("skipped", mode, 0, last)
    if lake.needs_compaction(target):
        lake.fold(target, sort_by=config.cursor)
    mark = lake.mark(target, config.cursor) if config.cursor else None
    return SyncResult("completed", mode, version.changed_rows, mark, version)


def partition_delta(
    source: DataFrame, marks: DataFrame, partition: str, cursor: str
) -> DataFrame:
    """Rows beyond the mark of their own partition; unseen partitions come whole."""
    seen = marks.select(F.col("partition").alias("_partition"), F.col("mark").alias("_mark"))
    joined = source.join(seen, F.col(partition).cast("string") == F.col("_partition"), "left")
    return joined.where(F.col("_mark").isNull() | (F.col(cursor) > F.col("_mark"))).drop(
        "_partition", "_mark"
    )


def _sync_by_partition(lake: LakeStore, source: DataFrame, config: ResourceConfig) -> SyncResult:
    """One cursor per drive, space, database or channel inside the resource.

    The marks are committed after the data; a run that dies in between is merged again.
    """
    state = SyncState(lake)
    target = ("raw", config.table)
    kind = dict(source.dtypes)[config.cursor]
    marks = state.partition_marks(config.connector, config.resource, kind)
    delta = partition_delta(source, marks, config.partition, config.cursor)
    version = lake.write(
        *target, delta, "merge", pk=list(config.pk), order=config.cursor, unique=config.unique,
        sort_by=config.cursor, skip_empty=True,
    )
    if version is None:
        return SyncResult("skipped", "merge", 0, None)
    landed = lake.read_delta_of(target, version)
    top = landed.groupBy(F.col(config.partition).cast("string").alias("partition")).agg(
        F.max(config.cursor).alias("mark")
    )
    state.advance_partitions(config.connector, config.resource, top)
    if lake.needs_compaction(target):
        lake.fold(target, sort_by=config.cursor)
    return SyncResult("completed", "merge", version.changed_rows, None, version)


def sync_children(
    lake: LakeStore, parents: DataFrame, children: DataFrame, fk: str, parent_pk: str, table: str, rows: int | None = None,
) -> Version | None:
    """Children of changed parents: their whole group is replaced, so removals vanish too.

    ``parents`` is the parent's delta. One commit, so readers never see half a group. ``rows`` tells how
    many both sides have, where that is known: they are then dealt by the key to as many tasks as they need.
    """
    changed = parents.select(F.col(parent_pk).alias(fk))
    if rows is not None:
        tasks = tasks_for(rows)
        changed, children = changed.repartition(tasks, fk), children.repartition(tasks, fk)
    changed = changed.distinct()
    fresh = children.join(changed, fk, "left_semi").withColumn("_deleted", F.lit(False))
    # A marker per changed parent hides its old children even when none are left.
    markers = changed.withColumn("_deleted", F.lit(True))
    rows_and_markers = union_relaxed(fresh, markers)
    return lake.write("raw", table, rows_and_markers, "merge", pk=fk, unique=False, skip_empty=True)
