"""Structured Streaming forms of the sync: landed files and change feeds.

Every batch is committed under ``(stream, batch id)``. A batch replayed after a crash
finds its id in the table's version and does nothing: exactly once per table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tarn.lake.files import SharedFiles
from tarn.lake.store import LakeStore
from tarn.streaming.config import ResourceConfig


def landed_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    file_format: str = "parquet",
    max_files: int | None = None,
) -> DataFrame:
    """Stream over files as they land; ``max_files`` bounds a batch.

    ``path`` is a folder or one file (which is then watched for in its folder).
    """
    reader = spark.readStream.schema(schema)
    if SharedFiles(spark, path).is_file(path):
        path, name = path.rstrip("/").rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.format(file_format).load(path)


def _run(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _fold(lake: LakeStore, source: tuple[str, str], sort_by: str | None = None) -> None:
    if lake.table_exists(source) and lake.needs_compaction(source):
        lake.fold(source, sort_by=sort_by)


def stream_sync(
    lake: LakeStore, stream: DataFrame, config: ResourceConfig, checkpoint: str
) -> None:
    """Merge everything that has landed, then stop; the next call resumes after it."""
    if not config.pk or not config.cursor:
        raise ValueError(f"{config.table} needs a key and a cursor")

    def merge(batch: DataFrame, batch_id: int) -> None:
        lake.write(
            "raw", config.table, batch, "merge", pk=list(config.pk), order=config.cursor,
            unique=config.unique, sort_by=config.cursor, batch=(config.table, batch_id),
            track=config.cursor,
        )

    _run(stream, checkpoint, merge)
    _fold(lake, ("raw", config.table), config.cursor)


def stream_changes(
    lake: LakeStore,
    stream: DataFrame,
    table: str,
    pk: str | Sequence[str],
    seq: str | Sequence[str],
    op_col: str,
    checkpoint: str,
    delete_op: str = "delete",
    layer: str = "raw",
) -> None:
    """Change feed onto a table: upserts and deletes of each batch in one commit."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        lake.apply_changes(
            (layer, table), batch, pk, seq, op_col, delete_op, batch=(table, batch_id)
        )

    _run(stream, checkpoint, apply)
    _fold(lake, (layer, table))
