"""Session defaults and the shared folder used for checkpoints and scratch tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Scratch paths of this process, and the fallback folder of each local session.
_SCRATCH: list[str] = []
_OWN_ROOT: dict[str, str] = {}


def build_session(
    app: str = "tarn", master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """A session with the settings the library relies on.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: AQE then
    coalesces and splits partitions by size, and spark-submit picks the rest.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config(
            "spark.ui.showConsoleProgress", "false"
        )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local session that names none (tests, a laptop) falls back to a folder of its
    own; on a cluster a folder of one machine would lose rows, so that is an error. The
    fallback is removed when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor reaches")
        app = spark.sparkContext.applicationId
        if app not in _OWN_ROOT:
            _OWN_ROOT[app] = tempfile.mkdtemp(prefix="tarn-")
            atexit.register(shutil.rmtree, _OWN_ROOT[app], ignore_errors=True)
        root = _OWN_ROOT[app]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, kept until ``drop_scratch``."""
    path = f"{shared_root(spark)}/tarn/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete what this process wrote to the shared folder; call it when a run's results are stored."""
    paths, _SCRATCH[:] = list(_SCRATCH), []
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)
    return len(paths)


#: Rows that one task is dealt where the tasks are numbered.
ROWS_A_TASK = 250_000


def tasks_for(rows: int | None) -> int:
    """Tasks to deal this many rows to, so that what one of them holds does not grow with the input.

    Adaptive execution joins partitions by their compressed bytes; a numbered repartition it leaves alone.
    """
    return max(1, -(-(rows or 0) // ROWS_A_TASK))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A lost executor then costs no replay, and unlike a checkpointed RDD the table tells the
    planner its size.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
