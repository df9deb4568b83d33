"""Inherited grants without the closure: paths of containers as range keys.

An object's path lists its containers from the root down. Tables are stored in the order of that
path, so what a container holds is one range of it and a filter that reaches the files; and the
containers of an object are the prefixes of its path, so the grants that hold for it are found by
equal keys, for the objects one asks about. Nothing is written for pairs of container and content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators.access import GRANT_KEY
from tarn.operators.merge import keep_latest, without_keys
from tarn.session import cut_lineage

SEPARATOR = "/"


def _step(name: str) -> Column:
    """An id as one step of a path: the separator and what sorts before it are written as codes."""
    text = F.col(name).cast("string")
    return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit(SEPARATOR), F.lit("%2F"))


def object_paths(parents: DataFrame) -> DataFrame:
    """``object_id, path`` of all objects and containers of ``object_id, parent_id`` rows, in path order.

    A container without a row of its own, or with a NULL parent, is a root. An object has one
    container; of several the least counts. Objects on a containment cycle, and below one, hang
    from nowhere: their path is their own id. One round for each level of containers.
    """
    rows = parents.where("object_id IS NOT NULL").groupBy("object_id").agg(F.min("parent_id").alias("parent_id"))
    holders = parents.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("_holder")).distinct()
    rows = cut_lineage(
        rows.join(holders, F.col("object_id") == F.col("_holder"), "full_outer")
        .select(F.coalesce("object_id", "_holder").alias("object_id"), "parent_id", F.col("_holder").isNotNull().alias("_holds"))
        .withColumn("_step", _step("object_id"))
    )
    # Rounds walk the containers alone; what holds nothing is placed once, below them.
    inner = rows.where("_holds").drop("_holds")
    level = cut_lineage(inner.where("parent_id IS NULL").select("object_id", F.col("_step").alias("path")))
    found = level
    while True:
        level = cut_lineage(inner.join(_above(level), "parent_id").select("object_id", _below().alias("path")))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    adrift = without_keys(inner, found, "object_id").select("object_id", F.col("_step").alias("path"))
    leaves = rows.where("NOT _holds").join(_above(found), "parent_id", "left").select("object_id", _below().alias("path"))
    return in_path_order(found.unionByName(adrift).unionByName(leaves))


def _above(held: DataFrame) -> DataFrame:
    return held.select(F.col("object_id").alias("parent_id"), F.col("path").alias("_above"))


def _below() -> Column:
    """The path below a container's, or the step alone where there is none."""
    return F.concat_ws(SEPARATOR, "_above", "_step")


def in_path_order(rows: DataFrame) -> DataFrame:
    """Rows written in ranges of ``path``, so that files cover few paths and a range filter skips the others.

    They are written before, too: the ranges come from a sample, which would make the rows twice.
    """
    return cut_lineage(cut_lineage(rows).repartitionByRange("path").sortWithinPartitions("path"))


def under(rows: DataFrame, path: str) -> DataFrame:
    """Rows whose ``path`` is below a container's: one range, the container itself left out."""
    after = chr(ord(SEPARATOR) + 1)
    return rows.where((F.col("path") > path + SEPARATOR) & (F.col("path") < path + after))


def prefixes(path: str = "path") -> Column:
    """The paths of an object and of all its containers, the object's own first."""
    steps = F.split(path, SEPARATOR)
    lengths = F.reverse(F.sequence(F.lit(1), F.size(steps)))
    return F.transform(lengths, lambda n: F.array_join(F.slice(steps, F.lit(1), n), SEPARATOR))


def container(path: str) -> Column:
    """The path of an object's container, NULL for a root."""
    last = F.length(F.substring_index(path, SEPARATOR, -1))
    return F.when(F.contains(F.col(path), F.lit(SEPARATOR)), F.substring(F.col(path), F.lit(1), F.length(path) - last - 1))


def grants_by_path(acl: DataFrame, paths: DataFrame) -> DataFrame:
    """``acl`` with the ``path`` of the object it is granted on, in path order; objects without a path are their own."""
    at = paths.select(F.col("object_id").alias("_object"), "path")
    joined = acl.join(at, F.col("source_object_id") == F.col("_object"), "left").drop("_object")
    return in_path_order(joined.withColumn("path", F.coalesce("path", _step("source_object_id"))))


def effective_grants(asked: DataFrame, paths: DataFrame, grants: DataFrame) -> DataFrame:
    """The grants that hold for the ``object_id`` values asked about, own and inherited.

    ``grants`` is the table of ``grants_by_path``; the result has its columns without ``path``. A
    grant on the object wins over an inherited one of the same key, of several inherited ones the
    latest does. ``granted_via`` names the container.
    """
    wanted = asked.select("object_id").distinct()
    # An object that no container holds still has its own grants.
    placed = wanted.join(paths, "object_id", "left").withColumn("path", F.coalesce("path", _step("object_id")))
    placed = cut_lineage(placed.withColumn("_container", container("path")))
    columns = [c for c in grants.columns if c != "path"]
    own = cut_lineage(placed.select("path").join(grants, "path").select(*columns))
    # All that one container holds inherits the same, so the latest are found once for each container.
    containers = placed.select("_container").where("_container IS NOT NULL").distinct()
    reached = containers.select("_container", F.explode(prefixes("_container")).alias("path")).join(grants, "path")
    passed = (
        reached.withColumn("grant_type", F.lit("inherited"))
        .withColumn("granted_via", F.col("source_object_id")).select("_container", *[c for c in columns if c != "source_object_id"])
    )
    once = keep_latest(passed, ["_container", *[c for c in GRANT_KEY if c != "source_object_id"]], ["extracted_at"])
    inherited = placed.select("_container", F.col("object_id").alias("source_object_id")).join(once, "_container").select(*columns)
    return own.unionByName(without_keys(inherited, own, GRANT_KEY))
