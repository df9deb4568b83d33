"""Nested groups without all pairs: cycles condensed, members as intervals of numbers.

Groups that contain each other are one component. The components form a directed graph without
cycles; one parent of each makes a tree whose nodes are numbered so that the members of a group
are an interval. What reaches a group by another way than the tree is an exception: an interval
more, handed up to the groups above that do not already cover it. The labels are one row per
principal and one per exception; who belongs to whom is answered for the groups one asks about.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.intervals import points_in_ranges, tree_intervals
from tarn.operators.merge import without_keys
from tarn.session import cut_lineage, tasks_for


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges on cycles or between them: those whose source is a target and whose target is a source, over and over."""
    while True:
        sources, targets = edges.select(F.col("a").alias("b")).distinct(), edges.select(F.col("b").alias("a")).distinct()
        inner = cut_lineage(edges.join(sources, "b", "left_semi").join(targets, "a", "left_semi"))
        before, after = edges.count(), inner.count()
        edges = inner
        if after in (0, before):
            return edges


def _largest_reaching(edges: DataFrame) -> DataFrame:
    """``node, colour``: the largest node that reaches it, itself included; a round for each step of the longest such way."""
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    colours = cut_lineage(nodes.withColumn("colour", F.col("node")))
    fresh = colours
    while True:
        sent = edges.join(fresh, edges["a"] == fresh["node"]).groupBy("b").agg(F.max("colour").alias("_sent"))
        joined = colours.join(sent, colours["node"] == sent["b"], "left")
        after = cut_lineage(joined.select(
            "node", F.greatest("colour", "_sent").alias("colour"), (F.col("_sent") > F.col("colour")).alias("_moved")
        ))
        colours, fresh = after.select("node", "colour"), after.where("_moved").select("node", "colour")
        if fresh.isEmpty():
            return colours


def _reaching_root(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """``node, component``: nodes that reach the node of their colour within the colour."""
    a = colours.select(F.col("node").alias("a"), F.col("colour").alias("_a"))
    b = colours.select(F.col("node").alias("b"), F.col("colour").alias("_b"))
    same = cut_lineage(edges.join(a, "a").join(b, "b").where("_a = _b").select("a", "b", F.col("_a").alias("component")))
    found = cut_lineage(colours.where("node = colour").select("node", F.col("colour").alias("component")))
    fresh = found
    while True:
        up = same.join(fresh.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node"), "component").distinct()
        fresh = cut_lineage(without_keys(up, found, "node"))
        if fresh.isEmpty():
            return found
        found = cut_lineage(found.unionByName(fresh))


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of the nodes on cycles of the directed pairs ``a, b``; all other nodes are alone.

    Each pass trims what no cycle holds, colours what is left by the largest node that reaches it,
    and takes the nodes that reach back. Every pass finds at least one component for each colour.
    """
    left = _trimmed(cut_lineage(edges.where("a <> b").select("a", "b").distinct()))
    found = None
    while not left.isEmpty():
        part = _reaching_root(left, _largest_reaching(left))
        found = part if found is None else found.unionByName(part)
        gone = part.select("node")
        rest = left.join(gone, left["a"] == gone["node"], "left_anti").join(gone, left["b"] == gone["node"], "left_anti")
        left = _trimmed(cut_lineage(rest))
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("a").alias("component")).where("false")


@dataclass(frozen=True)
class MembershipLabels:
    """``principals``: node, component, number. ``intervals``: component, low, high. ``count``: numbers in use."""

    principals: DataFrame
    intervals: DataFrame
    count: int

    def members_of(self, groups: DataFrame) -> DataFrame:
        """``group_id, member_principal_id`` for the ``group_id`` values asked about, direct and nested.

        Members of a cycle are members of each other; nobody is listed as a member of itself.
        """
        # Written, so that the few groups asked about are sent to the labels and not the other way.
        asked = cut_lineage(groups.select(F.col("group_id")).distinct())
        of = self.principals.select(F.col("node").alias("group_id"), "component")
        placed = cut_lineage(asked.join(of, "group_id"))
        # A component alone in its interval has no members but those of its cycle.
        ranges = cut_lineage(placed.join(self.intervals, "component").select("group_id", "low", "high"))
        points = self.principals.select(F.col("node").alias("member_principal_id"), "number")
        found = points_in_ranges(points, ranges, "number", "low", "high", self.count, dense=True)
        pairs = found.where("group_id <> member_principal_id").select("group_id", "member_principal_id")
        # Intervals of a group may lie in each other; as many tasks as the pairs need tell copies apart.
        most = ranges.agg(F.sum(F.col("high") - F.col("low"))).first()[0]
        return pairs.repartition(tasks_for(most), "group_id", "member_principal_id").distinct()

    def is_member(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (group_id, member_principal_id) with ``is_member``; unknown ids are no members."""
        groups = self.principals.select(F.col("node").alias("group_id"), F.col("component").alias("_component"))
        members = self.principals.select(F.col("node").alias("member_principal_id"), F.col("number").alias("_number"))
        placed = pairs.join(groups, "group_id", "left").join(members, "member_principal_id", "left")
        asked = placed.select("group_id", "member_principal_id", "_component", "_number").distinct()
        inside = (F.col("_number") >= F.col("low")) & (F.col("_number") < F.col("high"))
        held = (
            asked.where("group_id <> member_principal_id")
            .join(self.intervals, (F.col("_component") == F.col("component")) & inside, "left_semi")
            .select("group_id", "member_principal_id", F.lit(True).alias("is_member"))
        )
        return pairs.join(held, ["group_id", "member_principal_id"], "left").withColumn("is_member", F.coalesce("is_member", F.lit(False)))


def membership_labels(membership: DataFrame) -> MembershipLabels:
    """Labels of ``group_id, member_principal_id`` rows; NULL ends and self-membership are left out.

    Rows are read up from members: an edge leads from a member to its group. Rounds follow the
    depth of the nesting and the length of cycles, not the number of principals.
    """
    up = cut_lineage(
        membership.select(F.col("member_principal_id").alias("a"), F.col("group_id").alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    )
    # Only groups can be on a cycle: principals that hold nobody are not looked at.
    groups = cut_lineage(up.select(F.col("b").alias("a")).distinct())
    nested = cut_lineage(up.join(groups, "a", "left_semi"))
    cycles = cut_lineage(strong_components(nested))
    cyclic = not cycles.isEmpty()
    edges, inner = (_condensed(pairs, cycles if cyclic else None) for pairs in (up, nested))
    holders = groups.select(F.col("a").alias("node"))
    if cyclic:
        holders = holders.join(cycles, "node", "left").select(F.coalesce("component", "node").alias("node")).distinct()
    tops = without_keys(holders, inner.select(F.col("child").alias("node")), "node").withColumn("parent", F.lit(None).cast("string"))
    tree = edges.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("parent"))
    intervals = cut_lineage(tree_intervals(tree.unionByName(tops)))
    own = intervals.select(F.col("node").alias("component"), "low", "high")
    extra = _exceptions(edges, inner, holders, intervals)
    principals = intervals.select("node", F.col("node").alias("component"), F.col("low").alias("number"))
    if cyclic:
        alone = without_keys(principals, cycles, "node")
        numbers = principals.select("component", "number")
        principals = cut_lineage(alone.unionByName(cycles.join(numbers, "component").select("node", "component", "number")))
    return MembershipLabels(principals, own if extra is None else own.unionByName(extra), max(1, intervals.count()))


def _condensed(pairs: DataFrame, cycles: DataFrame | None) -> DataFrame:
    """``child, parent``: the distinct pairs ``a, b`` between components."""
    if cycles is None:
        return pairs.select(F.col("a").alias("child"), F.col("b").alias("parent"))
    for end in ("a", "b"):
        pairs = pairs.join(cycles.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")), end, "left")
    between = pairs.select(
        F.coalesce("_a", "a").alias("child"), F.coalesce("_b", "b").alias("parent"), F.coalesce("_a", "_b").isNotNull().alias("_moved")
    ).where("child <> parent")
    # Only pairs with an end on a cycle can fall together.
    moved = between.where("_moved").select("child", "parent").distinct()
    return cut_lineage(between.where("NOT _moved").select("child", "parent").unionByName(moved))


def _exceptions(edges: DataFrame, inner: DataFrame, holders: DataFrame, intervals: DataFrame) -> DataFrame | None:
    """``component, low, high`` that a component has besides its own interval, by rounds up the edges.

    Rounds know components by the number their interval starts with, and walk the ``inner`` edges
    alone: those whose child holds somebody.
    """
    at = intervals.select(F.col("node").alias("child"), F.col("parent").alias("_tree"), "low", "high")
    own = cut_lineage(intervals.join(holders, "node", "left_semi").select("node", F.col("low").alias("_low"), F.col("high").alias("_high")))
    uncovered = "low < _low OR high > _high"
    first = edges.join(own, F.col("parent") == F.col("node")).join(at, "child").where("_tree IS NULL OR parent <> _tree")
    # An interval and its number belong to one child, so these rows are distinct as the edges are.
    fresh = cut_lineage(first.where(uncovered).select(F.col("_low").alias("of"), "low", "high"))
    if fresh.isEmpty():
        return None
    starts = own.select(F.col("node").alias("child"), F.col("_low").alias("of"))
    steps = cut_lineage(inner.join(starts, "child").join(own, F.col("parent") == F.col("node")).select("of", "_low", "_high"))
    found = fresh
    while True:
        handed = steps.join(fresh, "of").where(uncovered).select(F.col("_low").alias("of"), "low", "high").distinct()
        fresh = cut_lineage(without_keys(handed, found, ["of", "low", "high"]))
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh)
    return found.join(own, F.col("of") == F.col("_low")).select(F.col("node").alias("component"), "low", "high")
