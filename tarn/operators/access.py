"""Access lists: normalised grants, nested groups, inheritance, stamping and filtering."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.ids import uuid5
from tarn.operators.merge import keep_latest, table_diff, without_keys
from tarn.session import cut_lineage

# Identity of an object, a principal and a grant.
OBJECT_KEY = ["source_system", "connection_id", "object_type", "object_id"]
PRINCIPAL_KEY = ["source_system", "connection_id", "principal_type", "principal_id"]
GRANT_KEY = ["source_object_id", "principal_id", "access_level", "effect"]


def normalize_acl(grants: DataFrame) -> dict[str, DataFrame]:
    """Flat grant rows into ``objects``, ``principals`` and ``acl`` tables.

    A grant row carries the object, the principal, the level and ``effect`` (allow or
    deny; allow when the column is missing). The latest extraction of each key stays.
    """
    if "effect" not in grants.columns:
        grants = grants.withColumn("effect", F.lit("allow"))
    # Each table is reduced on the native ids; the (longer) uuids are made afterwards.
    objects = grants.select(*OBJECT_KEY, "object_name", "extracted_at")
    principals = grants.select(
        *PRINCIPAL_KEY, "principal_name", F.lower(F.trim("email")).alias("email"), "extracted_at"
    )
    acl = grants.select(
        *dict.fromkeys([*OBJECT_KEY, *PRINCIPAL_KEY]),
        "access_level", "effect", "grant_type", "granted_via", "extracted_at",
    )
    object_id, principal_id = uuid5(F.concat_ws("|", *OBJECT_KEY)), uuid5(F.concat_ws("|", *PRINCIPAL_KEY))
    acl_key = [*dict.fromkeys([*OBJECT_KEY, *PRINCIPAL_KEY]), "access_level", "effect"]
    return {
        "objects": keep_latest(objects, OBJECT_KEY, "extracted_at").select(
            object_id.alias("id"), *objects.columns
        ),
        "principals": keep_latest(principals, PRINCIPAL_KEY, "extracted_at").select(
            principal_id.alias("id"), *[c for c in principals.columns if c != "extracted_at"]
        ),
        "acl": keep_latest(acl, acl_key, "extracted_at").select(
            object_id.alias("source_object_id"),
            principal_id.alias("principal_id"),
            "access_level", "effect", "grant_type", "granted_via", "extracted_at",
        ),
    }


def closure(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """All (ancestor, descendant) pairs of a directed graph; safe on cycles.

    Each round extends only the pairs found in the last one and drops known pairs, so
    the work is the size of the answer. Rounds are written to the shared folder.
    """
    step = cut_lineage(
        edges.select(F.col(parent).alias("_parent"), F.col(child).alias("_child"))
        .where("_parent IS NOT NULL AND _child IS NOT NULL AND _parent <> _child")
        .distinct()
    )
    rounds = [step]
    while True:
        frontier = rounds[-1].select(F.col("_parent").alias(parent), F.col("_child").alias("_via"))
        reached = (
            frontier.join(step, F.col("_via") == F.col("_parent"))
            .select(F.col(parent).alias("_parent"), "_child")
            .where("_parent <> _child")
            .distinct()
        )
        known = reduce(DataFrame.unionByName, rounds)
        fresh = cut_lineage(without_keys(reached, known, ["_parent", "_child"]))
        if fresh.isEmpty():
            return known.select(F.col("_parent").alias(parent), F.col("_child").alias(child))
        rounds.append(fresh)


def expand_membership(membership: DataFrame) -> DataFrame:
    """Direct and nested members of every group."""
    return closure(membership, "group_id", "member_principal_id")


def principals_of(
    membership: DataFrame, principals: DataFrame, email: str
) -> DataFrame:
    """The requester's own principals and every group above them, found upwards."""
    own = principals.where(F.col("email") == email.strip().lower()).select(
        F.col("id").alias("principal_id")
    )
    found = [cut_lineage(own.distinct())]
    while True:
        up = found[-1].join(
            membership, F.col("principal_id") == F.col("member_principal_id")
        ).select(F.col("group_id").alias("principal_id"))
        known = reduce(DataFrame.unionByName, found)
        fresh = cut_lineage(without_keys(up.distinct(), known, "principal_id"))
        if fresh.isEmpty():
            return known
        found.append(fresh)


def inherit_acl(acl: DataFrame, parents: DataFrame) -> DataFrame:
    """Grants of a container also hold for what it contains, at any depth.

    ``parents`` has ``object_id`` and ``parent_id``. A grant made on the object itself
    wins over an inherited one with the same key.
    """
    above = closure(parents, "parent_id", "object_id")
    passed = (
        acl.join(above, F.col("source_object_id") == F.col("parent_id"))
        .withColumn("grant_type", F.lit("inherited"))
        .withColumn("granted_via", F.col("parent_id"))
        .withColumn("source_object_id", F.col("object_id"))
        .select(*acl.columns)
    )
    once = keep_latest(passed, GRANT_KEY, ["extracted_at"])
    return acl.unionByName(without_keys(once, acl, GRANT_KEY))


def resolve_emails(acl: DataFrame, principals: DataFrame, members: DataFrame) -> DataFrame:
    """Grants per person: direct ones, and those of the groups they belong to."""
    grants = acl.select("source_object_id", "principal_id", "access_level", "effect")
    through = grants.join(members, F.col("principal_id") == F.col("group_id")).select(
        "source_object_id", F.col("member_principal_id").alias("principal_id"),
        "access_level", "effect",
    )
    people = principals.where("email IS NOT NULL").select(F.col("id").alias("_person"), "email")
    return (
        grants.unionByName(through)
        .join(people, F.col("principal_id") == F.col("_person"))
        .select("source_object_id", "email", "access_level", "effect")
        .distinct()
    )


def apply_acl(
    df: DataFrame, object_col: str, acl: DataFrame, principal: str = "principal_id"
) -> DataFrame:
    """Stamp ``acl_allow`` / ``acl_deny`` on rows, whole for every object.

    Principals stay as granted: groups are not expanded, which keeps the arrays short.
    Equal grants fall together in the map tasks. Where objects have more grants than one
    cell should hold, filter and count by the grant table instead (``visible_by_grants``,
    ``grant_counts``).
    """

    def names(kept):
        return F.sort_array(F.collect_set(F.when(kept, F.col("_principal"))))

    deny = F.col("effect") == "deny"
    lists = (
        acl.select(F.col("source_object_id").alias("_object"), F.col(principal).alias("_principal"), deny.alias("_deny"))
        .groupBy("_object")
        .agg(names(~F.col("_deny")).alias("acl_allow"), names(F.col("_deny")).alias("acl_deny"))
    )
    empty = F.array().cast("array<string>")
    return (
        df.join(lists, F.col(object_col) == F.col("_object"), "left")
        .withColumn("acl_allow", F.coalesce("acl_allow", empty))
        .withColumn("acl_deny", F.coalesce("acl_deny", empty))
        .drop("_object")
    )


def grant_counts(acl: DataFrame, principal: str = "principal_id") -> DataFrame:
    """``source_object_id, n_allow, n_deny``: the principals of each object, counted over rows.

    Equal grants fall together by object and principal, then every map task counts its own, so
    an object with any number of grants is never one group of rows or one cell.
    """
    deny = F.col("effect") == "deny"
    once = acl.select("source_object_id", F.col(principal).alias("_principal"), deny.alias("_deny")).where("_principal IS NOT NULL").distinct()
    return once.groupBy("source_object_id").agg(F.count_if(~F.col("_deny")).alias("n_allow"), F.count_if("_deny").alias("n_deny"))


def visible_by_grants(
    df: DataFrame, object_col: str, acl: DataFrame, requester: DataFrame, default: str = "private"
) -> DataFrame:
    """Rows a requester may see, straight from the grant table; a deny wins.

    ``requester`` lists their ``principal_id`` values (see ``principals_of``). Rows
    without any grant are hidden unless ``default="public"``.
    """
    mine = acl.join(requester, "principal_id", "left_semi")
    allowed = mine.where("effect <> 'deny'").select(F.col("source_object_id").alias(object_col))
    denied = mine.where("effect = 'deny'").select(F.col("source_object_id").alias(object_col))
    seen = df.join(allowed, object_col, "left_semi")
    if default == "public":
        granted = acl.select(F.col("source_object_id").alias(object_col))
        seen = seen.unionByName(df.join(granted, object_col, "left_anti"))
    return seen.join(denied, object_col, "left_anti")


def visible_to(stamped: DataFrame, principals: Sequence[str], default: str = "private") -> DataFrame:
    """Filter stamped rows for one requester's principals; a deny wins."""
    mine = F.array(*[F.lit(p) for p in principals])
    allowed = F.arrays_overlap("acl_allow", mine)
    if default == "public":
        allowed = allowed | ((F.size("acl_allow") == 0) & (F.size("acl_deny") == 0))
    return stamped.where(allowed & ~F.arrays_overlap("acl_deny", mine))


def acl_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Grants ``added`` or ``revoked`` between two extractions."""
    changes = table_diff(old, new, GRANT_KEY, compare=GRANT_KEY)
    return changes.withColumn(
        "change", F.when(F.col("diff") == "only_right", "added").otherwise("revoked")
    ).drop("diff")
