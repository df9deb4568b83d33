"""Access lists at scale: membership by labels, inheritance by paths, stamps as bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import access, bitmaps, containment
from tarn.operators.membership import membership_labels
from tarn.queries.checks import MEMBERS, VISIBLE, membership, simple_acl
from tarn.queries.registry import query, table


@query(f"SELECT * FROM ({MEMBERS}) WHERE group_id IN ('all', 'r0', 'n3', 'n7')")
def acl_members_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Members of four groups, two of which contain each other, out of interval labels."""
    asked = spark.createDataFrame([("all",), ("r0",), ("n3",), ("n7",), ("nobody",)], "group_id string")
    return membership_labels(membership(spark, d)).members_of(asked)


TEAMS = """
WITH RECURSIVE edges AS (
  SELECT 's' || l_suppkey AS g, 'p' || l_partkey AS m FROM lineitem GROUP BY ALL
  UNION SELECT 'z' || (s_suppkey % 7), 's' || s_suppkey FROM supplier
  UNION SELECT 'z' || (s_suppkey % 5), 's' || s_suppkey FROM supplier
  UNION SELECT 'z' || ((k + 3) % 7), 'z' || k FROM range(3, 7) t(k)
  UNION SELECT 's' || min(s_suppkey), 's' || max(s_suppkey) FROM supplier
), reach AS (
  SELECT g, m FROM edges WHERE g IN ('z0', 'z4', 'z6')
  UNION SELECT r.g, e.m FROM reach r JOIN edges e ON r.m = e.g
) SELECT g AS group_id, count(*) AS n_members FROM reach WHERE g <> m GROUP BY g
"""


def teams(spark: SparkSession, d: str) -> DataFrame:
    """Parts in several suppliers, suppliers in several zones, zones in each other and back: many ways to one group."""
    parts = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey"))
    key = F.col("s_suppkey")
    suppliers = table(spark, d, "supplier")

    def zone(of):
        return F.concat(F.lit("z"), of.cast("string"))

    zones = spark.range(3, 7).select(zone((F.col("id") + 3) % 7), zone(F.col("id")))
    edge = suppliers.agg(F.concat(F.lit("s"), F.min(key)), F.concat(F.lit("s"), F.max(key)))
    rows = parts
    for more in (suppliers.select(zone(key % 7), F.concat(F.lit("s"), key)), suppliers.select(zone(key % 5), F.concat(F.lit("s"), key)), zones, edge):
        rows = rows.union(more)
    return rows.toDF("group_id", "member_principal_id")


@query(TEAMS)
def acl_member_counts(spark: SparkSession, d: str) -> DataFrame:
    """Members of zones that are reached by many ways, each counted once."""
    asked = spark.createDataFrame([("z0",), ("z4",), ("z6",)], "group_id string")
    members = membership_labels(teams(spark, d)).members_of(asked)
    return members.groupBy("group_id").agg(F.count("*").alias("n_members"))


@query("""
SELECT 'u' || c_custkey AS member_principal_id, n_regionkey = 1 AS is_member
FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def acl_is_member(spark: SparkSession, d: str) -> DataFrame:
    """Whether each customer is in region 1, through its nation; the company that regions contain is left out."""
    rows = membership(spark, d).where("member_principal_id <> 'all'")
    pairs = table(spark, d, "customer").select(F.lit("r1").alias("group_id"), F.concat(F.lit("u"), "c_custkey").alias("member_principal_id"))
    return membership_labels(rows).is_member(pairs).select("member_principal_id", "is_member")


def containers(spark: SparkSession, d: str) -> DataFrame:
    """Lines in orders, orders in customers, customers in nations."""
    lines = table(spark, d, "lineitem").select(
        F.concat(F.lit("l"), "l_orderkey", F.lit("-"), "l_linenumber").alias("object_id"), F.concat(F.lit("o"), "l_orderkey").alias("parent_id")
    )
    orders = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("u"), "o_custkey"))
    customers = table(spark, d, "customer").select(F.concat(F.lit("u"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"))
    return lines.union(orders).union(customers)


def container_grants(spark: SparkSession, d: str) -> DataFrame:
    """The grants on orders, and on every nation one to its region's team."""
    nations = table(spark, d, "nation").select(
        F.concat(F.lit("n"), "n_nationkey").alias("source_object_id"), F.concat(F.lit("r"), "n_regionkey").alias("principal_id"),
        F.lit("read").alias("access_level"), F.lit("allow").alias("effect"), F.lit("direct").alias("grant_type"),
        F.lit(None).cast("string").alias("granted_via"), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz").alias("extracted_at"),
    )
    return simple_acl(spark, d).unionByName(nations)


@query("""
WITH asked AS (
  SELECT DISTINCT 'l' || l_orderkey || '-' || l_linenumber AS o, o_orderkey, o_custkey, o_orderpriority, o_orderstatus, c_nationkey, n_regionkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE l_returnflag = 'R')
SELECT o AS source_object_id, 'u' || o_custkey AS principal_id, 'owner' AS access_level, 'allow' AS effect, 'o' || o_orderkey AS granted_via FROM asked
UNION ALL SELECT o, 'n' || c_nationkey, 'read', 'allow', 'o' || o_orderkey FROM asked WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT o, 'u' || o_custkey, 'owner', 'deny', 'o' || o_orderkey FROM asked WHERE o_orderstatus = 'P'
UNION ALL SELECT o, 'r' || n_regionkey, 'read', 'allow', 'n' || c_nationkey FROM asked
""")
def acl_inherited_by_path(spark: SparkSession, d: str) -> DataFrame:
    """What holds for returned lines: grants of their order and, three containers up, of their nation."""
    paths = containment.object_paths(containers(spark, d))
    held = containment.grants_by_path(container_grants(spark, d), paths)
    asked = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(
        F.concat(F.lit("l"), "l_orderkey", F.lit("-"), "l_linenumber").alias("object_id")
    )
    found = containment.effective_grants(asked, paths, held)
    return found.select("source_object_id", "principal_id", "access_level", "effect", "granted_via")


@query("""
SELECT 'u' || c_custkey AS object_id FROM customer WHERE c_nationkey = 7
UNION ALL SELECT 'o' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7
UNION ALL SELECT DISTINCT 'l' || l_orderkey || '-' || l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7
""")
def acl_objects_under(spark: SparkSession, d: str) -> DataFrame:
    """All a container holds, at any depth, as one range of paths."""
    return containment.under(containment.object_paths(containers(spark, d)), "n7").select("object_id")


def order_stamps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    acl = simple_acl(spark, d)
    numbers = bitmaps.number_principals(acl, "principal_id")
    return bitmaps.bitmap_stamps(acl, numbers), numbers


@query(VISIBLE)
def acl_visible_by_bitmaps(spark: SparkSession, d: str) -> DataFrame:
    """What one user sees, by masks over bitmaps; a deny wins."""
    stamps, numbers = order_stamps(spark, d)
    people = table(spark, d, "customer").select(
        F.concat(F.lit("u"), "c_custkey").alias("id"), F.concat(F.lit("user"), "c_custkey", F.lit("@mail.test")).alias("email")
    )
    requester = access.principals_of(membership(spark, d), people, "user7@mail.test")
    orders = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("object"), "o_orderstatus")
    return bitmaps.visible_by_bitmaps(orders, "object", stamps, requester, numbers)


@query("""
SELECT 'o' || o_orderkey AS source_object_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END::BIGINT AS n_allow,
       CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END::BIGINT AS n_deny,
       (CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END - CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS n_granted
FROM orders JOIN customer ON o_custkey = c_custkey
""")
def acl_bitmap_counts(spark: SparkSession, d: str) -> DataFrame:
    """Allowed, denied and remaining principals of each order, by bit counts."""
    return bitmaps.stamp_counts(order_stamps(spark, d)[0])


@query("""
SELECT 'all' AS source_object_id, count(*) AS n_allow, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_deny,
       count(*) FILTER (WHERE o_orderstatus <> 'P') AS n_granted, true AS rows_bounded FROM orders
""")
def acl_bitmap_hot_object(spark: SparkSession, d: str) -> DataFrame:
    """One object with a grant for every order and many denials: a row for each 64 principals."""
    orders = table(spark, d, "orders")
    who = F.concat(F.lit("p"), "o_orderkey").alias("principal_id")

    def rows(frame: DataFrame, effect: str) -> DataFrame:
        return frame.select(F.lit("all").alias("source_object_id"), who, F.lit(effect).alias("effect"))

    allow, deny = rows(orders, "allow"), rows(orders.where("o_orderstatus = 'P'"), "deny")
    numbers = bitmaps.number_principals(allow, "principal_id")
    stamps = bitmaps.merged_stamps(bitmaps.bitmap_stamps(allow, numbers), bitmaps.bitmap_stamps(deny, numbers))
    size = stamps.groupBy("source_object_id").agg(F.count("*").alias("_rows"), F.max("word").alias("_last"))
    counts = bitmaps.stamp_counts(stamps).join(size, "source_object_id")
    return counts.select("source_object_id", "n_allow", "n_deny", "n_granted", (F.col("_rows") == F.col("_last") + 1).alias("rows_bounded"))
