"""Quality gate and access lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.identity import CPF_WEIGHTS, check_digit, digits_of
from tarn.operators import access, quality
from tarn.queries.registry import new_lake, query, table, uuid5_sql

# --- quality ------------------------------------------------------------------------

CONFIG = [
    {"check": "not_null", "args": ["email"]},
    {"check": "range", "args": ["balance", 0, 9000]},
    {"check": "email", "args": ["email"]},
    {"check": "cpf", "args": ["cpf"]},
    {"check": "enum", "args": ["segment", ["BUILDING", "MACHINERY", "FURNITURE", "HOUSEHOLD"]]},
    {"check": "regex", "args": ["name", "^Customer#[0-9]+$"]},
    {"check": "length", "args": ["name", 1, 18]},
    {"check": "type", "args": ["age", "int"]},
    {"check": "freshness", "args": ["seen_on", "2000-01-10"]},
    {"check": "unique", "args": ["email"]},
    {"check": "reference", "args": ["nation_id", "nation", "n_nationkey"]},
]


def staged_people(spark: SparkSession, d: str) -> DataFrame:
    """Customers with a made-up tax number, and faults that follow from their data."""
    number = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    customers = table(spark, d, "customer").withColumn("cpf", digits_of(number))
    for weights in CPF_WEIGHTS:
        customers = customers.withColumn("cpf", F.concat("cpf", F.array(check_digit(F.col("cpf"), weights))))
    segment = F.col("c_mktsegment")
    mail = F.concat(F.lit("user"), "c_custkey", F.lit("@mail.test"))
    return customers.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") < -900, F.lit(None))
        .when(segment == "MACHINERY", F.lit("sales@mail.test"))
        .when(F.col("c_nationkey") == 3, F.concat(F.lit("user"), "c_custkey"))
        .otherwise(mail).alias("email"),
        F.when(F.col("c_nationkey") == 7, F.lit("111.111.111-11")).otherwise(F.array_join("cpf", "")).alias("cpf"),
        F.col("c_acctbal").alias("balance"),
        segment.alias("segment"),
        F.when(F.col("c_nationkey") == 9, F.lit("???")).otherwise(F.col("c_name")).alias("name"),
        F.when(F.col("c_nationkey") == 11, F.lit("n/a")).otherwise(F.lit("42")).alias("age"),
        F.date_add(F.lit("2000-01-01").cast("date"), F.col("c_nationkey")).cast("string").alias("seen_on"),
        F.when(segment == "FURNITURE", F.col("c_nationkey") + 20).otherwise(F.col("c_nationkey")).alias("nation_id"),
    )


_EMAIL = """CASE WHEN c_acctbal < -900 THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN 'sales@mail.test'
  WHEN c_nationkey = 3 THEN 'user' || c_custkey ELSE 'user' || c_custkey || '@mail.test' END"""
FLAGGED = f"""
SELECT id, concat_ws(',',
  CASE WHEN email IS NULL THEN 'not_null:email' END,
  CASE WHEN c_acctbal NOT BETWEEN 0 AND 9000 THEN 'range:balance' END,
  CASE WHEN email NOT LIKE '%@%' THEN 'email:email' END,
  CASE WHEN c_nationkey = 7 OR id = 0 THEN 'cpf:cpf' END,
  CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'enum:segment' END,
  CASE WHEN c_nationkey = 9 THEN 'regex:name' END,
  CASE WHEN c_nationkey = 11 THEN 'type:age' END,
  CASE WHEN c_nationkey < 9 THEN 'freshness:seen_on' END,
  CASE WHEN n_same > 1 THEN 'unique:email' END,
  CASE WHEN c_mktsegment = 'FURNITURE' AND c_nationkey + 20 > 24 THEN 'reference:nation_id' END) AS reasons
FROM (SELECT c_custkey AS id, *, {_EMAIL} AS email, count({_EMAIL}) OVER (PARTITION BY {_EMAIL}) AS n_same FROM customer)
"""


def flagged_people(spark: SparkSession, d: str) -> DataFrame:
    suite = quality.suite_from_config(CONFIG, {"nation": table(spark, d, "nation")})
    return quality.flag(staged_people(spark, d), suite)


@query(FLAGGED)
def dq_checks(spark: SparkSession, d: str) -> DataFrame:
    return flagged_people(spark, d).select("id", F.array_join("reasons", ",").alias("reasons"))


@query(f"""
SELECT 'passed' AS outcome, count(*) AS n_rows FROM ({FLAGGED}) WHERE reasons = ''
UNION ALL SELECT 'quarantined', count(*) FROM ({FLAGGED}) WHERE reasons <> ''
""")
def dq_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Staging -> raw or quarantine."""
    lake = new_lake(spark)
    suite = quality.suite_from_config(CONFIG, {"nation": table(spark, d, "nation")})
    quality.gate_into(lake, "people", staged_people(spark, d), suite, mode="overwrite")
    passed = lake.read("raw/people").agg(F.count("*").alias("n_rows"))
    held = lake.read("state/people__quarantine").agg(F.count("*").alias("n_rows"))
    return passed.withColumn("outcome", F.lit("passed")).unionByName(
        held.withColumn("outcome", F.lit("quarantined"))
    )


@query(f"""
SELECT check_name, count(*) AS failed_rows FROM (
  SELECT unnest(string_split(reasons, ',')) AS check_name FROM ({FLAGGED}) WHERE reasons <> '')
GROUP BY check_name
""")
def dq_report(spark: SparkSession, d: str) -> DataFrame:
    return quality.gate_report(quality.split_flagged(flagged_people(spark, d))[1])


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("email", F.concat(F.lit("u"), "o_custkey", F.lit("@x.com")))
    faults = {
        "email": (F.lit("not an address"), 7),
        "o_totalprice": (F.lit(None).cast("double"), 11),
        "o_custkey": (-F.col("o_custkey") - 1, 13),
    }
    return quality.inject_dirty(orders, "o_orderkey", faults, seed=None)


INJECTED = """
SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 7 = 0 THEN 'email' END,
  CASE WHEN o_orderkey % 11 = 0 THEN 'o_totalprice' END,
  CASE WHEN o_orderkey % 13 = 0 THEN 'o_custkey' END) AS injected FROM orders
"""


@query(f"""
SELECT injected, count(*) AS n_rows FROM ({INJECTED}) GROUP BY injected
""")
def dirty_injection(spark: SparkSession, d: str) -> DataFrame:
    return _dirty(spark, d).groupBy(F.array_join("injected", ",").alias("injected")).agg(
        F.count("*").alias("n_rows")
    )


@query(f"""
SELECT count(*) FILTER (WHERE injected <> '') AS true_positive, CAST(0 AS BIGINT) AS false_positive,
       CAST(0 AS BIGINT) AS false_negative, count(*) FILTER (WHERE injected = '') AS true_negative,
       CAST(1 AS DOUBLE) AS recall, CAST(1 AS DOUBLE) AS precision FROM ({INJECTED})
""")
def gate_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Every injected row is caught, and no other."""
    suite = [
        quality.email_format("email"),
        quality.not_null("o_totalprice"),
        quality.references("o_custkey", table(spark, d, "customer"), "c_custkey"),
    ]
    flagged = quality.flag(_dirty(spark, d), suite)
    return quality.confusion(flagged, F.size("injected") > 0, F.size("reasons") > 0)


@query("""
SELECT count(*) FILTER (WHERE quality = 0 AND n_chars < 500) AS true_positive,
       count(*) FILTER (WHERE quality <> 0 AND n_chars < 500) AS false_positive,
       count(*) FILTER (WHERE quality = 0 AND n_chars >= 500) AS false_negative,
       count(*) FILTER (WHERE quality <> 0 AND n_chars >= 500) AS true_negative,
       count(*) FILTER (WHERE quality = 0 AND n_chars < 500) / nullif(count(*) FILTER (WHERE quality = 0), 0) AS recall,
       count(*) FILTER (WHERE quality = 0 AND n_chars < 500) / nullif(count(*) FILTER (WHERE n_chars < 500), 0) AS precision
FROM labels JOIN documents USING (doc_id)
""")
def gate_against_labels(spark: SparkSession, d: str) -> DataFrame:
    """A length check judged by human labels."""
    judged = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return quality.confusion(judged, F.col("quality") == 0, F.col("n_chars") < 500)


# --- access -------------------------------------------------------------------------


def grants(spark: SparkSession, d: str) -> DataFrame:
    """Flat grants as extracted: owners of orders, nations on urgent ones, denied pending ones."""
    orders = table(spark, d, "orders").join(
        table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )

    def rows(kind: str, principal: str, mail, level: str, effect: str, how: str, frame: DataFrame) -> DataFrame:
        return frame.select(
            F.lit("shop").alias("source_system"), F.lit("main").alias("connection_id"),
            F.lit("order").alias("object_type"), F.col("o_orderkey").cast("string").alias("object_id"),
            F.concat(F.lit("Order "), "o_orderkey").alias("object_name"),
            F.lit(kind).alias("principal_type"), F.col(principal).cast("string").alias("principal_id"),
            F.col(principal).cast("string").alias("principal_name"), mail.alias("email"),
            F.lit(level).alias("access_level"), F.lit(effect).alias("effect"),
            F.lit(how).alias("grant_type"), F.lit(None).cast("string").alias("granted_via"),
            F.col("o_orderdate").alias("extracted_at"),
        )

    mail = F.concat(F.lit("User"), "c_custkey", F.lit("@Mail.Test "))
    none = F.lit(None).cast("string")
    owner = rows("user", "c_custkey", mail, "owner", "allow", "direct", orders)
    nation = rows("group", "c_nationkey", none, "read", "allow", "group", orders.where("o_orderpriority = '1-URGENT'"))
    denied = rows("user", "c_custkey", mail, "owner", "deny", "direct", orders.where("o_orderstatus = 'P'"))
    return owner.unionByName(owner).unionByName(nation).unionByName(denied)


_OBJECT = "'shop|main|order|' || o_orderkey"
_USER = "'shop|main|user|' || c_custkey"
_GROUP = "'shop|main|group|' || c_nationkey"


@query(f"""
SELECT 'object' AS part, {uuid5_sql(_OBJECT)} AS id, 'Order ' || o_orderkey AS name FROM orders
UNION ALL SELECT DISTINCT 'principal', {uuid5_sql(_USER)}, 'user' || c_custkey || '@mail.test'
FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
UNION ALL SELECT DISTINCT 'principal', {uuid5_sql(_GROUP)}, c_nationkey::VARCHAR
FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'grant', {uuid5_sql(_OBJECT)}, 'owner/allow' FROM orders
UNION ALL SELECT 'grant', {uuid5_sql(_OBJECT)}, 'read/allow' FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'grant', {uuid5_sql(_OBJECT)}, 'owner/deny' FROM orders WHERE o_orderstatus = 'P'
""")
def acl_normalize(spark: SparkSession, d: str) -> DataFrame:
    parts = access.normalize_acl(grants(spark, d))
    frames = [
        parts["objects"].select(F.lit("object").alias("part"), "id", F.col("object_name").alias("name")),
        parts["principals"].select(
            F.lit("principal").alias("part"), "id", F.coalesce("email", "principal_name").alias("name")
        ),
        parts["acl"].select(
            F.lit("grant").alias("part"), F.col("source_object_id").alias("id"),
            F.concat_ws("/", "access_level", "effect").alias("name"),
        ),
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def membership(spark: SparkSession, d: str) -> DataFrame:
    """Customers in nations, nations in regions, regions in one company; the company in itself."""
    people = table(spark, d, "customer").select(
        F.concat(F.lit("n"), "c_nationkey").alias("group_id"),
        F.concat(F.lit("u"), "c_custkey").alias("member_principal_id"),
    )
    nations = table(spark, d, "nation").select(
        F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("n"), "n_nationkey")
    )
    regions = table(spark, d, "region").select(F.lit("all"), F.concat(F.lit("r"), "r_regionkey"))
    back = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey"), F.lit("all"))
    return people.union(nations).union(regions).union(back)


MEMBERS = """
WITH u AS (SELECT 'u' || c_custkey AS m, 'n' || c_nationkey AS n FROM customer),
n AS (SELECT 'n' || n_nationkey AS n FROM nation), r AS (SELECT 'r' || r_regionkey AS r FROM region)
SELECT n AS group_id, m AS member_principal_id FROM u
UNION ALL SELECT g, m FROM u, (SELECT r AS g FROM r UNION ALL SELECT 'all')
UNION ALL SELECT g, n FROM n, (SELECT r AS g FROM r UNION ALL SELECT 'all')
UNION ALL SELECT 'all', r FROM r UNION ALL SELECT r, 'all' FROM r
UNION ALL SELECT a.r, b.r FROM r a, r b WHERE a.r <> b.r
"""


@query(MEMBERS)
def acl_members(spark: SparkSession, d: str) -> DataFrame:
    """Nested membership over groups that contain each other."""
    return access.expand_membership(membership(spark, d))


def simple_acl(spark: SparkSession, d: str) -> DataFrame:
    """Grants with readable ids: owners, nation groups on urgent orders, denied pending ones."""
    orders = table(spark, d, "orders").join(
        table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )

    def rows(frame: DataFrame, principal, level: str, effect: str) -> DataFrame:
        return frame.select(
            F.concat(F.lit("o"), "o_orderkey").alias("source_object_id"), principal.alias("principal_id"),
            F.lit(level).alias("access_level"), F.lit(effect).alias("effect"),
            F.lit("direct").alias("grant_type"), F.lit(None).cast("string").alias("granted_via"),
            F.col("o_orderdate").alias("extracted_at"),
        )

    user, nation = F.concat(F.lit("u"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")
    return (
        rows(orders, user, "owner", "allow")
        .unionByName(rows(orders.where("o_orderpriority = '1-URGENT'"), nation, "read", "allow"))
        .unionByName(rows(orders.where("o_orderstatus = 'P'"), user, "owner", "deny"))
    )


@query("""
WITH lines AS (SELECT DISTINCT 'l' || l_orderkey || '-' || l_linenumber AS o, l_orderkey FROM lineitem
               WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
acl AS (
  SELECT 'o' || o_orderkey AS o, o_orderkey AS k, 'u' || o_custkey AS p, 'owner' AS lvl, 'allow' AS e FROM orders
  UNION ALL SELECT 'o' || o_orderkey, o_orderkey, 'n' || c_nationkey, 'read', 'allow' FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT 'o' || o_orderkey, o_orderkey, 'u' || o_custkey, 'owner', 'deny' FROM orders WHERE o_orderstatus = 'P')
SELECT o AS source_object_id, p AS principal_id, lvl AS access_level, e AS effect, 'direct' AS grant_type FROM acl
UNION ALL SELECT lines.o, p, lvl, e, 'inherited' FROM lines JOIN acl ON l_orderkey = k
""")
def acl_inherited(spark: SparkSession, d: str) -> DataFrame:
    """Order lines inherit the grants of their order."""
    lines = table(spark, d, "lineitem")
    line = F.concat(F.lit("l"), "l_orderkey", F.lit("-"), "l_linenumber").alias("object_id")
    parents = lines.select(F.concat(F.lit("o"), "l_orderkey").alias("parent_id"), line)
    inherited = access.inherit_acl(simple_acl(spark, d), parents)
    return inherited.select("source_object_id", "principal_id", "access_level", "effect", "grant_type")


def stamped_orders(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("object"), "o_orderstatus", "o_totalprice"
    )
    return access.apply_acl(orders, "object", simple_acl(spark, d))


@query("""
SELECT 'o' || o_orderkey AS object,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'n' || c_nationkey || ',' ELSE '' END || 'u' || o_custkey AS acl_allow,
       CASE WHEN o_orderstatus = 'P' THEN 'u' || o_custkey ELSE '' END AS acl_deny
FROM orders JOIN customer ON o_custkey = c_custkey
""")
def acl_stamp(spark: SparkSession, d: str) -> DataFrame:
    return stamped_orders(spark, d).select(
        "object", F.array_join("acl_allow", ",").alias("acl_allow"), F.array_join("acl_deny", ",").alias("acl_deny")
    )


VISIBLE = """
SELECT 'o' || o_orderkey AS object, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey
WHERE (o_custkey = 7 OR (o_orderpriority = '1-URGENT' AND c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 7)))
  AND NOT (o_custkey = 7 AND o_orderstatus = 'P')
"""


@query(VISIBLE)
def acl_visible(spark: SparkSession, d: str) -> DataFrame:
    """What one user sees, by the grant table; groups are found upwards, a deny wins."""
    people = table(spark, d, "customer").select(
        F.concat(F.lit("u"), "c_custkey").alias("id"),
        F.concat(F.lit("user"), "c_custkey", F.lit("@mail.test")).alias("email"),
    )
    requester = access.principals_of(membership(spark, d), people, " USER7@mail.test")
    orders = table(spark, d, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("object"), "o_orderstatus"
    )
    return access.visible_by_grants(orders, "object", simple_acl(spark, d), requester)


@query(VISIBLE)
def acl_visible_stamped(spark: SparkSession, d: str) -> DataFrame:
    """The same by the stamped arrays."""
    seven = table(spark, d, "customer").where("c_custkey = 7").first()
    principals = ["u7", f"n{seven.c_nationkey}"]
    return access.visible_to(stamped_orders(spark, d), principals).select("object", "o_orderstatus")


@query("""
SELECT 'all' AS object, count(*) AS n_allowed, sum(CASE WHEN o_orderkey = 7 THEN 1 ELSE 0 END)::BIGINT AS seen_by_last FROM orders
""")
def acl_many_grants(spark: SparkSession, d: str) -> DataFrame:
    """One object with a grant for every order: all are counted, and each requester sees it; grants stay rows."""
    orders = table(spark, d, "orders")
    acl = orders.select(
        F.lit("all").alias("source_object_id"), F.concat(F.lit("p"), "o_orderkey").alias("principal_id"),
        F.lit("read").alias("access_level"), F.lit("allow").alias("effect"),
    )
    objects = spark.sql("SELECT 'all' AS object")
    requester = spark.sql("SELECT 'p7' AS principal_id")
    seen = access.visible_by_grants(objects, "object", acl, requester).select(F.col("object").alias("_seen"))
    counts = access.grant_counts(acl).select(F.col("source_object_id").alias("_counted"), "n_allow")
    return (
        objects.join(counts, F.col("object") == F.col("_counted"), "left")
        .join(seen, F.col("object") == F.col("_seen"), "left")
        .select(
            "object", F.coalesce("n_allow", F.lit(0)).cast("bigint").alias("n_allowed"),
            F.col("_seen").isNotNull().cast("bigint").alias("seen_by_last"),
        )
    )


@query("""
SELECT 'o' || o_orderkey AS source_object_id, 'u' || o_custkey AS principal_id, 'owner' AS access_level,
       'deny' AS effect, 'added' AS change FROM orders WHERE o_orderstatus = 'P'
UNION ALL
SELECT 'o' || o_orderkey, 'n' || c_nationkey, 'read', 'allow', 'revoked'
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'
""")
def acl_diff(spark: SparkSession, d: str) -> DataFrame:
    acl = simple_acl(spark, d)
    return access.acl_diff(acl.where("effect = 'allow'"), acl.where("access_level = 'owner'"))
