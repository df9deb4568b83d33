"""Scalar functions, joins, aggregations, windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn import functions as fn
from tarn.functions.scalars import HIGH_BALANCE, MID_BALANCE
from tarn.operators.merge import changed_by_content, keep_latest, union_sources
from tarn.operators.windows import rank_in_group, running_total
from tarn.plans import clean
from tarn.queries.inputs import CONTRACTS, RAW_CUSTOMERS, RECENT, contracts, products, raw_customers, users
from tarn.queries.registry import query, table, uuid5_sql
from tarn.queries.writes import LATEST_LINE, LINE_COLUMNS
from tarn.sources.generate import PARTNER_COUNT, PARTNERS_SQL, gen_partners

AS_OF = "2026-06-27"


@query(f"""
WITH c AS ({RAW_CUSTOMERS}),
partners AS ({PARTNERS_SQL})
SELECT id AS external_id, lower(trim(email)) AS email, split_part(lower(trim(email)), '@', 2) AS email_domain,
       trim(name) AS name, nation_id, segment, balance, created_at AS created_at_utc,
       date_diff('day', created_at, TIMESTAMP '{AS_OF}') AS account_age_days,
       CASE WHEN balance >= {HIGH_BALANCE} THEN 'high' WHEN balance >= {MID_BALANCE} THEN 'mid' ELSE 'low' END AS balance_tier,
       partner_name, partner_tier, CAST(rate AS DOUBLE) AS commission_rate,
       CAST(round(CAST(balance AS DECIMAL(18,2)) * rate, 2) AS DOUBLE) AS commission_value,
       rank() OVER (PARTITION BY segment ORDER BY balance DESC) AS balance_rank_in_segment
FROM c LEFT JOIN partners ON 1 + id % {PARTNER_COUNT} = partner_id WHERE id IS NOT NULL
""")
def clean_customers(spark: SparkSession, d: str) -> DataFrame:
    """The wide clean model."""
    model = clean.clean_customers(
        raw_customers(spark, d), gen_partners(spark), AS_OF,
        partner_of=F.pmod("id", F.lit(PARTNER_COUNT)) + 1, passthrough=["nation_id"],
    )
    return model.withColumn("created_at_utc", F.col("created_at_utc").cast("timestamp_ntz"))


@query(f"""
SELECT id, lower(trim(email)) AS email, split_part(lower(trim(email)), '@', 2) AS domain,
       split_part(lower(trim(name)), '@', 2) AS no_domain FROM ({RAW_CUSTOMERS})
""")
def normalize_email(spark: SparkSession, d: str) -> DataFrame:
    return raw_customers(spark, d).select(
        "id", fn.normalize_email("email").alias("email"), fn.email_domain("email").alias("domain"),
        fn.email_domain("name").alias("no_domain"),
    )


@query(f"""
SELECT split_part(lower(trim(email)), '@', 2) AS domain, count(*) AS n_customers
FROM ({RAW_CUSTOMERS}) GROUP BY 1
""")
def email_domain(spark: SparkSession, d: str) -> DataFrame:
    domain = fn.email_domain("email").alias("domain")
    return raw_customers(spark, d).groupBy(domain).agg(F.count("*").alias("n_customers"))


@query("""
SELECT o_orderkey AS external_id, lower(trim('  User' || o_custkey || '@Mail.Test ')) AS email,
       TRY_CAST(CASE WHEN o_orderpriority = '5-LOW' THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE) AS amount,
       o_orderdate AS updated_at FROM orders
""")
def typed_cast(spark: SparkSession, d: str) -> DataFrame:
    """Everything arrives as text; amounts that are not numbers become NULL."""
    text = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("  User"), "o_custkey", F.lit("@Mail.Test ")).alias("email"),
        F.when(F.col("o_orderpriority") == "5-LOW", "n/a")
        .otherwise(F.col("o_totalprice").cast("string")).alias("amount"),
        F.col("o_orderdate").cast("string").alias("updated_at"),
    )
    return clean.clean_orders(text)


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' UTC' AS at_utc FROM events
""")
def utc_normalize(spark: SparkSession, d: str) -> DataFrame:
    at = F.date_format(fn.to_utc("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS zzz")
    return table(spark, d, "events").select("event_id", at.alias("at_utc"))


@query(f"SELECT event_id, date_diff('day', ts, TIMESTAMP '{AS_OF}') AS age_days FROM events")
def account_age_days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", fn.age_in_days("ts", AS_OF).alias("age_days"))


@query("""
SELECT CASE WHEN c_acctbal >= 1000 THEN 'high' WHEN c_acctbal >= 100 THEN 'mid' ELSE 'low' END AS tier,
       count(*) AS n_customers FROM customer GROUP BY 1
""")
def balance_tier(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy(fn.tier_of("c_acctbal").alias("tier")).agg(
        F.count("*").alias("n_customers")
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey,
       CAST(round(CAST(l_quantity AS DECIMAL(10,2)) * CAST(p_retailprice AS DECIMAL(10,2)) * CAST(1 - l_discount AS DECIMAL(4,2)), 2) AS DOUBLE) AS line_total
FROM lineitem JOIN part ON l_partkey = p_partkey
""")
def line_total(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    total = (
        F.col("l_quantity").cast("decimal(10,2)") * F.col("p_retailprice").cast("decimal(10,2)")
        * (1 - F.col("l_discount")).cast("decimal(4,2)")
    )
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", fn.round_money(total).alias("line_total"))


@query("""
SELECT c_custkey % 16 AS bucket, count(*) AS n_customers, true AS hash_in_range FROM customer GROUP BY 1
""")
def bucket_assign(spark: SparkSession, d: str) -> DataFrame:
    """Buckets by value; those by hash are only checked for their range."""
    hashed = fn.bucket_of("c_custkey", 16, hashed=True)
    return table(spark, d, "customer").groupBy(fn.bucket_of("c_custkey", 16).alias("bucket")).agg(
        F.count("*").alias("n_customers"), F.bool_and(hashed.between(0, 15)).alias("hash_in_range")
    )


@query("""
SELECT p_partkey, TIMESTAMP '2026-01-01' + to_days(p_size) AS available_at FROM part
""")
def interval_add(spark: SparkSession, d: str) -> DataFrame:
    start = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, d, "part").select("p_partkey", fn.add_days(start, "p_size").alias("available_at"))


@query("""
SELECT 'all' AS rows_read, max(ts) AS mark FROM events
UNION ALL SELECT 'none', coalesce(max(ts), TIMESTAMP '1900-01-01') FROM events WHERE event_type = 'unknown'
""")
def watermark_default(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    full = events.agg(fn.watermark_or("ts").alias("mark")).withColumn("rows_read", F.lit("all"))
    none = events.where("event_type = 'unknown'").agg(fn.watermark_or("ts").alias("mark"))
    return full.unionByName(none.withColumn("rows_read", F.lit("none")))


@query("SELECT page_id, regexp_extract(url, '([^/]+)$', 1) AS basename FROM pages")
def path_basename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", fn.path_basename("url").alias("basename"))


@query(f"""
SELECT c_custkey, {uuid5_sql("'User:' || c_custkey")} AS entity_id FROM customer
""")
def uuid5_entity_id(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("User:"), "c_custkey")
    return table(spark, d, "customer").select("c_custkey", fn.uuid5(key).alias("entity_id"))


@query("SELECT conv_id || ':' || turn AS message_key, role FROM conversations")
def synthetic_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(
        fn.synthetic_key("conv_id", "turn").alias("message_key"), "role"
    )


@query("""
SELECT c_custkey, 'user' || c_custkey || '@mail.test' AS email,
       '119' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS phone,
       lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS cnpj,
       CASE WHEN c_acctbal >= 0 THEN trim(c_name) END AS name FROM customer
""")
def normalize_er_fields(spark: SparkSession, d: str) -> DataFrame:
    key = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    phone = F.concat(F.lit("+55 (11) 9"), F.substring(key, 1, 4), F.lit("-"), F.substring(key, 5, 4))
    raw = table(spark, d, "customer").select(
        "c_custkey",
        F.concat(F.lit("  User"), "c_custkey", F.lit("@Mail.Test ")).alias("email"),
        phone.alias("phone"),
        F.concat(F.col("c_custkey").cast("string"), F.lit("/-.")).alias("cnpj"),
        F.when(F.col("c_acctbal") >= 0, F.concat("c_name", F.lit(" "))).otherwise("  ").alias("name"),
    )
    return raw.select("c_custkey", *[fn.normalize_field(c).alias(c) for c in ("email", "phone", "cnpj", "name")])


LONG_PHONES = """
SELECT c_custkey,
       CASE WHEN c_custkey = 0 THEN repeat('0', 10) WHEN key LIKE '55%' OR c_custkey = 5 THEN substr(repeat(key, 12), 3) ELSE repeat(key, 12) END AS long_phone,
       '119' || repeat(key, 12) AS long_local
FROM (SELECT c_custkey, c_custkey::VARCHAR AS key FROM customer)
"""


@query(LONG_PHONES, name="normalize_long_phones")
@query(LONG_PHONES)
def normalize_all_long_phones(spark: SparkSession, d: str) -> DataFrame:
    """Long numbers of every customer: only an international prefix (00, or 55 before a local number) goes, once."""
    key = F.col("c_custkey").cast("string")
    raw = table(spark, d, "customer").select(
        "c_custkey", F.repeat(key, F.lit(12)).alias("long_phone"),
        F.concat(F.lit("+55 (11) 9"), F.repeat(key, F.lit(12))).alias("long_local"),
    )
    return raw.select("c_custkey", *[fn.normalize_phone(c).alias(c) for c in ("long_phone", "long_local")])


@query(f"""
SELECT o_orderkey, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '{RECENT}'
""")
def content_hash_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changed rows of a table without a cursor, found by content."""
    before = table(spark, d, "orders")
    recent = F.col("o_orderdate") >= F.lit(RECENT).cast("timestamp_ntz")
    after = before.withColumn("o_totalprice", F.col("o_totalprice") + F.when(recent, 1).otherwise(0))
    return changed_by_content(after, before, "o_orderkey").select("o_orderkey", "o_totalprice")


# --- joins --------------------------------------------------------------------------


@query("""
SELECT l_orderkey * 100 + l_linenumber AS order_id, 'user' || o_custkey AS customer_email,
       CAST(l_partkey AS VARCHAR) AS product_sku, p_name AS product_name, p_type AS category,
       l_quantity AS qty, p_retailprice AS unit_price, l_quantity * p_retailprice AS line_total
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
""")
def clean_order_lines(spark: SparkSession, d: str) -> DataFrame:
    """Own order lines x federated product master."""
    lines = table(spark, d, "lineitem").join(
        table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    ).select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("order_id"),
        F.concat(F.lit("user"), "o_custkey").alias("customer_email"),
        F.col("l_partkey").cast("string").alias("product_sku"),
        F.col("l_quantity").alias("qty"),
    )
    master = table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("sku"), F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"), F.col("p_retailprice").alias("unit_price"),
    )
    return clean.clean_order_lines(lines, master)


@query(f"""
SELECT c.external_id, c.status, c.value, p_name AS product_name, p_type AS category
FROM ({CONTRACTS}) c LEFT JOIN part ON product_id = p_partkey
""")
def clean_contracts(spark: SparkSession, d: str) -> DataFrame:
    model = clean.clean_contracts(contracts(spark, d), products(spark, d))
    return model.select("external_id", "status", "value", "product_name", "category")


@query(f"""
SELECT count(*) AS total_rows, count(*) - count(p_name) AS unmatched_rows
FROM ({CONTRACTS}) LEFT JOIN part ON product_id = p_partkey
""")
def contracts_without_product(spark: SparkSession, d: str) -> DataFrame:
    return clean.without_match(clean.clean_contracts(contracts(spark, d), products(spark, d)), "product_name")


@query("""
SELECT d.doc_id, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def hybrid_clean(spark: SparkSession, d: str) -> DataFrame:
    """Federated documents LEFT JOIN their enrichment, a struct per document."""
    enriched = table(spark, d, "labels").select("doc_id", F.struct("quality", "toxic").alias("profile"))
    federated = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return clean.hybrid_clean(federated, enriched, "doc_id")


@query(f"""
SELECT c_custkey AS external_id, trim(c_name) AS name FROM customer WHERE c_custkey IN (
  SELECT first_party FROM ({CONTRACTS}) WHERE status = 'F'
  UNION SELECT second_party FROM ({CONTRACTS}) WHERE status = 'F')
""")
def referenced_slice(spark: SparkSession, d: str) -> DataFrame:
    """Only the users some closed contract refers to."""
    closed = contracts(spark, d).where("status = 'F'")
    people = users(spark, d).select("external_id", "name")
    return clean.referenced_rows(people, "external_id", closed, "first_party", "second_party")


@query(f"""
SELECT c.external_id, a.c_name AS first_party_name, b.c_name AS second_party_name
FROM ({CONTRACTS}) c LEFT JOIN customer a ON first_party = a.c_custkey
LEFT JOIN customer b ON second_party = b.c_custkey
""")
def contract_parties(spark: SparkSession, d: str) -> DataFrame:
    joined = clean.contract_parties(
        contracts(spark, d), users(spark, d), "first_party", "second_party", "external_id", "name"
    )
    return joined.select("external_id", "first_party_name", "second_party_name")


# --- aggregations and windows -------------------------------------------------------


@query("""
SELECT 'events' AS table_name, max(ts) AS mark FROM events
UNION ALL SELECT 'lineitem', max(l_shipdate) FROM lineitem
UNION ALL SELECT 'orders', max(o_orderdate) FROM orders
""")
def watermark_max(spark: SparkSession, d: str) -> DataFrame:
    cursors = {"events": "ts", "lineitem": "l_shipdate", "orders": "o_orderdate"}
    frames = [
        table(spark, d, t).agg(F.max(c).alias("mark")).withColumn("table_name", F.lit(t))
        for t, c in cursors.items()
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("""
SELECT o_orderstatus, count(*) AS n_rows,
       CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS total_amount
FROM orders GROUP BY o_orderstatus ORDER BY n_rows DESC, o_orderstatus
""")
def status_totals(spark: SparkSession, d: str) -> DataFrame:
    return clean.status_totals(table(spark, d, "orders"), "o_orderstatus", "o_totalprice")


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
""")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return clean.duplicate_keys(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query(LATEST_LINE)
def dedup_latest(spark: SparkSession, d: str) -> DataFrame:
    lines = keep_latest(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate")
    return lines.select(*LINE_COLUMNS)


@query("""
SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice,
       rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS price_rank FROM lineitem
""")
def balance_rank(spark: SparkSession, d: str) -> DataFrame:
    ranked = rank_in_group(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "price_rank")
    return ranked.select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "price_rank")


@query("""
SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS flag, nullif(l_quantity, 10) AS quantity,
       rank() OVER (PARTITION BY nullif(l_returnflag, 'N') ORDER BY nullif(l_quantity, 10) DESC NULLS LAST) AS quantity_rank
FROM lineitem
""")
def rank_null_groups(spark: SparkSession, d: str) -> DataFrame:
    """A group without a name and rows without a value are ranked like all others."""
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif("l_returnflag", F.lit("N")).alias("flag"),
        F.nullif("l_quantity", F.lit(10)).alias("quantity"),
    )
    return rank_in_group(lines, ["flag"], "quantity", "quantity_rank")


@query("""
SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice,
       rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS price_rank FROM lineitem
""")
def balance_rank_hot_groups(spark: SparkSession, d: str) -> DataFrame:
    """The same rank where one group holds all rows of a flag: no task holds a group."""
    ranked = rank_in_group(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "price_rank")
    return ranked.select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "price_rank")


@query("""
SELECT event_id, user_id, CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY event_type ORDER BY ts, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS value_before FROM events
""")
def running_value(spark: SparkSession, d: str) -> DataFrame:
    """Distributed running total per event type."""
    events = table(spark, d, "events").withColumn("v", F.col("value").cast("decimal(18,2)"))
    total = running_total(events, "v", [F.col("ts").asc(), F.col("event_id").asc()], ["event_type"], "value_before")
    return total.select("event_id", "user_id", F.col("value_before").cast("double").alias("value_before"))


# --- sort, limit, sets --------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem
ORDER BY l_shipdate NULLS LAST, l_orderkey, l_linenumber
""")
def sorted_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity"
    ).orderBy(F.col("l_shipdate").asc_nulls_last(), "l_orderkey", "l_linenumber")


@query("""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100
""")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(
        F.col("o_totalprice").desc_nulls_last(), "o_orderkey"
    ).limit(100)


@query("""
SELECT 'customers' AS source, c_custkey AS id, c_name AS name FROM customer
UNION ALL SELECT 'suppliers', s_suppkey, s_name FROM supplier
""")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    """One table out of one store per connector."""
    return union_sources(
        customers=table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        suppliers=table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
    )


UNIFIED = """
SELECT 'postgres:' || c_custkey AS external_id, 'postgres' AS source,
       'user' || c_custkey || '@mail.test' AS email, c_name AS name FROM customer
UNION ALL
SELECT 'mongodb:' || s_suppkey, 'mongodb', 'user' || s_suppkey || '@mail.test', s_name FROM supplier
"""


def unified(spark: SparkSession, d: str) -> DataFrame:
    people = raw_customers(spark, d)
    mail = F.concat(F.lit(" USER"), "s_suppkey", F.lit("@mail.test")).alias("mail")
    firms = table(spark, d, "supplier").select("s_suppkey", mail, "s_name")
    return clean.unify_sources(
        {"postgres": people.withColumn("name", F.trim("name")), "mongodb": firms},
        {"postgres": "id", "mongodb": "s_suppkey"},
        {
            "postgres": {"email": "email", "name": "name"},
            "mongodb": {"email": "mail", "name": "s_name"},
        },
    )


@query(UNIFIED)
def unify_sources(spark: SparkSession, d: str) -> DataFrame:
    return unified(spark, d)


@query(f"SELECT source, count(*) AS n_rows FROM ({UNIFIED}) GROUP BY source")
def per_source_counts(spark: SparkSession, d: str) -> DataFrame:
    return unified(spark, d).groupBy("source").agg(F.count("*").alias("n_rows"))
