"""Enrichment: typed records out of texts, with cache, budget, dead letters and usage."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import parse_record
from tarn.operators import enrich
from tarn.queries.registry import new_lake, query, table

# The record asked of a document, and the words that tell a language.
SCHEMA = {
    "type": "object",
    "properties": {
        "contact": {"type": "string"},
        "amount": {"type": "integer"},
        "tone": {"type": "string", "enum": ["plain", "asking", "loud"]},
        "has_link": {"type": "boolean"},
    },
    "required": ["amount", "tone"],
}
KEYWORDS = {
    "en": ["the", "of", "and", "with"],
    "fr": ["le", "la", "et", "que"],
    "de": ["der", "die", "und", "das"],
    "es": ["el", "los", "y", "por"],
}
EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+"
NUMBER = "[0-9]+"
BUDGET = 100_000
VERSION = "1"
RUBRIC = f"{json.dumps(SCHEMA, sort_keys=True)}|{VERSION}"


def rules(text: str = "text") -> dict[str, Column]:
    """The default extractor: native columns over the whole text."""
    col = F.col(text)
    return {
        "contact": F.nullif(F.regexp_extract(col, EMAIL, 0), F.lit("")),
        "amount": F.nullif(F.regexp_extract(col, NUMBER, 0), F.lit("")).try_cast("bigint"),
        "tone": F.when(col.contains("!"), "loud").when(col.contains("?"), "asking").otherwise("plain"),
        "has_link": col.contains("http"),
    }


def _record_sql(table_name: str, key: str) -> str:
    return f"""
SELECT {key}, nullif(regexp_extract(text, '{EMAIL}'), '') AS contact,
       TRY_CAST(nullif(regexp_extract(text, '{NUMBER}'), '') AS BIGINT) AS amount,
       CASE WHEN contains(text, '!') THEN 'loud' WHEN contains(text, '?') THEN 'asking' ELSE 'plain' END AS tone,
       contains(text, 'http') AS has_link FROM {table_name}
"""


DOCUMENT_RECORDS = _record_sql("documents", "doc_id")


def extracted(spark: SparkSession, d: str) -> DataFrame:
    return enrich.extract_records(table(spark, d, "documents"), "doc_id", "text", SCHEMA, rules())


@query(f"SELECT * FROM ({DOCUMENT_RECORDS}) WHERE amount IS NOT NULL")
def enrich_extract(spark: SparkSession, d: str) -> DataFrame:
    good, _ = enrich.split_dead_letters(extracted(spark, d))
    return enrich.flatten_struct(good, "profile", ["doc_id"])


@query(f"SELECT doc_id, 'missing:amount' AS error FROM ({DOCUMENT_RECORDS}) WHERE amount IS NULL")
def enrich_dead_letter(spark: SparkSession, d: str) -> DataFrame:
    _, bad = enrich.split_dead_letters(extracted(spark, d))
    return bad.select("doc_id", F.array_join("errors", ",").alias("error"))


@query("""
SELECT conv_id || ':' || turn AS id, len(string_split(text, ' ')) AS words, length(text) < 200 AS short
FROM conversations
""")
def enrich_by_model(spark: SparkSession, d: str) -> DataFrame:
    """The same job with a batched model in place of the rules."""

    def word_model(texts: list[str]) -> list[str]:
        """Stand-in for a remote model: facts about each text, as JSON."""
        import json

        return [json.dumps({"words": len(t.split(" ")), "short": len(t) < 200}) for t in texts]

    calls = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    schema = {
        "type": "object",
        "properties": {"words": {"type": "integer"}, "short": {"type": "boolean"}},
        "required": ["words"],
    }
    good = enrich.extract_records(calls, "id", "text", schema, word_model, batch_size=128)
    return enrich.flatten_struct(good, "profile", ["id"])


def _hits(words: list[str]) -> str:
    options = ", ".join(f"'{w}'" for w in words)
    return f"len(list_filter(w, lambda x: x IN ({options})))"


_HITS = {label: _hits(words) for label, words in KEYWORDS.items()}
_BEST = f"greatest({', '.join(_HITS.values())})"
_CASES = " ".join(f"WHEN {hits} = {_BEST} THEN '{label}'" for label, hits in _HITS.items())


@query(rf"""
SELECT doc_id, CASE WHEN {_BEST} = 0 THEN 'unknown' {_CASES} END AS label
FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[\s.,;:!?]+') AS w FROM documents)
""")
def enrich_classify(spark: SparkSession, d: str) -> DataFrame:
    label = enrich.classify("text", KEYWORDS, "unknown")
    return table(spark, d, "documents").select("doc_id", label.alias("label"))


@query(r"""
SELECT doc_id, array_to_string([len(list_filter(w, lambda x: (ascii(x) + 31 * length(x)) % 8 = b)) FOR b IN range(8)], ',') AS vector
FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\s.,;:!?]+'), lambda x: x <> '') AS w FROM documents)
""")
def enrich_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings whole, with a hash that SQL can express: first letter and length of a word."""
    vector = enrich.hashed_embedding("text", 8, lambda w: F.ascii(w) + 31 * F.length(w))
    counts = F.array_join(vector.cast("array<int>").cast("array<string>"), ",")
    return table(spark, d, "documents").select("doc_id", counts.alias("vector"))


@query(f"""
SELECT DISTINCT sha256(text || '|' || '{RUBRIC}') AS cache_key, length(text) AS n_chars FROM documents
WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en')
""")
def enrich_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    cached = documents.where("lang = 'en'").select(enrich.cache_key("text", SCHEMA, VERSION).alias("cache_key"))
    misses = enrich.cache_misses(documents, cached, "text", SCHEMA, VERSION)
    return misses.select("cache_key", F.length("text").cast("bigint").alias("n_chars"))


@query("""
SELECT run_id, calls, dead_letters FROM (
  SELECT 'first' AS run_id, count(DISTINCT text) AS calls FROM documents UNION ALL SELECT 'second', 0),
 (SELECT count(*) AS dead_letters FROM documents WHERE TRY_CAST(nullif(regexp_extract(text, '[0-9]+'), '') AS BIGINT) IS NULL)
""")
def enrich_rerun(spark: SparkSession, d: str) -> DataFrame:
    """Texts cost one call each; on a rerun only failed ones would."""
    lake = new_lake(spark)
    documents = table(spark, d, "documents")
    schema = {**SCHEMA, "required": ["tone"]}
    outcomes = [
        (run, enrich.enrich_table(lake, "docs", documents, "doc_id", "text", schema, rules(), run_id=run))
        for run in ("first", "second")
    ]
    checked = lake.read("enrichment/docs").where("profile.amount IS NULL")
    frames = [
        checked.agg(F.count("*").alias("dead_letters")).select(
            F.lit(run).alias("run_id"), F.lit(o["misses"]).cast("bigint").alias("calls"), "dead_letters"
        )
        for run, o in outcomes
    ]
    return frames[0].unionByName(frames[1])


@query(f"""
SELECT doc_id, tokens, running_tokens, running_tokens <= {BUDGET} AS issued FROM (
  SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens,
         CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) OVER (ORDER BY doc_id) AS BIGINT) AS running_tokens
  FROM documents)
""")
def enrich_budget(spark: SparkSession, d: str) -> DataFrame:
    return enrich.within_budget(table(spark, d, "documents"), "doc_id", "text", BUDGET)


@query("""
SELECT lang AS run_id, source AS model, count(*) AS calls,
       CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS BIGINT) AS tokens,
       CAST(0 AS BIGINT) AS retries, count(*) FILTER (WHERE length(text) < 500) AS cache_hits,
       CAST(round(CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS DECIMAL(18,0)) * CAST(CASE source WHEN 'src0' THEN 0.25 ELSE 1.5 END AS DECIMAL(8,4)) * CAST(0.000001 AS DECIMAL(7,6)), 6) AS DOUBLE) AS cost
FROM documents GROUP BY lang, source
""")
def enrichment_usage(spark: SparkSession, d: str) -> DataFrame:
    """Tokens, cost, retries and cache hits per run and model."""
    documents = table(spark, d, "documents")
    log = documents.select(
        F.col("lang").alias("run_id"), F.col("source").alias("model"),
        enrich.estimated_tokens("text").alias("tokens"), F.lit(0).alias("retries"),
        (F.length("text") < 500).alias("cache_hit"),
    )
    price = F.when(F.col("model") == "src0", F.lit(0.25)).otherwise(F.lit(1.5))
    prices = log.select("model").distinct().withColumn("price_per_million", price)
    return enrich.usage_totals(log, prices)


@query("""
SELECT doc_id, CAST(n_chars AS BIGINT) AS size, lang FROM documents
""")
def struct_flatten(spark: SparkSession, d: str) -> DataFrame:
    profile = F.struct(F.col("n_chars").alias("size"), "lang").alias("profile")
    return enrich.flatten_struct(table(spark, d, "documents").select("doc_id", profile), "profile")


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       CASE WHEN event_type IN ('click', 'view') THEN 'missing:kind'
            WHEN event_type = 'error' THEN 'enum:kind' ELSE '' END AS errors FROM events
""")
def json_extract_struct(spark: SparkSession, d: str) -> DataFrame:
    """JSON text to a typed struct; required fields and enums are checked."""
    schema = {
        "type": "object",
        "properties": {"k": {"type": "integer"}, "kind": {"type": "string", "enum": ["signup", "purchase"]}},
        "required": ["k", "kind"],
    }
    kind = F.when(~F.col("event_type").isin("click", "view"), F.col("event_type"))
    text = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), kind.alias("kind")))
    parsed = table(spark, d, "events").select("event_id", parse_record(text, schema).alias("p"))
    return parsed.select("event_id", F.col("p.record.k").alias("k"), F.array_join("p.errors", ",").alias("errors"))
