"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.bpe_codec import codec_digests, encode_and_decode
from tarn.llm.byte_shards import byte_shards
from tarn.llm.common import crc32_of_id
from tarn.llm.ctw import score_documents
from tarn.llm.embedding_dedup import near_vectors
from tarn.llm.exact_dedup import exact_groups
from tarn.llm.language_id import identify_languages
from tarn.llm.line_dedup import repeated_lines
from tarn.llm.periodic_runs import periodic_runs
from tarn.llm.pii_bootstrap import KINDS, find_personal_data, span_text
from tarn.llm.simhash_dedup import near_groups
from tarn.llm.source_mix import mix_plan
from tarn.llm.suffix_dedup import without_repeats
from tarn.llm.whitening import whiten

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql.strip()
        return function

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query()
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that repeat an earlier line."""
    found = repeated_lines(documents(spark, sf_dir), threshold=0.8)
    return found.select(
        "doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"),
    )


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    return codec_digests(encode_and_decode(documents(spark, sf_dir), tokenizer_path()))


@query()
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3 by source, at most 3 epochs each."""
    plan = mix_plan(documents(spark, sf_dir), weights=(1, 2, 3), max_epochs=3, seed=17)
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query(
    r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), best AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM texts
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM best
"""
)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that are equal without white space."""
    return exact_groups(documents(spark, sf_dir))


@query()
def op5_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = find_personal_data(documents(spark, sf_dir))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)).cast("bigint") for k in range(len(KINDS))]
    counts = [(F.size("base") - n).cast("bigint").alias(f"n_{kind}") for n, kind in zip(counts, KINDS, strict=True)]
    return found.select(
        "doc_id", *counts, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans")
    )


@query()
def op6_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of six in seven of them."""
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(crc32_of_id("doc_id") % 7 == 2, F.lit(False))
    scored = score_documents(docs, ~held_out).withColumn(
        "held_out", F.coalesce(crc32_of_id("doc_id") % 7 == 2, F.lit(False))
    )
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )


@query()
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents less the bytes that repeated strings of 400 bytes cover."""
    kept = without_repeats(documents(spark, sf_dir), length=400, token=50)
    return kept.select(
        "doc_id", F.col("text_bytes").alias("n_bytes"), (F.col("text_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"),
    )


@query()
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings that link at a cosine of 0.95 or more."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.95)


@query()
def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose fingerprints of 3-word shingles link at 2 bits or fewer."""
    return near_groups(documents(spark, sf_dir), words=3, max_bits=2, seed=42)


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by profiles learned from three quarters of the documents."""
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(crc32_of_id("doc_id") % 4 == 2, F.lit(False))
    found = identify_languages(docs, ~held_out)
    return found.select("doc_id", F.coalesce(crc32_of_id("doc_id") % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of all documents; those whose id has a CRC-32 divisible by 10 repeat some of their words."""
    h = crc32_of_id("doc_id")

    def repeated(words):
        n, g = F.size(words), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        # A lambda binds a and p once for all words.
        return F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda x: F.array_join(F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.get(words, F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"])),
        ), " "))[0]

    words = F.regexp_extract_all(F.col("text"), F.lit(r"([^\x20\x09-\x0D]+)"))
    planted = F.transform(F.array(words), repeated)[0]
    wanted = (h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return docs.select("doc_id", F.when(wanted, planted).otherwise(F.col("text")).alias("text"))


@query()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, some of which repeat words by rule."""
    found = periodic_runs(with_planted_repeats(documents(spark, sf_dir)), min_length=24, min_exponent=3)
    # Quotients of integers whose product is below 2^52 compare as doubles as they do exactly.
    ranked = F.transform("runs", lambda r: F.struct(
        (-r["length"] / r["period"]).alias("exponent"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")
    ))
    best = F.array_min(ranked)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


@query()
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole embeddings on the leading 16 axes of their integer covariance."""
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), scale=64, components=16)
    each = found.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", F.col("deviation").cast("bigint").alias("deviation"),
        "whitened", F.get("explained", "at").alias("explained"), "identity_error",
    )


@query()
def op13_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    sharded = byte_shards(documents(spark, sf_dir), shards=16, tolerance=0.001, seed=42)
    return sharded.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
