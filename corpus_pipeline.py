"""A training corpus in five stages, each written before the next one reads it.

Documents without a known language go; of equal and of nearly equal texts one stays; sources
are mixed to target weights; what is left is encoded. Each stage is one operator of
``tarn.llm`` over everything its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.bpe_codec import codec_digests, encode_and_decode
from tarn.llm.exact_dedup import distinct_documents
from tarn.llm.language_id import with_known_language
from tarn.llm.queries import documents, tokenizer_path
from tarn.llm.simhash_dedup import near_distinct_documents
from tarn.llm.source_mix import mixed_documents
from tarn.session import scratch_path

#: No SQL can express the language profiles, fingerprints and merges.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language cannot be told; learns from all that name one."""
    return with_known_language(docs, F.lit(True))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return distinct_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_distinct_documents(docs, words=3, max_bits=2, seed=42)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is a row for each time the mix takes it."""
    return mixed_documents(docs, weights=(1, 2, 3), max_epochs=3, seed=17)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row of the mix."""
    return codec_digests(encode_and_decode(docs, tokenizer_path()))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", near_dedup),
    ("source_mix", mix),
    ("bpe_codec", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
