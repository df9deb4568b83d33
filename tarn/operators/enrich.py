"""Text to typed columns: cached, retried, budgeted batch extraction.

The extractor is pluggable. Rules are native columns; a model is a function from a list
of texts to a list of JSON texts, called in Arrow batches inside the tasks. Parsing,
schema checks, caching, accounting and dead letters are the same Spark job for both.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.json_records import parse_record, struct_type, violations
from tarn.operators.windows import running_total
from tarn.session import cut_lineage

# Characters per token of the usual estimate, and what separates words.
CHARS_PER_TOKEN = 4
WORD_BREAKS = r"[\s.,;:!?]+"

Rules = Mapping[str, Column]
Model = Callable[[list[str]], list[str]]


def estimated_tokens(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("bigint")


def cache_key(text: Column | str, schema: dict, version: str) -> Column:
    """Same text, schema and rubric version: same answer."""
    text = F.col(text) if isinstance(text, str) else text
    rubric = f"{json.dumps(schema, sort_keys=True)}|{version}"
    return F.sha2(F.concat_ws("|", text, F.lit(rubric)), 256)


def _model_batches(model: Model, text: str, batch_size: int, retries: int, backoff_seconds: float):
    """Task function; it names nothing of this package, so it travels to executors whole."""

    def call(texts: list[str]) -> tuple[list[str | None], str | None, int]:
        """Answers for one batch; a failing batch is retried ever later, then reported as failed."""
        import time

        for attempt in range(retries + 1):
            try:
                answers = list(model(texts))
                if len(answers) != len(texts):
                    raise ValueError("the model returned another number of answers")
                return answers, None, attempt
            except Exception as error:
                failure = f"{type(error).__name__}: {error}"
                if attempt < retries:
                    time.sleep(backoff_seconds * 2**attempt)
        return [None] * len(texts), failure, retries

    def outcomes(texts: list[str]) -> list[tuple[str | None, str | None, int]]:
        """One bad text must not sink its neighbours: a failing batch is tried again in halves."""
        answers, failure, tries = call(texts)
        if failure is None or len(texts) == 1:
            return [(a, failure, tries) for a in answers]
        half = len(texts) // 2
        return outcomes(texts[:half]) + outcomes(texts[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start : start + batch_size]
                outcome = outcomes(part[text].tolist())
                yield part.drop(columns=[text]).assign(
                    response=[o[0] for o in outcome],
                    failure=[o[1] for o in outcome],
                    retries=[o[2] for o in outcome],
                )

    return run


def extract_records(
    df: DataFrame,
    key: str,
    text: str,
    schema: dict,
    extractor: Rules | Model,
    batch_size: int = 64,
    num_partitions: int | None = None,
    max_retries: int = 2,
    backoff_seconds: float = 0.5,
) -> DataFrame:
    """``key, profile, errors, response, tokens, retries`` per row.

    ``errors`` holds the schema violations or the failure; it is empty for a good row.
    """
    tokens = estimated_tokens(text).alias("tokens")
    if callable(extractor):
        rows = df.select(key, text, tokens)
        if num_partitions:
            rows = rows.repartition(num_partitions)
        shape = T.StructType(
            [
                df.schema[key],
                T.StructField("tokens", T.LongType()),
                T.StructField("response", T.StringType()),
                T.StructField("failure", T.StringType()),
                T.StructField("retries", T.IntegerType()),
            ]
        )
        answered = rows.mapInPandas(_model_batches(extractor, text, batch_size, max_retries, backoff_seconds), shape)
        parsed = answered.withColumn("_parsed", parse_record("response", schema))
        failed = F.col("failure").isNotNull()
        return parsed.select(
            key,
            F.when(~failed, F.col("_parsed.record")).alias("profile"),
            F.when(failed, F.array("failure")).otherwise(F.col("_parsed.errors")).alias("errors"),
            "response",
            "tokens",
            "retries",
        )
    shape = struct_type(schema)
    record = F.struct(*[extractor[f.name].cast(f.dataType).alias(f.name) for f in shape])
    return df.select(key, tokens, record.alias("profile")).select(
        key,
        "profile",
        violations(F.col("profile"), schema).alias("errors"),
        F.to_json("profile").alias("response"),
        "tokens",
        F.lit(0).alias("retries"),
    )


def split_dead_letters(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows whose extraction failed or broke the schema)."""
    bad = F.size("errors") > 0
    return extracted.where(~bad).drop("errors"), extracted.where(bad)


def cache_misses(df: DataFrame, cache: DataFrame, text: str, schema: dict, version: str) -> DataFrame:
    """Distinct texts without a cached answer: ``cache_key, <text>``."""
    keyed = df.select(cache_key(text, schema, version).alias("cache_key"), text)
    fresh = keyed.join(cache.select("cache_key"), "cache_key", "left_anti")
    return fresh.dropDuplicates(["cache_key"])


def enrich_table(
    lake,
    table: str,
    df: DataFrame,
    key: str,
    text: str,
    schema: dict,
    extractor: Rules | Model,
    version: str = "1",
    run_id: str = "run",
    model: str = "rules",
    budget_tokens: int | None = None,
    **options,
) -> dict[str, int]:
    """raw -> enrichment: extract only what the cache lacks, keep errors apart.

    Order of effects: cached answers, then the enrichment table, dead letters, usage.
    ``df`` is the whole raw table. Only keys whose text is new or changed, or whose answer has
    just come, are parsed and merged; a run without any leaves the tables as they are. Past
    ``budget_tokens`` no call is made: the texts held back are asked for in the next run.
    """
    cache_source = ("enrichment", f"{table}__cache")
    shape = "cache_key string, response string, errors array<string>, tokens bigint, retries int"
    if lake.table_exists(cache_source):
        cache = lake.read(cache_source).where(F.size("errors") == 0)
    else:
        cache = lake.spark.createDataFrame([], shape)
    misses, held_back = cache_misses(df, cache, text, schema, version), 0
    if budget_tokens is not None:
        misses = cut_lineage(misses)
        issued = cut_lineage(within_budget(misses, "cache_key", text, budget_tokens).select("cache_key", "issued"))
        held_back = issued.where("NOT issued").count()
        misses = misses.join(issued.where("issued").select("cache_key"), "cache_key", "left_semi")
    answers = extract_records(misses, "cache_key", text, schema, extractor, **options)
    landed = lake.write(
        *cache_source, answers.drop("profile"), "merge", pk="cache_key", skip_empty=True
    )
    result = {"misses": landed.changed_rows if landed else 0, "held_back": held_back, "dead_letters": 0}
    if not lake.table_exists(cache_source):
        return result
    fresh = lake.read_delta_of(cache_source, landed) if landed else lake.read(cache_source).limit(0)
    keyed = df.select(key, cache_key(text, schema, version).alias("cache_key"))
    _merge_answers(lake, table, key, keyed, fresh.select("cache_key"), schema, cache_source)
    lake.write("state", f"{table}__usage", usage_of(fresh, run_id, model), "append", skip_empty=True)
    errors = ("enrichment", f"{table}__errors")
    result["dead_letters"] = lake.count(errors) if lake.table_exists(errors) else 0
    return result


def _merge_answers(
    lake, table: str, key: str, keyed: DataFrame, fresh: DataFrame, schema: dict, cache_source: tuple[str, str]
) -> None:
    """Move the answers of changed keys into the enrichment table or its dead letters."""
    state, target, errors = ("state", f"{table}__answers"), ("enrichment", table), ("enrichment", f"{table}__errors")
    gone = None
    if lake.table_exists(state):
        known = lake.pin(state).select(F.col(key).alias("_key"), F.col("cache_key").alias("_cache_key"))
        same = F.col(key).eqNullSafe(F.col("_key"))
        moved = keyed.join(known, same & (F.col("cache_key") == F.col("_cache_key")), "left_anti")
        renewed = keyed.join(fresh, "cache_key", "left_semi")
        gone = known.join(keyed.select(key), same, "left_anti").select(F.col("_key").alias(key))
        keyed = moved.unionByName(renewed).distinct()
    cached = lake.read(cache_source).withColumn("_parsed", parse_record("response", schema))
    answered = keyed.join(cached, "cache_key").select(
        key, "cache_key", F.col("_parsed.record").alias("profile"), "errors", "response"
    )
    staged = lake.write(*state, answered, "merge", pk=key, skip_empty=gone is not None)
    if gone is not None:
        gone = cut_lineage(gone)
        if not gone.isEmpty():
            for source in (state, target, errors):
                lake.delete_where_in(source, key, gone)
    if staged is None:
        return
    good, bad = split_dead_letters(lake.read_delta_of(state, staged))
    for source, rows, others in ((target, good.select(key, "profile"), bad), (errors, bad.select(key, "errors", "response"), good)):
        lake.write(*source, rows, "merge", pk=key, skip_empty=lake.table_exists(source))
        if not others.isEmpty():
            lake.delete_where_in(source, key, others.select(key))


def is_enriched(lake, table: str, df: DataFrame, key: str, text: str, schema: dict, version: str = "1") -> bool:
    """Whether every row of ``df`` has been answered or is a dead letter for its present text:
    what a model that depends on the enrichment waits for."""
    state = ("state", f"{table}__answers")
    if not lake.table_exists(state):
        return df.isEmpty()
    keyed = df.select(key, cache_key(text, schema, version).alias("cache_key"))
    return keyed.join(lake.read(state).select("cache_key"), "cache_key", "left_anti").isEmpty()


def usage_of(answers: DataFrame, run_id: str, model: str = "rules") -> DataFrame:
    """One usage row per call."""
    return answers.select(
        F.lit(run_id).alias("run_id"), F.lit(model).alias("model"), "cache_key", "tokens", "retries"
    )


def usage_totals(log: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Calls, tokens, retries, cache hits and cost per run and model.

    ``prices`` has ``model`` and ``price_per_million``; costs are exact decimals.
    """
    hit = F.col("cache_hit") if "cache_hit" in log.columns else F.lit(False)
    totals = log.groupBy("run_id", "model").agg(
        F.count("*").alias("calls"),
        F.sum("tokens").alias("tokens"),
        F.sum("retries").alias("retries"),
        F.count_if(hit).alias("cache_hits"),
    )
    if prices is None:
        return totals
    price = F.col("price_per_million").cast("decimal(8,4)") * F.lit("0.000001").cast("decimal(7,6)")
    cost = F.col("tokens").cast("decimal(18,0)") * price
    return totals.join(prices, "model", "left").select(
        *totals.columns, F.round(cost, 6).cast("double").alias("cost")
    )


def within_budget(
    df: DataFrame, key: str, text: str, budget_tokens: int, partitions: int | None = None
) -> DataFrame:
    """``key, tokens, running_tokens, issued``: calls go out in key order up to the cap."""
    sized = df.select(key, estimated_tokens(text).alias("tokens"))
    total = running_total(sized, "tokens", [F.col(key).asc()], (), "_before", partitions)
    running = F.col("_before") + F.col("tokens")
    return total.select(
        key, "tokens", running.alias("running_tokens"), (running <= budget_tokens).alias("issued")
    )


def _hits(found: Column, words: Sequence[str]) -> Column:
    return F.size(F.filter(found, lambda w: w.isin(list(words))))


def classify(text: Column | str, keywords: Mapping[str, Sequence[str]], default: str) -> Column:
    """Label with the most keyword hits in the text; earlier labels win ties."""
    text = F.lower(F.col(text) if isinstance(text, str) else text)
    found = F.split(text, WORD_BREAKS)
    scores = [
        F.struct(
            _hits(found, words).alias("hits"),
            F.lit(-i).alias("place"),
            F.lit(label).alias("label"),
        )
        for i, (label, words) in enumerate(keywords.items())
    ]
    best = F.array_max(F.array(*scores))
    return F.when(best["hits"] > 0, best["label"]).otherwise(F.lit(default))


def hashed_embedding(
    text: Column | str, dims: int = 16, hashing: Callable[[Column], Column] = F.xxhash64
) -> Column:
    """Word counts folded into ``dims`` hash buckets: the default, model-free embedding."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.lower(text), WORD_BREAKS), lambda w: w != "")
    buckets = F.transform(words, lambda w: F.pmod(hashing(w), F.lit(dims)))

    def counts(found: Column) -> Column:
        """Sizes before and after taking a bucket out; a null text has a null embedding."""
        return F.array(*[(F.size(found) - F.size(F.array_remove(found, d))).cast("float") for d in range(dims)])

    # The one-element transform names the array, so the text is split and hashed once.
    return F.when(text.isNotNull(), F.element_at(F.transform(F.array(buckets), counts), 1))


def embed_texts(df: DataFrame, key: str, text: str, model: Model, **options) -> DataFrame:
    """Embeddings from a model whose answer is a JSON array of numbers."""
    shape = {"type": "object", "properties": {}}
    answers = extract_records(df, key, text, shape, model, **options)
    return answers.select(
        key, F.from_json("response", "array<float>").alias("embedding"), "tokens", "retries"
    )


def flatten_struct(df: DataFrame, struct_col: str, keep: Sequence[str] | None = None) -> DataFrame:
    """Struct fields as columns, after the kept ones."""
    keep = list(keep) if keep is not None else [c for c in df.columns if c != struct_col]
    return df.select(*keep, f"{struct_col}.*")
