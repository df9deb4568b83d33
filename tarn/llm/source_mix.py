"""Mix sources to target weights by capped water-filling, with seeded repetitions.

All steps are aggregates and joins. Only narrow rows (id, source, size) are ever shuffled, the
loop looks at one row of sums per round, and the order within a source is found from 4,096
hash buckets first, so that no task sorts a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import repeats_ids
from tarn.operators.windows import running_total
from tarn.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS, SALTS = 4096, 64


def document_sizes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", hashes: bool = False
) -> DataFrame:
    """``_id, _source, _size``: the number of words of each document (null text: 0); with ``hashes`` also ``_text_hash``."""
    more = [text_hash(text_col).alias("_text_hash")] if hashes else []
    return docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("_size"), *more,
    )


def text_hash(text: Column | str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def weighted_sources(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3)) -> DataFrame:
    """``_source, _total, _weight``: sources by code point, null last, take the weights in turn."""
    totals = sizes.groupBy("_source").agg(F.sum("_size").alias("_total")).withColumn("_one", F.lit(1))
    placed = running_total(totals, "_one", [F.col("_source").asc_nulls_last()], name="_place")
    turns = F.array(*[F.lit(float(w)) for w in weights])
    turn = (F.col("_place") % F.lit(len(weights))).cast("int")
    return cut_lineage(placed.select("_source", "_total", F.get(turns, turn).alias("_weight")))


def water_level(sources: DataFrame, max_epochs: float) -> float:
    """The level per unit of weight at which clamped targets add up to all sizes.

    A round shares what clamped sources leave among the free ones by weight and clamps those
    it lifts above their cap; the level only rises, so a clamped source stays clamped, and the
    rounds end when no source is clamped anew.
    """
    level, clamped = 0.0, -1
    cap = F.col("_total") * F.lit(float(max_epochs))
    while True:
        full = cap < F.col("_weight") * F.lit(level)
        row = sources.agg(
            F.sum("_total").alias("all"), F.sum(full.cast("bigint")).alias("clamped"),
            F.sum(F.when(full, cap)).alias("held"), F.sum(F.when(~full, F.col("_weight"))).alias("free"),
        ).first()
        if row["all"] is None or row["clamped"] == clamped or not row["free"]:
            return level
        clamped = row["clamped"]
        level = (row["all"] - (row["held"] or 0.0)) / row["free"]


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3) -> DataFrame:
    """``_source, _total, _target``: the words each source gives to the mix."""
    sources = weighted_sources(sizes, weights)
    lifted = F.col("_weight") * F.lit(water_level(sources, max_epochs))
    return sources.select(
        "_source", "_total", F.least(F.col("_total") * F.lit(float(max_epochs)), lifted).alias("_target")
    )


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    max_epochs: float = 3,
    seed: int = 17,
) -> DataFrame:
    """How often the mix takes each row: ``<id>, size, source_size, target, copies, taken``.

    A source's target divided by its size is its number of epochs: each of its documents is
    taken the whole part of that, and documents in the order of a seeded hash once more until
    the fraction is reached as closely as whole documents allow. ``taken`` is copies times
    size. Sources are told apart by value with null as one more; null or blank texts have size
    0 and are taken the whole part only. Rows that repeat an id are documents of their own that
    share a place in the order. A source of size 0 has target 0. No rows give no rows. Extra
    columns are not read. Reruns agree.
    """
    copies = F.col("_copies")
    return _planned(document_sizes(docs, id_col, text_col, source_col), weights, max_epochs, seed).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_total").alias("source_size"),
        F.col("_target").alias("target"), copies.alias("copies"), (copies * F.col("_size")).alias("taken"),
    )


def _planned(sizes: DataFrame, weights: Sequence[float], max_epochs: float, seed: int) -> DataFrame:
    """The rows of ``document_sizes`` with ``_total, _target`` of their source and ``_copies``."""
    if max_epochs < 1:
        raise ValueError("below one epoch the sizes do not fit into the caps")
    further = [c for c in sizes.columns if c == "_text_hash"]
    sizes = cut_lineage(sizes)
    targets = source_targets(sizes, weights, max_epochs)
    epochs = F.when(F.col("_total") > 0, F.col("_target") / F.col("_total")).otherwise(0.0)
    shares = targets.select(
        F.col("_source").alias("_of"), "_total", "_target", F.floor(epochs).alias("_whole"),
        (F.col("_target") - F.floor(epochs) * F.col("_total")).alias("_rest"),
    )
    order = F.xxhash64(F.lit(seed), F.col("_id"))
    rows = sizes.withColumn("_order", order).withColumn("_bucket", F.shiftrightunsigned(order, 52))
    # The bucket of each source in which the fraction ends.
    filled = rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_words"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        filled.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
        .join(shares, F.col("_source").eqNullSafe(F.col("_of")))
        .where((F.col("_before") < F.col("_rest")) & (F.col("_rest") <= F.col("_before") + F.col("_words")))
        .select("_of", F.col("_bucket").alias("_end"), F.col("_before"))
    )
    shares = shares.join(ends.withColumnRenamed("_of", "_end_of"), F.col("_of").eqNullSafe(F.col("_end_of")), "left")
    # Where rounding leaves the rest above all words, every bucket is below the end.
    shares = shares.select(
        "_of", "_total", "_target", "_whole", "_rest", "_before",
        F.coalesce("_end", F.when(F.col("_rest") > 0, F.lit(BUCKETS)).otherwise(F.lit(-1))).alias("_end"),
    )
    # A source of a third of all rows is spread over the salts.
    salted = shares.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_bucket") % SALTS == F.col("_salt"))
    placed = rows.join(salted, same).drop("_salt")
    inside = Window.partitionBy("_source").orderBy("_order", "_id", "_size", *further).rowsBetween(Window.unboundedPreceding, -1)
    at_end = F.col("_bucket") == F.col("_end")
    ending = placed.where(at_end).withColumn(
        "_reached", F.coalesce(F.sum("_size").over(inside), F.lit(0)) + F.col("_before")
    )
    # The document at the end is taken if that comes nearer to the target than leaving it.
    nearer = (F.col("_reached") + F.col("_size") / 2 <= F.col("_rest")) & (F.col("_size") > 0)
    ending = ending.withColumn("_extra", nearer.cast("bigint")).drop("_reached")
    others = placed.where(~at_end).withColumn(
        "_extra", ((F.col("_bucket") < F.col("_end")) & (F.col("_size") > 0)).cast("bigint")
    )
    copies = F.col("_whole") + F.col("_extra")
    return others.unionByName(ending).withColumn("_copies", copies)


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    max_epochs: float = 3,
    seed: int = 17,
) -> DataFrame:
    """The mix itself: each document as often as the plan takes it, in the columns of ``docs``.

    A document taken twice is two rows; documents that the plan leaves out have no row. Rows
    that repeat an id are told apart by source and text. Only where a fraction ends within rows
    equal in all three are these numbered.
    """
    names = docs.columns
    if not repeats_ids(docs, id_col):
        plan = _planned(document_sizes(docs, id_col, text_col, source_col), weights, max_epochs, seed)
        plan = plan.where("_copies > 0").select(F.col("_id").alias("_plan_id"), F.col("_copies").alias("_plan_copies"))
        joined = docs.join(plan, docs[id_col].eqNullSafe(plan["_plan_id"])).select(*[docs[c] for c in names], "_plan_copies")
    else:
        plan = _planned(document_sizes(docs, id_col, text_col, source_col, hashes=True), weights, max_epochs, seed)
        plan = plan.groupBy("_id", "_source", "_text_hash").agg(
            F.min("_copies").alias("_fewest"), F.max("_copies").alias("_most"),
            (F.sum("_copies") - F.count("*") * F.min("_copies")).alias("_more"),
        )
        plan = cut_lineage(plan.where("_most > 0").select(
            F.col("_id").alias("_plan_id"), F.col("_source").alias("_plan_source"), F.col("_text_hash").alias("_plan_hash"),
            "_fewest", "_most", "_more",
        ))
        same = (
            docs[id_col].eqNullSafe(plan["_plan_id"]) & docs[source_col].eqNullSafe(plan["_plan_source"])
            & (text_hash(docs[text_col]) == plan["_plan_hash"])
        )
        found = docs.join(plan, same)
        even = found.where("_fewest = _most").select(*[docs[c] for c in names], F.col("_most").alias("_plan_copies"))
        equal = Window.partitionBy("_plan_id", "_plan_source", "_plan_hash").orderBy("_plan_hash")
        uneven = found.where("_fewest < _most").withColumn("_place_of_row", F.row_number().over(equal))
        copies = F.col("_fewest") + (F.col("_place_of_row") <= F.col("_more")).cast("bigint")
        joined = even.unionByName(uneven.select(*[docs[c] for c in names], copies.alias("_plan_copies")).where("_plan_copies > 0"))
    repeated = joined.withColumn("_plan_copy", F.explode(F.sequence(F.lit(1), F.col("_plan_copies").cast("int"))))
    return repeated.select(*names)
