"""Language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions; each decision has a context tree over the preceding
``depth`` bytes. A node holds the counts of zeros and ones that followed its context in the
training texts and their Krichevsky-Trofimov block probability; the weighted probability of a
node mixes that estimate with the product of its children's. Scoring a byte mixes the
estimates of all depths on its context's path with the weights this gives.

What is learned are the counts of all (context, byte) pairs, gathered by Spark. The tree below
each pair of most recent bytes is one unit of work; the nodes above (at most 257 contexts of
255 decisions) are combined by an aggregate whose size does not depend on the corpus. Texts are
scored bucket by bucket against the pairs and words that occur in the bucket, so no task and
no broadcast holds the whole model.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tarn.llm.common import text_batches
from tarn.session import cut_lineage

#: No byte of a UTF-8 text: stands before and behind each text.
EDGE = b"\xff"
LOG_HALF = math.log(0.5)
#: Rows of a subtree batch; a subtree itself is never split.
SUBTREE_ROWS = 400_000
_SMALL = np.array([[math.lgamma(n + 0.5), math.lgamma(n + 1)] for n in range(16)])


# -- numbers of one task ---------------------------------------------------------------------


def pairs_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) of all positions of lower-cased texts, and how many each text has.

    A number has the most recent byte of the context first, the coded byte last. Each text is
    preceded by ``depth`` edges and followed by one, so it has its bytes plus one positions.
    """
    pad = EDGE * depth
    line = np.frombuffer(b"".join(pad + t.lower() + EDGE for t in texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    keys = np.zeros(len(line) - depth, np.int64)
    for back in range(1, depth + 1):
        keys |= line[depth - back : len(line) - back].astype(np.int64) << 8 * (depth - back + 1)
    keys |= line[depth:]
    starts = np.concatenate(([0], np.cumsum(sizes + depth)[:-1])) if len(texts) else sizes
    inside = np.ones(len(keys), bool)
    for back in range(depth):
        inside[starts[1:] - depth + back] = False
    return keys[inside], sizes


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their summed counts."""
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(count, first) if len(key) else count


def _log_gamma(n: np.ndarray, shift: float) -> np.ndarray:
    x = np.maximum(n, 8) + shift
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < 16, _SMALL[np.minimum(n, 15), 0 if shift == 0.5 else 1], series)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log block probability of the Krichevsky-Trofimov estimate."""
    return _log_gamma(zeros, 0.5) + _log_gamma(ones, 0.5) - _log_gamma(zeros + ones, 1.0) - math.log(math.pi)


def decisions(keys: np.ndarray, counts: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of decision ``bit`` for sorted (context, byte) keys of one depth: key, zeros, ones.

    A node's key is the context followed by the bits of the byte that are already decided.
    """
    held = counts > 0
    keys, counts = keys[held], counts[held]
    node = keys >> (8 - bit)
    first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.empty(0, np.int64)
    if not len(first):
        return node, node, node
    one = (keys >> (7 - bit)) & 1
    return node[first], np.add.reduceat(np.where(one == 0, counts, 0), first), np.add.reduceat(np.where(one == 1, counts, 0), first)


def _parents(nodes: np.ndarray, bit: int) -> np.ndarray:
    """Keys of the same decisions with the oldest byte of the context left out."""
    return nodes >> bit + 8 << bit | nodes & (1 << bit) - 1


def level_keys(keys: np.ndarray, depth: int, level: int) -> np.ndarray:
    """The keys with only the ``level`` most recent bytes of their context."""
    return keys >> 8 * (depth - level) + 8 << 8 | keys & 255


class Forest:
    """Weighted nodes of the depths ``top`` to ``depth`` for complete subtrees.

    ``keys`` are sorted distinct (context, byte) pairs, ``counts`` how often training texts
    have them; pairs of count 0 are there to be scored only.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int):
        self.keys, self.depth, self.top = keys, depth, top
        levels = {level: summed([level_keys(keys, depth, level)], [counts]) for level in range(top, depth + 1)}
        self.nodes: dict[tuple[int, int], tuple] = {}
        for bit in range(8):
            below = None
            for level in range(depth, top - 1, -1):
                node, zeros, ones = decisions(*levels[level], bit)
                estimate = log_kt(zeros, ones)
                if below is None:
                    weighted = estimate
                else:
                    at = np.searchsorted(node, _parents(below[0], bit))
                    split = np.bincount(at, below[1], len(node))
                    weighted = LOG_HALF + np.logaddexp(estimate, split)
                below = (node, weighted)
                own = np.ones(len(node)) if level == depth else np.exp(LOG_HALF + estimate - weighted)
                self.nodes[level, bit] = (node, weighted, own, zeros, ones)

    def roots(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(bit, node, zeros, ones, weighted) of the shallowest level."""
        for bit in range(8):
            node, weighted, _, zeros, ones = self.nodes[self.top, bit]
            yield bit, node, zeros, ones, weighted

    def scores(self, above: dict[tuple[int, int], tuple]) -> np.ndarray:
        """Log10 probability of each pair; ``above`` has the nodes of the levels below ``top``.

        A path ends at its deepest context that training texts have; where they have none at
        all the decision is even.
        """
        total = np.zeros(len(self.keys))
        for bit in range(8):
            one = (self.keys >> (7 - bit)) & 1
            mixed = np.full(len(self.keys), 0.5)
            begun = np.zeros(len(self.keys), bool)
            for level in range(self.depth, -1, -1):
                node, own, zeros, ones = (
                    above[level, bit] if level < self.top else (self.nodes[level, bit][i] for i in (0, 2, 3, 4))
                )
                if not len(node):
                    continue
                wanted = level_keys(self.keys, self.depth, level) >> (8 - bit)
                at = np.minimum(np.searchsorted(node, wanted), len(node) - 1)
                there = node[at] == wanted
                hits = np.where(one == 1, ones[at], zeros[at])
                estimate = (hits + 0.5) / (zeros[at] + ones[at] + 1.0)
                both = own[at] * estimate + (1 - own[at]) * mixed
                mixed = np.where(there, np.where(begun, both, estimate), mixed)
                begun |= there
            total += np.log10(mixed)
        return total


def nodes_above(rows: list[tuple[int, int, int, int, float]], top: int) -> dict[tuple[int, int], tuple]:
    """Nodes of the levels below ``top`` from (bit, node, zeros, ones, weighted children) of level ``top - 1``."""
    above: dict[tuple[int, int], tuple] = {}
    table = np.array([r[:4] for r in rows], np.int64).reshape(-1, 4)
    children = np.array([r[4] for r in rows], np.float64)
    for bit in range(8):
        mine = table[:, 0] == bit
        order = np.argsort(table[mine, 1])
        node, zeros, ones = (table[mine, i][order] for i in (1, 2, 3))
        split = children[mine][order]
        for level in range(top - 1, -1, -1):
            estimate = log_kt(zeros, ones)
            weighted = LOG_HALF + np.logaddexp(estimate, split)
            above[level, bit] = (node, np.exp(LOG_HALF + estimate - weighted), zeros, ones)
            if level:
                node, at = np.unique(_parents(node, bit), return_inverse=True)
                zeros, ones, split = (np.bincount(at, x, len(node)) for x in (zeros, ones, weighted))
                zeros, ones = zeros.round().astype(np.int64), ones.round().astype(np.int64)
    return above


# -- Spark -----------------------------------------------------------------------------------


def _bucket() -> Column:
    """The split of the file that a row is read from; rows that come from no file, by a hash of all they hold."""
    split = F.hash(F.input_file_name(), F.input_file_block_start())
    return F.when(F.input_file_name() != "", split).otherwise(F.pmod(F.hash("_id", "_text"), F.lit(1024)))


def _training_counts(rows: DataFrame, depth: int) -> DataFrame:
    """``_bucket, _key, _word, _n``: the pairs and the words of each bucket and how often training texts have them.

    What only texts outside the training have is there with 0. A word row has no key and a
    pair row no word; the end of a text is the empty word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[int, tuple[list, list]] = {}
        words: dict[int, Counter] = {}

        def flush(bucket: int) -> Iterator[pa.RecordBatch]:
            key, count = summed(*keys.pop(bucket))
            for at in range(0, len(key), 100_000):
                k, n = key[at : at + 100_000], count[at : at + 100_000]
                none = pa.nulls(len(k), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), bucket, np.int32)), pa.array(k), none, pa.array(n)], names=names)
            counts = words.pop(bucket)
            found = list(counts)
            for at in range(0, len(found), 50_000):
                w = found[at : at + 50_000]
                n = [counts[word] for word in w]
                none = pa.nulls(len(w), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), bucket, np.int32)), none, pa.array(w, pa.binary()), pa.array(n, pa.int64())], names=names)

        names = ["_bucket", "_key", "_word", "_n"]
        for batch in text_batches(batches, 1_000_000):
            buckets, training = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            for bucket in np.unique(buckets).tolist():
                held_keys, held_counts = keys.setdefault(bucket, ([], []))
                counts = words.setdefault(bucket, Counter())
                for learn in (True, False):
                    chosen = [texts[i] for i in np.flatnonzero((buckets == bucket) & (training == learn))]
                    if not chosen:
                        continue
                    key, count = np.unique(pairs_of(chosen, depth)[0], return_counts=True)
                    held_keys.append(key)
                    held_counts.append(count if learn else np.zeros_like(count))
                    for text in chosen:
                        found = text.lower().split()
                        counts.update(found if learn else dict.fromkeys(found, 0))
                    counts[b""] += len(chosen) if learn else 0
                if len(held_keys) >= 8:
                    keys[bucket] = tuple([x] for x in summed(held_keys, held_counts))
            if len(keys) > 64:
                for bucket in list(keys):
                    yield from flush(bucket)
        for bucket in list(keys):
            yield from flush(bucket)
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, "_bucket int, _key bigint, _word binary, _n bigint")


def _subtree_batches(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted (key, count) rows in portions that never split the tree below two bytes of context."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        keys = np.concatenate((keys, batch.column(0).to_numpy()))
        counts = np.concatenate((counts, batch.column(1).to_numpy()))
        if len(keys) >= SUBTREE_ROWS:
            cut = np.searchsorted(keys, keys[-1] >> 8 * (depth - 1) << 8 * (depth - 1))
            if cut:
                yield keys[:cut], counts[:cut]
                keys, counts = keys[cut:], counts[cut:]
    if len(keys):
        yield keys, counts


def pair_scores(pairs: DataFrame, depth: int) -> DataFrame:
    """``_key, _log``: log10 probability of each (context, byte) of ``_key, _n``, whose counts are whole."""
    trees = pairs.repartition(F.shiftright("_key", 8 * (depth - 1))).sortWithinPartitions("_key")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _subtree_batches(batches, depth):
            for bit, node, zeros, ones, weighted in Forest(keys, counts, depth, 2).roots():
                columns = [np.full(len(node), bit), _parents(node, bit), zeros, ones, weighted]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bit", "node", "zeros", "ones", "weighted"])

    sums = [F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")]
    # 256 contexts of one byte by 255 decisions: at most 65,280 rows.
    top = trees.mapInArrow(roots, "bit bigint, node bigint, zeros bigint, ones bigint, weighted double")
    rows = [tuple(r) for r in top.groupBy("bit", "node").agg(*sums).collect()]
    above = pairs.sparkSession.sparkContext.broadcast(nodes_above(rows, 2))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _subtree_batches(batches, depth):
            logs = Forest(keys, counts, depth, 2).scores(above.value)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(logs)], names=["_key", "_log"])

    return trees.mapInArrow(scores, "_key bigint, _log double")


def score_documents(
    docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = 5
) -> DataFrame:
    """``<id>, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of every row.

    Learns from the rows where ``training`` holds (null: it does not). Texts are lower-cased
    (A-Z); a null text is an empty one, which has its end only. ``score`` is the log10
    probability of the bytes and the end, ``bits_per_byte`` its code length per coded byte.
    ``base_score`` is the add-one unigram score of words and end. Without training rows every
    decision is even and ``base_score`` is 0. Rows that repeat an id each give a row; no rows
    give no rows; extra columns are not read.
    """
    if not 2 <= depth <= 6:
        raise ValueError("a context and its byte must fit 56 bits, and trees begin at two bytes")
    texts = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        F.coalesce(training, F.lit(False)).alias("_training"),
    )
    texts = texts.select("_id", "_text", _bucket().alias("_bucket"), "_training")
    counted = cut_lineage(_training_counts(texts, depth))
    of_pairs, of_words = counted.where("_word IS NULL"), counted.where("_word IS NOT NULL")
    pairs = cut_lineage(of_pairs.groupBy("_key").agg(F.sum("_n").alias("_n")))
    everywhere = Window.partitionBy("_word")
    first = F.row_number().over(everywhere.orderBy("_bucket")) == 1
    no_key, no_log = F.lit(None).cast("bigint"), F.lit(None).cast("float")
    words = of_words.select(
        "_bucket", no_key.alias("_key"), no_log.alias("_log"), "_word", F.sum("_n").over(everywhere).alias("_n"), first.alias("_first")
    )
    scored = of_pairs.select("_bucket", "_key").join(pair_scores(pairs, depth), "_key")
    lookup = words.unionByName(
        scored.select(
            "_bucket", "_key", F.col("_log").cast("float").alias("_log"), F.lit(None).cast("binary").alias("_word"),
            F.lit(None).cast("bigint").alias("_n"), F.lit(False).alias("_first"),
        )
    )

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Scores of a bucket's texts from the pairs and words of the bucket."""
        is_pair = right.column("_key").is_valid().to_numpy(zero_copy_only=False)
        pair = right.column("_key").drop_null().to_numpy()
        # Looked up by hash: a search in sorted keys costs several times as much per byte of text.
        index = pd.Index(pair)
        logs = right.column("_log").drop_null().to_numpy().astype(np.float64)
        total = right.column("_n").drop_null().to_numpy()
        # A word is counted for the whole corpus in the first of its buckets.
        own = total[right.column("_first").to_numpy()[~is_pair]]
        learned = [int(own.sum()), int(np.count_nonzero(own))]
        counts = dict(zip(right.column("_word").drop_null().to_pylist(), np.log10(total + 1.0).tolist(), strict=True))
        results = []
        for batch in text_batches(left.select(["_id", "_text"]).to_batches(), 1_000_000):
            lines = [t.encode() for t in batch.column(1).to_pylist()]
            wanted, sizes = pairs_of(lines, depth)
            at = index.get_indexer(wanted)
            if (at < 0).any():
                raise RuntimeError("the input was read in other splits the second time")
            sums = np.add.reduceat(logs[at], np.concatenate(([0], np.cumsum(sizes)[:-1])))
            by_word = [np.fromiter(map(counts.__getitem__, t.lower().split() + [b""]), float) for t in lines]
            columns = [
                batch.column(0), pa.array([len(w) for w in by_word], pa.int64()),
                pa.array([int(np.count_nonzero(w)) for w in by_word], pa.int64()),
                pa.array([float(w.sum()) for w in by_word], pa.float64()), pa.array(sums), pa.array(sizes),
                *(pa.array([x] + [0] * (len(lines) - 1), pa.int64()) for x in learned),
            ]
            learned = [0, 0]
            results.append(pa.RecordBatch.from_arrays(columns, names=names))
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(results, schema)

    names = ["_id", "_tokens", "_known", "_base", "_score", "_bytes", "_learned", "_distinct"]
    kind = docs.schema[id_col].dataType
    schema = pa.schema(list(zip(names, [to_arrow_type(kind), pa.int64(), pa.int64(), pa.float64(), pa.float64(), *[pa.int64()] * 3], strict=True)))
    found = cut_lineage(
        texts.select("_id", "_text", "_bucket").groupBy("_bucket").cogroup(lookup.groupBy("_bucket"))
        .applyInArrow(score, f"_id {kind.simpleString()}, _tokens bigint, _known bigint, _base double, _score double, _bytes bigint, _learned bigint, _distinct bigint")
    )
    known = found.agg(F.sum("_learned").alias("n"), F.sum("_distinct").alias("v")).first()
    tokens, distinct = known["n"] or 0, known["v"] or 0
    return found.select(
        F.col("_id").alias(id_col), F.col("_tokens").alias("n_tokens"), F.col("_known").alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("_base") - F.col("_tokens") * F.lit(math.log10(tokens + distinct + 1))).alias("base_score"),
        F.col("_score").alias("score"), (-F.col("_score") / F.col("_bytes") / F.lit(math.log10(2))).alias("bits_per_byte"),
    )
