"""Line deduplication by an exact set-similarity join with prefix, positional and length filters.

A line is the set of its words, in the order of their rarity over all texts. Two sets of a
Jaccard similarity of ``threshold`` have sizes within the threshold's ratio, share a word among
their rarest few (the prefix), and have enough words left behind the first shared one (the
position). Each word flips one of 128 bits of its set; sets whose bits differ in more places than
their words may are no pair either. Pairs that pass these filters are verified on their words.
Words that occur once in all texts fill a prefix but are in no group.

Equal sets are joined once for all. Groups of up to ``WHOLE`` rows are compared whole, larger ones
row by row with all earlier rows of the group, which a task holds. A row names few candidates per
round, so pairs are never written out in the square of a group. Sets without a match after a
round come back for their next candidates until they have none, so nothing is lost.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import keyed_text, most_frequent, repeats_ids, text_batches
from tarn.session import cut_lineage

#: Earlier candidates that a row names at once; in the first round, after which few sets are open, and how many times more in each further one.
AT_ONCE, AT_FIRST, MORE = 32, 4, 32
#: Rows of the groups that are compared whole, and about how many rows are compared at once.
WHOLE, PORTION = 256, 100_000
#: Earlier rows of a large group that a row is compared with at once.
BLOCK = 4096
#: Words that are sent to the tasks in order; all others are rarer.
FREQUENT = 65_536
#: Of the rarer words, bits of a hash tell which counts they reach: 8 MB for each, at any size.
LEVELS, BITS = (2, 4, 8), 26
#: What tells a set: the place of the first line that has it.
PLACE = ["_id", "_line", "_text_hash"]
#: Words whose place a task remembers before it starts anew.
REMEMBERED = 1_000_000


def words_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of a batch of texts: lines in each, words in each line, and the words as places in a list of distinct ones."""
    lines = pc.split_pattern(texts.cast(pa.large_binary()), b"\n")
    split = pc.ascii_split_whitespace(pc.list_flatten(lines).cast(pa.large_string()))
    row = pc.list_parent_indices(split).to_numpy()
    words = pc.list_flatten(split)
    some = pc.not_equal(words, pa.scalar("", pa.large_string()))  # white space at the ends leaves empty words
    words = words.filter(some).dictionary_encode()
    counts = np.bincount(row[some.to_numpy(zero_copy_only=False)], minlength=len(split))
    distinct = words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    return pc.list_value_length(lines).to_numpy(), counts, words.indices.to_numpy(), distinct


def word_counts(texts: DataFrame) -> DataFrame:
    """``_word, _n`` over all of ``_text``; each task counts its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def counted() -> Iterator[pa.RecordBatch]:
            words = list(counts)
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                numbers = pa.array([counts[w] for w in part], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), numbers], names=["_word", "_n"])
            counts.clear()

        for batch in text_batches(batches):
            for text in batch.column(0).to_pylist():
                counts.update(text.encode().split())
            if len(counts) > 1_000_000:
                yield from counted()
        yield from counted()

    counts = texts.select("_text").mapInArrow(run, "_word binary, _n bigint")
    return cut_lineage(counts.groupBy("_word").agg(F.sum("_n").alias("_n")))


def bits_at(rows: DataFrame, place: Column, conditions: list[Column]) -> list[bytes]:
    """For each condition a set of 2 ** ``BITS`` bits: the places of the rows that meet it."""
    at = place + 1
    parts = rows.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(
        *[F.bitmap_construct_agg(F.when(c, F.bitmap_bit_position(at))).alias(f"bits_{i}") for i, c in enumerate(conditions)]
    )
    found = [bytearray(1 << BITS - 3) for _ in conditions]
    for row in parts.toLocalIterator():
        start = (row["part"] - 1) * 4096
        for i, bits in enumerate(found):
            bits[start : start + 4096] = row[f"bits_{i}"]
    return [bytes(bits) for bits in found]


class Places:
    """A word's place in the order of rarity: its level and hash, or its rank among the frequent."""

    def __init__(self, frequent: list[bytes], bits: list[bytes]):
        self._frequent = {word: len(LEVELS) + 1 << 60 | i for i, word in enumerate(frequent)}
        self._bits = [np.frombuffer(b, np.uint8) for b in bits]
        self._known = dict(self._frequent)

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self._known) > REMEMBERED:
            self._known = dict(self._frequent)
        known = self._known
        fresh = list(set(words).difference(known))
        if fresh:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, fresh, repeat(42)), np.uint64, len(fresh))
            at = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
            level = sum((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(np.int64) for bits in self._bits)
            places = level << 60 | (hashes >> np.uint64(4)).astype(np.int64)
            known.update(zip(fresh, places.tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


def line_sets(
    counts: np.ndarray, word: np.ndarray, distinct: list[bytes], places: Places, threshold: float
) -> tuple[np.ndarray, ...]:
    """For each line (of as many words, given as places in a list) the hash and size of its word set, how many
    words of its prefix occur only there, and its 128 bits; then the other words of all prefixes, folded to 32
    bits, and their number in each line."""
    place, rank = np.unique(places.of(distinct), return_inverse=True)
    width = np.int64(len(place).bit_length())
    # Lines and, in each, distinct words in the order of rarity.
    both = np.sort(np.repeat(np.arange(len(counts)) << width, counts) | rank[word])
    both = both[np.concatenate(([True], both[1:] != both[:-1]))[: len(both)]]
    line, place = both >> width, place[both & (1 << width) - 1]
    size = np.bincount(line, minlength=len(counts))
    start = np.cumsum(size) - size
    mixed = _mixed(place)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
    hashes = _mixed((sums[start + size] - sums[start]) ^ size.astype(np.uint64) << np.uint64(40)).view(np.int64)
    flipped = np.uint64(1) << (mixed & np.uint64(63))
    upper = (mixed >> np.uint64(6) & np.uint64(1)).astype(bool)
    bits = np.zeros((2, len(counts)), np.uint64)
    some = np.flatnonzero(size)
    for half, mine in zip(bits, (~upper, upper), strict=True):
        if len(some):
            half[some] = np.bitwise_xor.reduceat(np.where(mine, flipped, np.uint64(0)), start[some])
    needed = np.ceil(threshold * size - 1e-9).astype(np.int64)
    kept = size - needed + np.minimum(1, needed)
    alone = np.minimum(np.bincount(line, place >> 60 == 0, len(counts)).astype(np.int64), kept)
    within = np.arange(len(line)) - start[line]
    prefix = place[(within >= alone[line]) & (within < kept[line])]
    return hashes, size, alone, bits.view(np.int64), (prefix ^ prefix >> 31).astype(np.uint32).view(np.int32), kept - alone


def _lines(texts: DataFrame, known: tuple[list[bytes], list[bytes]], threshold: float) -> DataFrame:
    """``_id, _line, _text_hash, _set, _size, _low, _high, _alone, _prefix`` of all lines that have words."""
    sent = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(*sent.value)
        for batch in text_batches(batches, 2_000_000):
            counts, *words = words_in(batch.column(1))
            hashes, size, alone, bits, prefix, more = line_sets(*words, places, threshold)
            rows = pa.array(np.repeat(np.arange(len(counts)), counts))
            number = np.concatenate([np.arange(c) for c in counts]).astype(np.int32)
            ends = np.concatenate(([0], np.cumsum(more))).astype(np.int32)
            found = pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), pa.array(number), batch.column(2).take(rows), pa.array(hashes),
                 pa.array(size.astype(np.int32)), pa.array(bits[0]), pa.array(bits[1]), pa.array(alone.astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(prefix))],
                names=[*PLACE, "_set", "_size", "_low", "_high", "_alone", "_prefix"],
            )
            yield found.filter(pa.array(size > 0))

    kind = texts.schema["_id"].dataType.simpleString()
    return texts.select("_id", "_text", "_text_hash").mapInArrow(
        run, f"_id {kind}, _line int, _text_hash bigint, _set bigint, _size int, _low bigint, _high bigint, _alone int, _prefix array<int>"
    )


def _able(size: np.ndarray, other: np.ndarray, at: np.ndarray, place: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether pairs that share a word at these places pass the length and position filters, and
    how many words they must share. Before the word they share at most as many as the lower
    place, behind it at most what the shorter rest holds."""
    needed = np.ceil(threshold / (1 + threshold) * (size + other) - 1e-9)
    most = np.minimum(at, place) + np.minimum(size - at, other - place)
    return (np.minimum(size, other) >= threshold * np.maximum(size, other) - 1e-9) & (most >= needed), needed


def _near(bits: np.ndarray, other: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether bits differ in at most ``apart`` places; words that two sets do not share change at most one place each."""
    return np.bitwise_count(bits ^ other).sum(axis=0, dtype=np.int64) <= apart


def group_candidates(
    no: np.ndarray, size: np.ndarray, at: np.ndarray, threshold: float, skip: int,
    bits: np.ndarray | None = None, wanted: np.ndarray | None = None, most: int = AT_ONCE,
):
    """(row, earlier row) of one group sorted by ``no``: candidates ``skip`` to ``skip + most`` of
    each (wanted) row, and the rows that have more."""
    rows, earlier, more = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
    for i in range(1, len(no)) if wanted is None else np.flatnonzero(wanted).tolist():
        found: list[int] = []
        for start in range(0, i, BLOCK):
            part = slice(start, min(i, start + BLOCK))
            able, needed = _able(size[part], size[i], at[part], at[i], threshold)
            able = np.flatnonzero(able & (no[part] < no[i]))
            if bits is not None and len(able):
                able = able[_near(bits[:, part][:, able], bits[:, i, None], size[part][able] + size[i] - 2 * needed[able])]
            found += (able + start).tolist()
            if len(found) > skip + most:
                more.append(i)
                break
        chosen = np.array(found[skip : skip + most], np.int64)
        rows.append(np.full(len(chosen), i))
        earlier.append(chosen)
    return np.concatenate(rows), np.concatenate(earlier), np.array(more, np.int64)


def whole_candidates(
    within: np.ndarray, size: np.ndarray, at: np.ndarray, threshold: float, skip: int, bits: np.ndarray, wanted: np.ndarray, most: int
):
    """The same for many small groups at once; ``within`` numbers the rows of each from 0."""
    found = [(np.empty(0, np.int64),) * 2]
    i = np.flatnonzero(wanted)
    for lag in range(1, int(within.max(initial=0)) + 1):
        i = i[within[i] >= lag]
        j = i - lag
        able, needed = _able(size[i], size[j], at[i], at[j], threshold)
        a, b = i[able], j[able]
        near = _near(bits[:, a], bits[:, b], size[a] + size[b] - 2 * needed[able])
        found.append((a[near], b[near]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    rows, first, counts = np.unique(i, return_index=True, return_counts=True)
    rank = np.arange(len(i)) - np.repeat(first, counts)
    chosen = (rank >= skip) & (rank < skip + most)
    return i[chosen], j[chosen], rows[counts > skip + most]


def candidates(postings: DataFrame, threshold: float, skip: int, most: int) -> DataFrame:
    """Named pairs of sets, a row for each word they share in their prefixes.

    ``_q*, _t*``: the places of a set and of an earlier one. Without ``_t_line``: a word
    (``_word``) in which the set has more.
    """
    spread = postings.repartition("_word").sortWithinPartitions("_word", *PLACE)
    names = [f"_{x}{c}" for x in "qt" for c in PLACE] + ["_word"]

    def portion(rows: pa.RecordBatch) -> pa.RecordBatch:
        word, shape, low, high = (rows.column(c).to_numpy() for c in ("_word", "_shape", "_low", "_high"))
        wanted = rows.column("_open").to_numpy(zero_copy_only=False)
        size, at, bits = shape >> 32, shape & 0xFFFFFFFF, np.stack((low, high)).view(np.uint64)
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        counts = np.diff(np.append(first, len(word)))
        within = np.arange(len(word)) - np.repeat(first, counts)
        small = np.repeat(counts <= WHOLE, counts)
        found = [whole_candidates(np.where(small, within, 0), size, at, threshold, skip, bits, wanted, most)]
        for s, n in zip(first[counts > WHOLE], counts[counts > WHOLE], strict=True):
            part = slice(s, s + n)
            group = group_candidates(within[part], size[part], at[part], threshold, skip, bits[:, part], wanted[part], most)
            found.append(tuple(x + s for x in group))
        i, j, more = (np.concatenate(x) for x in zip(*found, strict=True))
        left = pa.array(np.concatenate((i, more)))
        right = pa.array(np.concatenate((j, more)), mask=np.arange(len(left)) >= len(i))
        marker = pa.array(np.concatenate((i, more)), mask=np.arange(len(left)) < len(i))
        columns = [rows.column(c).take(x) for x in (left, right) for c in PLACE] + [rows.column("_word").take(marker)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, enough = 0, PORTION
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < enough:
                continue
            rows = pa.concat_batches(held)
            word = rows.column("_word").to_numpy()
            cut = int(np.searchsorted(word, word[-1]))
            if cut:
                yield portion(rows.slice(0, cut))
            held, count = [rows.slice(cut)], len(word) - cut
            enough = max(PORTION, 2 * count)
        if count:
            yield portion(pa.concat_batches(held))

    kind = postings.schema["_id"].dataType.simpleString()
    places = ", ".join(f"_{x}_id {kind}, _{x}_line int, _{x}_text_hash bigint" for x in "qt")
    return spread.select("_word", *PLACE, "_shape", "_low", "_high", "_open").mapInArrow(run, f"{places}, _word int")


def _place(prefix: str) -> list[str]:
    return [f"{prefix}{c}" for c in PLACE]


def _as(prefix: str, was: str = "") -> list[Column]:
    """The columns of a place under another prefix."""
    return [F.col(f"{was}{c}").alias(f"{prefix}{c}") for c in PLACE]


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)])


def _words_of(needed: DataFrame, texts: DataFrame) -> DataFrame:
    """The needed places with their distinct ``_words`` joined by spaces, read again from the texts.

    A set of bits of fixed size tells which lines may be needed, so the other texts stay where they are.
    """
    mask = (1 << BITS) - 1
    doc = F.shiftrightunsigned(F.xxhash64("_id", "_text_hash"), 64 - BITS)
    place = doc.bitwiseXOR((F.col("_line").cast("bigint") * 40503).bitwiseAND(mask))
    sent = texts.sparkSession.sparkContext.broadcast(bits_at(needed, place, [F.lit(True)])[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        for batch in text_batches(batches, 2_000_000):
            lines = [t.encode().split(b"\n") for t in batch.column(1).to_pylist()]
            counts = [len(part) for part in lines]
            row = np.repeat(np.arange(len(lines)), counts)
            number = np.concatenate([np.arange(c) for c in counts])
            at = batch.column(3).to_numpy()[row] ^ number * 40503 & mask
            hit = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            row, number = row[hit], number[hit]
            words = [b" ".join(set(lines[r][n].split())).decode() for r, n in zip(row.tolist(), number.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), batch.column(2).take(pa.array(row)),
                 pa.array(words, pa.string())],
                names=[*PLACE, "_words"],
            )

    kind = texts.schema["_id"].dataType.simpleString()
    read = texts.select("_id", "_text", "_text_hash", doc.alias("_doc")).mapInArrow(
        run, f"_id {kind}, _line int, _text_hash bigint, _words string"
    )
    wanted = needed.select(*_as("_n"))
    # A copied row has its lines twice.
    return read.join(wanted, _same(PLACE, _place("_n")), "left_semi").dropDuplicates(PLACE)


def _verified(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """The places ``_q*`` of the pairs whose words have the similarity."""
    left = words.select(*_as("_a"), F.col("_words").alias("_left"))
    right = words.select(*_as("_b"), F.col("_words").alias("_right"))
    one, other = F.split("_left", " "), F.split("_right", " ")
    shared = F.size(F.array_intersect(one, other))
    union = F.size(one) + F.size(other) - shared
    joined = pairs.join(left, _same(_place("_q"), _place("_a"))).join(right, _same(_place("_t"), _place("_b")))
    return joined.where(shared >= F.lit(threshold) * union - F.lit(1e-9)).select(*_place("_q")).distinct()


def matched_sets(sets: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The places ``_q*`` of the sets that an earlier set is similar to."""
    postings = sets.select(*PLACE, "_size", "_alone", "_low", "_high", F.posexplode("_prefix").alias("_at", "_word"))
    shape = F.shiftleft(F.col("_size").cast("bigint"), 32).bitwiseOR((F.col("_at") + F.col("_alone")).cast("bigint"))
    postings = postings.select("_word", *PLACE, shape.alias("_shape"), "_low", "_high", F.lit(True).alias("_open"))
    matched, skip, most = None, 0, AT_FIRST
    q, t = _place("_q"), _place("_t")
    while True:
        named = cut_lineage(candidates(postings, threshold, skip, most))
        # Words of one set that fold to the same 32 bits name the set itself.
        pairs = cut_lineage(named.where(F.col("_t_line").isNotNull() & ~_same(q, t)).select(*q, *t).distinct())
        needed = pairs.select(*_as("", "_q")).union(pairs.select(*_as("", "_t"))).distinct()
        words = cut_lineage(_words_of(needed, texts))
        # The earliest candidate of each set first; the rest only for sets that it leaves open.
        earliest = pairs.groupBy(*q).agg(F.min(F.struct(*t)).alias("_t")).select(*q, "_t.*")
        found = cut_lineage(_verified(earliest, words, threshold))
        done = found.select(*_as("_d", "_q"))
        open_pairs = pairs.join(done, _same(q, _place("_d")), "left_anti")
        found = cut_lineage(found.unionByName(_verified(open_pairs, words, threshold)))
        matched = found if matched is None else matched.unionByName(found)
        done = matched.select(*_as("_d", "_q"))
        more = cut_lineage(named.where("_t_line IS NULL").join(done, _same(q, _place("_d")), "left_anti").select(*_as("_m", "_q"), F.col("_word").alias("_more")))
        if more.isEmpty():
            return matched
        postings = postings.join(more.select(F.col("_more").alias("_word")).distinct(), "_word", "left_semi").drop("_open")
        still = (F.col("_word") == F.col("_more")) & _same(PLACE, _place("_m"))
        postings = cut_lineage(postings.join(more.distinct(), still, "left").withColumn("_open", F.col("_more").isNotNull()).drop("_more", *_place("_m")))
        skip, most = skip + most, most * MORE


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, frequent: int = FREQUENT
) -> DataFrame:
    """``<id>, n_lines, removed`` of every row: the numbers (from 0) of its lines that repeat an earlier one.

    Lines end at line feeds. A line is removed if an earlier line, in the order of id and line
    number with null ids first, has a Jaccard similarity of ``threshold`` or more of their
    sets of words, copies included; whether that line is itself removed does not matter. Blank
    lines are kept and match nothing; a null text is one blank line. Rows that repeat an id
    and text are one document and get the same result. No rows give no rows; extra columns
    are not read.
    """
    if not 0.5 <= threshold <= 1:
        raise ValueError("the threshold must be between 0.5 and 1")
    texts = keyed_text(docs, id_col, text_col)
    # Ids tell documents apart; only where rows repeat one their texts are needed for it.
    texts = texts.withColumn("_text_hash", F.xxhash64("_text") if repeats_ids(docs, id_col) else F.lit(0).cast("bigint"))
    counts = word_counts(texts)
    place = F.shiftrightunsigned(F.xxhash64("_word"), 64 - BITS)
    known = [bytes(r["_word"]) for r in most_frequent(counts, frequent)], bits_at(counts, place, [F.col("_n") >= n for n in LEVELS])
    lines = _lines(texts, known, threshold)
    firsts = lines.groupBy("_set", "_size", "_low", "_high").agg(F.min(F.struct(*PLACE, "_alone", "_prefix")).alias("_first"))
    sets = cut_lineage(firsts.select("_first.*", "_size", "_low", "_high"))
    matched = matched_sets(sets, texts, threshold)
    # The first line of a set that matches nothing stays; blank lines too, all others go.
    kept = sets.select(*PLACE).join(matched, _same(PLACE, _place("_q")), "left_anti")
    by_text = kept.groupBy(F.col("_id").alias("_of"), F.col("_text_hash").alias("_of_hash")).agg(F.collect_list("_line").alias("_kept"))
    split = F.split("_text", "\n", -1)
    blank = F.transform(split, lambda line, i: F.when(line.rlike(r"\A[ \t\x0B\f\r]*\z"), i))
    each = texts.select("_id", "_text_hash", F.size(split).alias("_lines"), F.array_compact(blank).alias("_blank"))
    joined = each.join(by_text, _same(["_id", "_text_hash"], ["_of", "_of_hash"]), "left")
    staying = F.concat("_blank", F.coalesce("_kept", F.array().cast("array<int>")))
    return joined.select(
        F.col("_id").alias(id_col), F.col("_lines").cast("bigint").alias("n_lines"),
        F.array_except(F.sequence(F.lit(0), F.col("_lines") - 1), staying).alias("removed"),
    )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` in its own columns, with the removed lines cut from the text (ids are taken to be unique)."""
    gone = repeated_lines(docs, id_col, text_col, **options).select(F.col(id_col).alias("_gone_id"), F.col("removed").alias("_gone"))
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone["_gone_id"]))
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda _, i: ~F.array_contains("_gone", i))
    return joined.withColumn(text_col, F.array_join(kept, "\n")).select(*docs.columns)
