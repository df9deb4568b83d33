"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

Spark counts the pre-tokens of all texts; the most frequent ``lexicon_words`` of them (a
documented bound on what is broadcast) are compiled, with their ids, into an automaton whose
words share prefixes and suffixes. Each task maps that file into memory and looks up all
distinct words of a batch at once; words outside the lexicon are merged by the rank rules, so
every text is encoded exactly whatever the lexicon holds.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import tempfile
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import keyed_text, most_frequent, text_batches
from tarn.session import cut_lineage

#: Words whose ids a task remembers before it starts anew.
REMEMBERED = 400_000


# -- words of a text -------------------------------------------------------------------------


Spans = list[tuple[int, int]]


class CharacterTables(NamedTuple):
    """What the tokenizers library holds of each character; its parts follow several Unicode versions."""

    #: First and last code points of runs of letters, and of numbers.
    letters: Spans
    numbers: Spans
    #: Lower-case forms that Python's tables lack.
    lower: dict[int, str]
    #: Characters that its composition takes for base characters which compose with nothing.
    apart: str


@lru_cache(1)
def character_tables() -> CharacterTables:
    """The tables, asked of the library once over all code points (some 1,400 spans, so small to send)."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    whole = "".join(points)

    def spans(kind: str) -> Spans:
        runs = pre_tokenizers.Split(Regex(rf"\p{{{kind}}}+"), "removed", invert=True).pre_tokenize_str(whole)
        return [(ord(run[0]), ord(run[-1])) for run, _ in runs]

    cased = [c for c in points if c != "\n"]
    lowered = normalizers.Lowercase().normalize_str("\n".join(cased)).split("\n")
    lower = {ord(c): low for c, low in zip(cased, lowered, strict=True) if low != c.lower()}
    compose = normalizers.NFC().normalize_str
    # A mark between marks of the last and the first class stays there only if it has no class.
    apart = [c for c in points if unicodedata.combining(c) and compose(f"\u0345{c}\u0334") == f"\u0345{c}\u0334"]
    for c in points:
        parts = unicodedata.normalize("NFD", c)
        if len(parts) == 2 and compose(parts) != unicodedata.normalize("NFC", parts):
            apart.append(parts[1])
    return CharacterTables(spans("L"), spans("N"), lower, "".join(apart))


class Characters:
    """Normalizes texts and finds their words by the tables."""

    WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

    def __init__(self, tables: CharacterTables):
        self._tables = tables
        self._apart = re.compile(f"([{re.escape(tables.apart)}])") if tables.apart else None
        self._unlike = np.zeros(0x110000, bool)
        self._unlike[[*map(ord, tables.apart), *tables.lower]] = True
        self._patterns: dict[int, re.Pattern] = {}

    def _pattern(self, top: int) -> re.Pattern:
        """Contractions, runs of letters, single digits, runs of anything else but white space.

        For texts of code points below ``top``: the fewer spans a class has, the faster it fails.
        """
        if top not in self._patterns:
            letters, numbers = (
                "".join(f"\\U{a:08x}-\\U{min(b, top - 1):08x}" for a, b in spans if a < top)
                for spans in (self._tables.letters, self._tables.numbers)
            )
            rest = f"[^{self.WHITE}{letters}{numbers}]+"
            self._patterns[top] = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|{rest}")
        return self._patterns[top]

    def words(self, text: str) -> list[str]:
        """The words of a normalized text."""
        if text.isascii():
            top = 0x80
        else:
            top = 0x10000 if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else 0x110000
        return self._pattern(top).findall(text)

    def normalized(self, text: str) -> str:
        """Composed and lower-cased character by character (no rule for a final sigma)."""
        if not text.isascii():
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            if self._unlike[points].any():
                parts = self._apart.split(text) if self._apart else [text]
                text = "".join(p if i % 2 else unicodedata.normalize("NFC", p) for i, p in enumerate(parts))
                text = text.translate(self._tables.lower)
            else:
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")
        return text.lower()


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Tokens, merge ranks and added tokens of a byte-level BPE file with word ends."""

    def __init__(self, content: bytes, tables: CharacterTables | None = None):
        file = json.loads(content)
        self.characters = Characters(tables or character_tables())
        model = file["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.added.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self.symbols = byte_symbols()
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None

    def words(self, text: str) -> list[str]:
        """Pre-tokens in order; an added token in the text stays one word."""
        if self.added_pattern is None or not self.added_pattern.search(text):
            return self._found(text)
        found: list[str] = []
        for i, part in enumerate(self.added_pattern.split(text)):
            found += [ADDED + part] if i % 2 else self._found(part)
        return found

    def _found(self, text: str) -> list[str]:
        return self.characters.words(self.characters.normalized(text))

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one word of any length by its merges, lowest rank and then leftmost first."""
        if word.startswith(ADDED):
            return (self.added[word[len(ADDED) :]],)
        parts: list[str | None] = [self.symbols[b] for b in word.encode()]
        parts[-1] += self.end
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(self.ranks[pair], i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)) if pair in self.ranks]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or self.ranks.get((parts[i], parts[j])) != rank:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < len(parts):
                    pair = (parts[left], parts[after[left]])
                    if pair in self.ranks:
                        heapq.heappush(heap, (self.ranks[pair], left))
        return tuple(self.ids[p] for p in parts if p is not None)


class Merger:
    """Merges many words at once: a matrix of symbols and the ranks of their neighbouring pairs."""

    #: Words of more bytes go one by one.
    WIDEST = 48

    def __init__(self, vocabulary: Vocabulary):
        self._one_by_one = vocabulary.merge
        ids, end = vocabulary.ids, vocabulary.end
        self._inner = np.array([ids[c] for c in vocabulary.symbols], np.int64)
        self._last = np.array([ids[c + end] for c in vocabulary.symbols], np.int64)
        pairs = np.array([(ids[a] << 32 | ids[b], rank) for (a, b), rank in vocabulary.ranks.items()], np.int64)
        order = np.argsort(pairs[:, 0])
        self._pairs, self._ranks = pairs[order, 0], pairs[order, 1]
        self._made = np.zeros(self._ranks.max() + 1, np.int64)
        self._made[list(vocabulary.ranks.values())] = [ids[a + b] for a, b in vocabulary.ranks]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = np.where((left >= 0) & (right >= 0), left << 32 | right, -1)
        at = np.minimum(np.searchsorted(self._pairs, wanted), len(self._pairs) - 1)
        return np.where(self._pairs[at] == wanted, self._ranks[at], NEVER)

    def merge(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        merged, by_width = {}, {8: [], 16: [], 24: [], self.WIDEST: []}
        for word in words:
            size = len(word) if word.isascii() else len(word.encode())
            if size > self.WIDEST or word.startswith(ADDED):
                merged[word] = self._one_by_one(word)
            else:
                next(group for width, group in by_width.items() if size <= width).append(word)
        for width, group in by_width.items():
            for at in range(0, len(group), 20_000):
                self._merge_block(group[at : at + 20_000], width, merged)
        return merged

    def _merge_block(self, words: list[str], width: int, merged: dict[str, tuple[int, ...]]) -> None:
        encoded = [w.encode() for w in words]
        length = np.fromiter(map(len, encoded), np.int64, len(encoded))
        letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in encoded), np.uint8).reshape(-1, width)
        column, row = np.arange(width), np.arange(len(words))
        symbols = np.where(column < length[:, None], self._inner[letters], -1)
        symbols[row, length - 1] = self._last[letters[row, length - 1]]
        symbols = np.hstack((symbols, np.full((len(words), 1), -1)))
        ranks = self._rank(symbols[:, :-1], symbols[:, 1:])
        while len(row):
            at = ranks.argmin(axis=1)
            here = np.arange(len(row))
            rank = ranks[here, at]
            done = rank == NEVER
            for i, size, ids in zip(row[done].tolist(), length[done].tolist(), symbols[done].tolist(), strict=True):
                merged[words[i]] = tuple(ids[:size])
            going = ~done
            row, length, symbols, ranks, at, rank = (x[going] for x in (row, length, symbols, ranks, at, rank))
            if not len(row):
                break
            here = np.arange(len(row))
            shifted = column >= at[:, None] + 1
            symbols[:, :-1] = np.where(shifted, symbols[:, 1:], symbols[:, :-1])
            ranks[:, :-1] = np.where(shifted[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NEVER
            symbols[here, at] = self._made[rank]
            length -= 1
            ranks[here, at] = self._rank(symbols[here, at], symbols[here, at + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self._rank(symbols[left, at[left] - 1], symbols[left, at[left]])


#: Marks an added token among words; white space, so no word of a text begins with it.
ADDED = " "
NEVER = 1 << 60


# -- the lexicon -----------------------------------------------------------------------------


def compile_lexicon(entries: dict[bytes, tuple[int, ...]]) -> bytes:
    """A minimal acyclic transducer from words to ids, as the bytes of a file.

    Words are added in order and finished states merged with equal ones (same finality, same
    transitions), so suffixes are shared. A transition's output is the number of words that
    sort before it in its state; the outputs on a word's path add up to its position, which
    points into the list of ids.
    """
    register: dict[tuple, int] = {}
    reach: list[int] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(reach)
            reach.append(node[0] + sum(reach[target] for _, target in node[1]))
        return register[key]

    path: list[list] = [[0, []]]  # [final, transitions to finished states], root first
    previous = b""
    words = sorted(w for w in entries if w)
    for word in words:
        shared = len(os.path.commonprefix([previous, word]))
        for depth in range(len(previous), shared, -1):
            path[depth - 1][1].append((previous[depth - 1], freeze(path.pop())))
        path += [[0, []] for _ in range(len(word) - shared)]
        path[-1][0] = 1
        previous = word
    for depth in range(len(previous), 0, -1):
        path[depth - 1][1].append((previous[depth - 1], freeze(path.pop())))
    root = freeze(path[0])
    keys, targets, outputs, finals = array("q"), array("q"), array("q"), array("q", bytes(8 * len(reach)))
    for (final, transitions), state in register.items():  # in order of state
        finals[state], before = final, final
        for label, target in transitions:
            keys.append(state << 8 | label)
            targets.append(target)
            outputs.append(before)
            before += reach[target]
    ids, offsets = array("q"), array("q", [0])
    for word in words:
        ids.extend(entries[word])
        offsets.append(len(ids))
    parts = [keys, targets, outputs, finals, offsets, ids]
    return b"".join(p.tobytes() for p in [array("q", [root, *map(len, parts)]), *parts])


class Lexicon:
    """A compiled lexicon, mapped from a file of the task's own folder (removed once mapped)."""

    def __init__(self, content: bytes):
        with tempfile.TemporaryFile() as file:
            file.write(content)
            file.flush()
            self._map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        whole = np.frombuffer(self._map, np.int64)
        self._root, sizes = int(whole[0]), whole[1:7]
        ends = 7 + np.cumsum(sizes)
        parts = [whole[e - n : e] for n, e in zip(sizes, ends, strict=True)]
        self._keys, self._targets, self._outputs, self._finals, self._offsets, self._ids = parts

    def positions(self, words: list[bytes]) -> np.ndarray:
        """The position of each word, -1 for those it does not hold; all words walk in step."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"".join(words) or b"\0", np.uint8)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(words) else lengths
        state = np.full(len(words), self._root)
        total = np.zeros(len(words), np.int64)
        walking, depth = np.arange(len(words)), 0
        while len(walking) and len(self._keys):
            walking = walking[lengths[walking] > depth]
            wanted = state[walking] << 8 | letters[starts[walking] + depth]
            at = np.minimum(np.searchsorted(self._keys, wanted), len(self._keys) - 1)
            found = self._keys[at] == wanted
            state[walking[~found]] = -1
            walking, at = walking[found], at[found]
            state[walking] = self._targets[at]
            total[walking] += self._outputs[at]
            depth += 1
        if not len(self._keys):
            return np.full(len(words), -1)
        held = (state >= 0) & (self._finals[np.maximum(state, 0)] == 1) & (lengths > 0)
        return np.where(held, total, -1)

    def ids_at(self, position: int) -> tuple[int, ...]:
        return tuple(self._ids[self._offsets[position] : self._offsets[position + 1]].tolist())


class Codec:
    """Encodes and decodes texts with a vocabulary and a lexicon."""

    def __init__(self, vocabulary: bytes, lexicon: bytes, tables: CharacterTables | None = None):
        self.vocabulary = Vocabulary(vocabulary, tables)
        self.lexicon = Lexicon(lexicon)
        self.merger = Merger(self.vocabulary)
        self._known: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: Iterable[str]) -> list[array]:
        documents = [self.vocabulary.words(text) for text in texts]
        if len(self._known) > REMEMBERED:
            self._known.clear()
        fresh = list(set().union(*documents).difference(self._known))
        positions = self.lexicon.positions([w.encode() for w in fresh])
        unseen = []
        for word, position in zip(fresh, positions.tolist(), strict=True):
            if position >= 0:
                self._known[word] = self.lexicon.ids_at(position)
            else:
                unseen.append(word)
        self._known.update(self.merger.merge(unseen))
        known = self._known.__getitem__
        return [array("i", chain.from_iterable(map(known, words))) for words in documents]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens of the ids, special ones included, parted by spaces (the file names no decoder)."""
        return " ".join(map(self.vocabulary.tokens.__getitem__, ids))


# -- Spark -----------------------------------------------------------------------------------


def frequent_words(texts: DataFrame, vocabulary: bytes, most: int) -> list[str]:
    """The most frequent pre-tokens, at most ``most``, over all of ``_text``; each task counts its own first."""

    tables = character_tables()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Vocabulary(vocabulary, tables).words, Counter()

        def counted() -> Iterator[pa.RecordBatch]:
            found = list(counts.items())
            counts.clear()
            for at in range(0, len(found), 50_000):
                names, numbers = zip(*found[at : at + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int64())], names=["_word", "_n"])

        for batch in text_batches(batches):
            for text in batch.column(0).to_pylist():
                counts.update(words(text))
            if len(counts) > 2_000_000:
                yield from counted()
        yield from counted()

    counts = texts.select("_text").mapInArrow(count, "_word string, _n bigint")
    summed = cut_lineage(counts.groupBy("_word").agg(F.sum("_n").alias("_n")))
    return [r["_word"] for r in most_frequent(summed, most)]


def build_lexicon(texts: DataFrame, vocabulary: bytes, lexicon_words: int) -> bytes:
    """The compiled lexicon of the most frequent words of ``_text``."""
    merged = Merger(Vocabulary(vocabulary)).merge(frequent_words(texts, vocabulary, lexicon_words))
    return compile_lexicon({word.encode(): ids for word, ids in merged.items()})


def encode_and_decode(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lexicon_words: int = 100_000,
) -> DataFrame:
    """``<id>, ids array<int>, decoded`` of every row.

    ``tokenizer_path`` is a byte-level BPE file with word ends, read by the driver. Added
    tokens in a text become their id; nothing is truncated or padded. A null text is encoded
    as an empty one: no ids, decoded to an empty text. Rows that repeat an id each give a row;
    no rows give no rows; extra columns are not read.
    """
    with open(tokenizer_path, "rb") as file:
        vocabulary = file.read()
    texts = keyed_text(docs, id_col, text_col)
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((vocabulary, build_lexicon(texts, vocabulary, lexicon_words), character_tables()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*sent.value)
        for batch in text_batches(batches):
            encoded = codec.encode(batch.column(1).to_pylist())
            decoded = pa.array([codec.decode(ids) for ids in encoded], pa.string())
            offsets = np.concatenate(([0], np.cumsum([len(ids) for ids in encoded]))).astype(np.int32)
            values = np.concatenate([np.frombuffer(ids, np.int32) for ids in encoded])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), decoded],
                names=["_id", "_ids", "_decoded"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return texts.mapInArrow(run, f"_id {kind}, _ids array<int>, _decoded string").select(
        F.col("_id").alias(id_col), F.col("_ids").alias("ids"), F.col("_decoded").alias("decoded")
    )


def codec_digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``<id>, n_tokens, ids_sha256, decoded_sha256`` of encoded documents."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        F.col(id_col), F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
