"""Personal data by fixed expressions, extended by bootstrapped contextual patterns.

What the expressions find are the seeds. Each seed, and each other run of tokens with digits or
an at sign (also a written one), is a mention. Its shape, alone and with the word before it, and
its looser shape with the word before or after it are the patterns that induce it. Spark scores the graph of patterns and instances in rounds: a pattern
by the share of its distinct instances that are believed, an instance by the best of its
patterns; seeds stay at one. Patterns of high confidence and enough seeds then add mentions
that the expressions missed, such as a phone number that runs into a card number; the looser
ones also add forms that no expression accepts, such as a phone number without its plus sign.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import keyed_text, text_batches
from tarn.session import cut_lineage

#: Kinds in the order of the contract.
KINDS = ("email", "ip", "card", "phone")
# The expressions of the contract. Look-behinds only keep failed starts cheap.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
MARK = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\S+")
#: What numbers of any form are written with, and tokens that only part their digits.
NUMBER = re.compile(r"[0-9+()./\s-]+")
PARTING = re.compile(r"[+().-]+")
#: Digits of the longest card number; more tokens than these cannot be a mention.
DIGITS = 19
#: Tokens up to which a window is a mention whatever is in it (a counterexample at least).
TOKENS = 3
#: Signs in words or brackets, as in "name (at) host dot org" and 10[.]0[.]0[.]1.
AT = re.compile(r"\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+at\s+", re.IGNORECASE)
DOT = re.compile(r"\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+", re.IGNORECASE)
WRITTEN_DOMAIN = re.compile(rf"[A-Za-z0-9-]+(?:(?:\.|{DOT.pattern})[A-Za-z0-9-]+)+", re.IGNORECASE)
LABEL = re.compile(r"[^\W\d_]+[:=](?=[0-9+(])")


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def passes_luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        doubled = int(digit) * (1 + place % 2)
        total += doubled - 9 * (doubled > 9)
    return total % 10 == 0


def _is_ip(text: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in text.split("."))


def _is_card(text: str) -> bool:
    digits = digits_of(text)
    return 14 <= len(digits) <= 19 and passes_luhn(digits)


def _is_phone(text: str) -> bool:
    return 10 <= len(digits_of(text)) <= 15


CHECKED = {1: (IP, _is_ip), 2: (CARD, _is_card), 3: (PHONE, _is_phone)}


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their at signs so that long runs stay cheap."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        # A failed at sign ends every run that could have begun before it.
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the expressions' valid matches, in order."""
    found = [(start, 0, end) for start, end in emails(text)] if "@" in text else []
    if MARK.search(text):
        for kind, (pattern, valid) in CHECKED.items():
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if valid(m[0])]
    return sorted(found)


def kind_of(text: str) -> int | None:
    """The kind a whole mention would be valid for."""
    if "@" in text:
        found = list(emails(text))
        return 0 if found == [(0, len(text))] else None
    return next((k for k, (p, valid) in CHECKED.items() if p.fullmatch(text) and valid(text)), None)


def shape_of(text: str) -> str:
    """Digits as 9, letters as one a or A a run, all else as it is."""
    return re.sub("[^\\W\\d_A-Z]+", "a", re.sub("[A-Z]+", "A", re.sub("[0-9]", "9", text)))


def plain_form(text: str) -> str:
    """``text`` with the written forms of at sign and dot as signs."""
    return DOT.sub(".", AT.sub("@", text))


def loose_shape(text: str) -> str:
    """What is left of a shape that a kind's other forms share: signs and digit counts in bands."""
    plain = plain_form(text)
    if "@" in plain:
        return "a@a" if list(emails(plain)) == [(0, len(plain))] else "@"
    if IP.fullmatch(plain):
        return "9.9.9.9"
    if not NUMBER.fullmatch(text):
        return re.sub("9+", "9", shape_of(text))
    digits = len(digits_of(text))
    return "9" + next((band for most, band in ((6, "few"), (13, "phone"), (15, "either"), (DIGITS, "card")) if digits <= most), "many")


def open_kinds(text: str) -> list[int]:
    """The kinds a mention that no expression accepts may be in another form; the context has to tell.

    A card keeps its check digit and an address its parts; a phone may lack its country code.
    """
    plain = plain_form(text)
    if plain != text and (kind := kind_of(plain)) in (0, 1):
        return [kind]
    if not NUMBER.fullmatch(text) or IP.fullmatch(text):
        return []
    digits = digits_of(text)
    card = 14 <= len(digits) <= DIGITS and passes_luhn(digits)
    return [2] * card + [3] * (7 <= len(digits) <= 15)


def word_before(text: str, start: int) -> str:
    """The word before a mention, across brackets and quotes that touch it."""
    return (text[max(0, start - 64) : start].rstrip("\"'<[({*").split() or [""])[-1]


def word_after(text: str, end: int) -> str:
    return (text[end : end + 64].lstrip(".,;:!?\"'>])}*").split() or [""])[0]


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A window without quotes, a label such as tel: and brackets that have no partner in it."""
    while start < end:
        value = text[start:end]
        label = LABEL.match(value)
        if label:
            start += label.end()
        elif value[0] in "\"'<[{*" or value[0] == "(" and value.count("(") > value.count(")"):
            start += 1
        elif value[-1] in ".,;:!?\"'>]}*" or value[-1] == ")" and value.count(")") > value.count("("):
            end -= 1
        else:
            break
    return start, end


def written_addresses(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with a written at sign: what stands before it, and the domain after it."""
    for at in AT.finditer(text):
        start = at.start()
        while start > 0 and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        domain = WRITTEN_DOMAIN.match(text, at.end()) if start < at.start() else None
        if domain:
            yield start, domain.end()


def other_mentions(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of neighbouring marked tokens outside the spans, as many as a number can have.

    A window of up to three tokens is a mention whatever is in it. A longer one has to be a
    number of 7 to 19 digits: no other could be of a kind or have the shape of a seed.
    """
    run: list[tuple[int, int]] = []
    place = 0

    def windows() -> Iterator[tuple[int, int]]:
        for i, (start, _) in enumerate(run):
            digits = 0
            for j in range(i, len(run)):
                end = run[j][1]
                digits += len(digits_of(text[run[j][0] : end]))
                if end - start > 320:  # longer than any identifier of a kind can be
                    break
                if j - i >= TOKENS:
                    if digits > DIGITS or not NUMBER.fullmatch(text, run[j][0], end):
                        break
                    if digits < 7 or not NUMBER.fullmatch(text, start, end):
                        continue
                if not PARTING.fullmatch(text, run[j][0], end):
                    yield start, end

    for token in TOKEN.finditer(text):
        start, end = token.span()
        while place < len(taken) and taken[place][2] <= start:
            place += 1
        free = not any(s < end for s, _, e in taken[place : place + 4] if e > start)
        if free and (MARK.search(token[0]) or PARTING.fullmatch(token[0])):
            if run and set(text[run[-1][1] : start]) & set("\n\r\x0b\x0c,;:!?\"'"):
                yield from windows()
                run = []
            run.append((start, start + (len(token[0].rstrip(".,;:!?\"'")) or len(token[0]))))
        else:
            yield from windows()
            run = []
    yield from windows()


def mentions_of(text: str) -> tuple[list, list]:
    """Base spans as (start, kind, end), and mentions as dictionaries; one for each kind it may be."""
    base = base_spans(text)
    written = [m for m in written_addresses(text) if not any(s < m[1] and e > m[0] for s, _, e in base)]
    if not base and not written and not MARK.search(text):
        return base, []
    found = [(start, end, kind, True) for start, kind, end in base]
    windows = {trimmed(text, *m) for m in other_mentions(text, base)} | set(written)
    for start, end in sorted(windows):
        if start < end:
            value = text[start:end]
            kind = kind_of(value)
            found += [(start, end, k, False) for k in ([kind] if kind is not None else open_kinds(value) or [None])]
    return base, [
        {"start": s, "end": e, "kind": k, "seed": seed, "value": text[s:e], "shape": shape_of(text[s:e]),
         "left": word_before(text, s), "right": word_after(text, e), "loose": loose_shape(text[s:e])}
        for s, e, k, seed in found
    ]


def _patterns() -> Column:
    """A mention's patterns: its shape, alone and after a word, and its looser shape next to a word."""
    near = [F.when(F.col(word) != "", F.concat_ws("\x1f", F.lit(name), "loose", word)) for name, word in (("before", "left"), ("after", "right"))]
    exact = [F.concat_ws("\x1f", F.lit("shape"), "shape"), F.concat_ws("\x1f", F.lit("left"), "shape", "left")]
    return F.array_compact(F.array(*exact, *near))


def _mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    mention = pa.struct([
        ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("seed", pa.bool_()),
        ("value", pa.string()), ("shape", pa.string()), ("left", pa.string()), ("right", pa.string()), ("loose", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = [mentions_of(t) for t in batch.column(1).to_pylist()]
            base = [[{"start": s, "kind": k, "end": e} for s, k, e in f[0]] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, pa.list_(span)), pa.array([f[1] for f in found], pa.list_(mention))],
                names=["_id", "_base", "_mentions"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return keyed_text(docs, id_col, text_col).mapInArrow(
        run,
        f"_id {kind}, _base array<struct<start:bigint,kind:int,end:bigint>>, _mentions array<struct<"
        "start:bigint,end:bigint,kind:int,seed:boolean,value:string,shape:string,left:string,right:string,loose:string>>",
    )


def score_patterns(mentions: DataFrame, rounds: int = 3, min_seeds: int = 5) -> DataFrame:
    """``pattern, kind, confidence, seeds`` from ``kind, seed, value, shape, left, right, loose`` mentions.

    Only one-row-per-pattern sums and distinct edges are ever shuffled; a pattern that a third
    of all mentions have is combined in the map tasks.
    """
    edges = cut_lineage(mentions.select("value", F.explode(_patterns()).alias("pattern")).distinct())
    size = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    instances = mentions.where("kind IS NOT NULL").groupBy("value", "kind").agg(F.max("seed").alias("seed"))
    belief = cut_lineage(instances.withColumn("belief", F.col("seed").cast("double")))
    confident = None
    for _ in range(rounds):
        sums = edges.join(belief, "value").groupBy("pattern", "kind").agg(
            F.sum("belief").alias("sum"), F.sum(F.col("seed").cast("bigint")).alias("seeds")
        )
        confident = cut_lineage(
            sums.where(F.col("seeds") >= min_seeds).join(size, "pattern")
            .select("pattern", "kind", (F.col("sum") / (F.col("size") + 1)).alias("confidence"), "seeds")
        )
        best = (
            edges.join(confident, "pattern").groupBy("value", "kind").agg(F.max("confidence").alias("best"))
        )
        belief = cut_lineage(
            belief.drop("belief").join(best, ["value", "kind"], "left")
            .select("value", "kind", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("belief"))
        )
    return confident


def find_personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_confidence: float = 0.7,
    min_seeds: int = 5,
    rounds: int = 3,
) -> DataFrame:
    """``<id>, base, spans`` of every row: arrays of (start, kind, end) in code points, end exclusive.

    ``base`` is what the fixed expressions find, ``spans`` has the added mentions too; ``kind``
    counts in the order of ``KINDS``. An added mention touches no base span and has a pattern of
    at least ``min_confidence`` and ``min_seeds`` seeds; of overlapping ones the first and then
    longest is added. It is valid for its kind, or else of another form that the kind may have
    (``open_kinds``) next to a word that tells the kind. A null text counts as empty. Rows
    that repeat an id each give a row; no rows give no rows; extra columns are not read.
    """
    rows = cut_lineage(
        _mentions(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id())
    )
    every = rows.select("_row", F.explode("_mentions").alias("m")).select("_row", "m.*")
    good = score_patterns(every.drop("_row", "start", "end"), rounds, min_seeds)
    good = good.where(F.col("confidence") >= min_confidence).select("pattern", "kind")
    open_mentions = every.where("NOT seed AND kind IS NOT NULL").select(
        "_row", "start", "end", "kind",
        F.explode(_patterns()).alias("pattern"),
    )
    added = (
        open_mentions.join(good, ["pattern", "kind"]).select("_row", F.struct("start", "kind", "end").alias("span"))
        .groupBy("_row").agg(F.collect_set("span").alias("_added"))
    )
    # First starts first; among equal starts the longest, which a sort of (start, -end) gives.
    ordered = F.array_sort(F.transform("_added", lambda s: F.struct(s["start"], (-s["end"]).alias("back"), s["kind"])))
    chosen = F.aggregate(
        ordered, F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"),
        lambda kept, s: F.when(
            F.coalesce(F.get(kept, F.size(kept) - 1)["end"], F.lit(0)) > s["start"], kept
        ).otherwise(F.concat(kept, F.array(F.struct(s["start"].alias("start"), s["kind"].alias("kind"), (-s["back"]).alias("end"))))),
    )
    joined = rows.select("_row", "_id", "_base").join(added, "_row", "left")
    extra = F.when(F.col("_added").isNull(), F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).otherwise(chosen)
    return joined.select(
        F.col("_id").alias(id_col), F.col("_base").alias("base"), F.array_sort(F.concat("_base", extra)).alias("spans")
    )


def span_text(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
