"""Shards of nearly equal bytes by histogram sort, in DataFrame functions alone.

Rows are ordered by a hash of their text, then of their id, then by row, so equal texts stand
together. A shard is a range of that order. Its ends are found by counting: each round counts the
exact bytes between evenly spaced probes inside the ranges that still hold a wanted end, and keeps
the range between two probes. A round is one aggregate over a narrow table; the driver sees at
most ``PROBES`` sums for each open end. Rows then move once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tarn.session import cut_lineage

#: Probes of the first round, and for each open range of a later one.
FIRST_PROBES, PROBES = 4096, 256
#: Keys are non-negative and below this, so a difference of two never overflows.
SPAN = 1 << 62
KEYS = ("_h_text", "_h_id", "_row")
#: Cells of a shard at least, and the bytes and rows that one more cell stands for.
CELLS, CELL_BYTES, CELL_ROWS = 256, 64 << 20, 1 << 16


@dataclass(frozen=True)
class Range:
    """Rows whose first keys equal ``fixed`` and whose next key is in [low, high)."""

    fixed: tuple[int, ...] = ()
    low: int = 0
    high: int = SPAN
    probes: int = FIRST_PROBES

    @property
    def key(self) -> str:
        return KEYS[len(self.fixed)]

    @property
    def step(self) -> int:
        return max(1, -(-(self.high - self.low) // self.probes))

    def holds(self) -> Column:
        equal = [F.col(k) == v for k, v in zip(KEYS, self.fixed, strict=False)]
        return reduce(Column.__and__, [*equal, F.col(self.key) >= self.low, F.col(self.key) < self.high])

    def probe(self) -> Column:
        """Between which two probes a row is."""
        return F.expr(f"({self.key} - {self.low}L) div {self.step}L")


@dataclass(frozen=True)
class Law:
    """``wanted`` bytes below each splitter, and what may be missed."""

    wanted: tuple[float, ...]
    tolerance: float
    largest: int


def keyed(docs: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    """``docs`` with ``_size`` and the keys of the order, written: every later count sees the same rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = [F.col(f"`{c}`").alias(f"_given_{i}") for i, c in enumerate(docs.columns)]
    return cut_lineage(docs.select(
        *given, (F.octet_length(text) + F.lit(1)).cast("bigint").alias("_size"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), text), 2).alias("_h_text"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`")), 2).alias("_h_id"),
        F.monotonically_increasing_id().alias("_row"),
    ))


def histogram(narrow: DataFrame, ranges: list[Range]) -> dict[Range, list[Row]]:
    """For each range its (probe, rows, bytes, low, high), in order; one aggregate for all."""
    which = reduce(lambda rest, i: F.when(ranges[i].holds(), F.lit(i)).otherwise(rest), range(len(ranges)), F.lit(None))
    probe = reduce(lambda rest, i: F.when(F.col("range") == i, ranges[i].probe()).otherwise(rest), range(len(ranges)), F.lit(None))
    key = reduce(lambda rest, i: F.when(F.col("range") == i, F.col(ranges[i].key)).otherwise(rest), range(len(ranges)), F.lit(None))
    inside = narrow.withColumn("range", which).where("range IS NOT NULL")
    counted = inside.groupBy("range", probe.alias("probe")).agg(
        F.count("*").alias("rows"), F.sum("_size").alias("bytes"), F.min(key).alias("low"), F.max(key).alias("high")
    )
    found: dict[Range, list[Row]] = {r: [] for r in ranges}
    for row in sorted(counted.collect(), key=lambda r: (r["range"], r["probe"])):
        found[ranges[row["range"]]].append(row)
    return found


def narrowed(law: Law, wanted: float, at: Range, base: int, cells: list[Row]) -> tuple[tuple[int, ...] | None, Range | None, int]:
    """The splitter, or else the range in which to go on, with the bytes below that range."""
    for i, cell in enumerate(cells):
        if wanted < base + cell["bytes"] or i == len(cells) - 1:
            break
        base += cell["bytes"]
    after = base + cell["bytes"]
    before_it, behind_it = (*at.fixed, cell["low"]), (*at.fixed, cell["high"] + 1)
    nearest = before_it if wanted - base <= after - wanted else behind_it
    if min(abs(wanted - base), abs(after - wanted)) <= law.tolerance or cell["rows"] == 1:
        return nearest, None, base
    if cell["low"] < cell["high"]:
        return None, Range(at.fixed, cell["low"], cell["high"] + 1, PROBES), base
    # One text alone: whole if that costs no more than a single row can, else split by id, then by row.
    if not at.fixed and cell["bytes"] <= max(law.tolerance, law.largest):
        return nearest, None, base
    return None, Range((*at.fixed, cell["low"]), probes=PROBES), base


def splitters(narrow: DataFrame, shards: int, tolerance: float) -> list[tuple[int, ...]]:
    """The ``shards - 1`` first keys of the shards after the first, each a prefix of ``KEYS``.

    Every splitter has as many bytes below it as wanted, but for ``tolerance`` of a shard or half
    a row; the rounds stop when all do. 62 bits of a key are used up after eight rounds.
    """
    sums = narrow.agg(F.sum("_size").alias("bytes"), F.max("_size").alias("largest")).first()
    total = sums["bytes"] or 0
    if not total:
        return []
    law = Law(tuple(total * i / shards for i in range(1, shards)), tolerance * total / shards, sums["largest"])
    found: dict[int, tuple[int, ...]] = {}
    open_ends = {i: (Range(), 0) for i in range(len(law.wanted))}
    while open_ends:
        cells = histogram(narrow, list(dict.fromkeys(at for at, _ in open_ends.values())))
        for i, (at, base) in list(open_ends.items()):
            splitter, further, below = narrowed(law, law.wanted[i], at, base, cells[at])
            if splitter is None:
                open_ends[i] = (further, below)
            else:
                found[i] = splitter
                del open_ends[i]
    return [found[i] for i in range(len(law.wanted))]


def reached(splitter: tuple[int, ...]) -> Column:
    """Whether a row is at or above the splitter."""
    key, value = F.col(KEYS[len(splitter) - 1]), F.lit(splitter[-1])
    here = key >= value
    for k, v in reversed(list(zip(KEYS, splitter[:-1], strict=False))):
        here = (F.col(k) > v) | ((F.col(k) == v) & here)
    return here


def byte_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, tolerance: float = 0.001, seed: int = 42,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """The rows of ``docs`` with ``size, shard, slot``: shards of nearly equal bytes, in seeded order.

    ``size`` is the text's UTF-8 bytes plus 1 (null and empty: 1), ``shard`` runs from 0, and
    ``slot`` numbers the rows of a shard from 0 without gaps. Each end of a shard is within
    ``tolerance`` of a shard's bytes, or else within half of the row or of the equal texts that
    stand there. Equal texts share a shard as long as that costs no more bytes than one row can;
    larger groups (half of all rows, say) are split by id and, where ids are equal as well, row by
    row. Rows equal in id and text are interchangeable, others fall alike on every run. Null ids
    are one more id. Fewer rows than shards leave shards empty; no rows give no rows. Columns of
    ``docs`` called ``size``, ``shard`` or ``slot`` are replaced; all others stay.

    Within a shard rows are dealt to cells by a hash of text and id, at least 256 of about 64 MB or
    ``cell_rows`` rows at most, and numbered there; a cell's first slot comes from counts of cells,
    so no task sees a whole shard. Only rows that repeat one id and text can overfill a cell: one of
    more than 4 * ``cell_rows`` rows is dealt on by row. The list of those cells is broadcast, at
    most one line for so many rows.
    """
    rows = keyed(docs, id_col, text_col, seed)
    narrow = rows.select("_size", *KEYS)
    shard = reduce(Column.__add__, [reached(s).cast("int") for s in splitters(narrow, shards, tolerance)], F.lit(0))
    totals = narrow.agg(F.count("*").alias("rows"), F.sum("_size").alias("bytes")).first()
    most = max(totals["rows"] // cell_rows, (totals["bytes"] or 0) // CELL_BYTES)
    cells = max(CELLS, -(-most // shards))
    cell = F.pmod(F.xxhash64("_h_text", "_h_id"), F.lit(cells)).cast("int")
    placed = rows.withColumn("_shard", shard).withColumn("_cell", cell).withColumn("_part", F.lit(0))
    full = cut_lineage(
        placed.groupBy("_shard", "_cell").agg(F.count("*").alias("_rows")).where(F.col("_rows") > 4 * cell_rows)
        .select("_shard", "_cell", F.ceil(F.col("_rows") / cell_rows).cast("int").alias("_parts"))
    )
    if not full.isEmpty():
        part = F.pmod(F.xxhash64("_row"), F.coalesce("_parts", F.lit(1))).cast("int")
        placed = placed.drop("_part").join(F.broadcast(full), ["_shard", "_cell"], "left").withColumn("_part", part).drop("_parts")
    at = ["_shard", "_cell", "_part"]
    counts = placed.select(*at).groupBy(*at).agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy("_shard").orderBy("_cell", "_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*at, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy(*at).orderBy(*KEYS))
    numbered = placed.withColumn("_place", inside).join(firsts, at)
    given = [F.col(f"_given_{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ("size", "shard", "slot")]
    return numbered.select(
        *given, F.col("_size").alias("size"), F.col("_shard").alias("shard"),
        (F.col("_first") + F.col("_place") - 1).cast("bigint").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str, codec: str = "zstd") -> None:
    """A folder ``shard=<n>`` for each shard; the files' rows carry their slot."""
    sharded.write.partitionBy("shard").option("compression", codec).parquet(path)
