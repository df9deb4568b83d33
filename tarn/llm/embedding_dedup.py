"""Near-duplicate embeddings by PCA-ordered tiled comparison, exact at any data.

Unit vectors are rotated to their principal axes, so their leading coordinates carry most of a
product. Vectors are put in order of the first axis and cut into blocks; two blocks meet only if
the gap between them on that axis allows the threshold. Two blocks are compared in tiles: the
leading coordinates first, then more for the pairs that the norms of the remaining ones still
let reach the threshold, and the full product in double precision for what is left.

No pair is written: two blocks return the number of links of each vector and a star for each
set that links join. The number of compared blocks grows with the square of the vectors unless
the first axis parts them; that is the price of losing no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.graph.entities import star_rounds
from tarn.operators.windows import running_total
from tarn.session import cut_lineage

#: Vectors of a block and rows of a tile.
BLOCK, TILE = 4096, 512
#: Shares of the coordinates after which pairs are given up.
STEPS = (0.25, 0.5)
#: What rounding may take from a bound; the verdict itself has no slack.
SLACK = 1e-9


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as unit rows in double precision; shorter ones end in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.zeros((len(column), width))
    rows[np.repeat(np.arange(len(column)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def principal_axes(classes: DataFrame, width: int) -> np.ndarray:
    """Axes of the unit vectors' second moments, largest first; ``width`` squared sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                rows = unit_rows(batch.column(0), width)
                moments += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(moments.ravel())], names=["at", "v"])

    sums = classes.select("_vector").mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v"))
    moments = np.zeros(width * width)
    for at, value in sums.collect():
        moments[at] = value
    _, axes = np.linalg.eigh(moments.reshape(width, width))
    return axes[:, ::-1]


def tile_links(a: np.ndarray, b: np.ndarray, ua: np.ndarray, ub: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of a, row of b) with cosine >= threshold; a, b rotated, ua, ub as given, all unit rows."""
    width = a.shape[1]
    steps = [max(1, int(width * s)) for s in STEPS]

    def rest(x: np.ndarray, at: int) -> np.ndarray:
        return np.sqrt((x[:, at:] ** 2).sum(axis=1))

    product = a[:, : steps[0]] @ b[:, : steps[0]].T
    product += np.outer(rest(a, steps[0]), rest(b, steps[0]))
    i, j = np.nonzero(product >= threshold - SLACK)
    del product
    found = []
    for at in range(0, len(i), 200_000):
        p, q = i[at : at + 200_000], j[at : at + 200_000]
        lead = np.einsum("ij,ij->i", a[p, : steps[1]], b[q, : steps[1]])
        able = lead + rest(a, steps[1])[p] * rest(b, steps[1])[q] >= threshold - SLACK
        p, q = p[able], q[able]
        linked = np.einsum("ij,ij->i", ua[p], ub[q]) >= threshold
        found.append((p[linked], q[linked]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def block_links(a: np.ndarray, b: np.ndarray | None, axes: np.ndarray, threshold: float):
    """Links between the unit rows of ``a`` and ``b`` (None: within ``a``), tile by tile.

    Yields (i, j) with i < j in the joint numbering of a's rows, then b's.
    """
    ra = a @ axes
    rb, offset = (ra, 0) if b is None else (b @ axes, len(a))
    ub = a if b is None else b
    for at in range(0, len(a), TILE):
        start = at if b is None else 0
        i, j = tile_links(ra[at : at + TILE], rb[start:], a[at : at + TILE], ub[start:], threshold)
        i, j = i + at, j + start
        if b is None:
            above = i < j
            i, j = i[above], j[above]
        yield i, j + offset


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95
) -> DataFrame:
    """``<id>, n_links, component_id, kept`` of every row.

    Rows link at a cosine of ``threshold`` or more, in double precision. A vector that is null,
    empty, zero or holds null or non-finite numbers links with nothing and is kept. Equal
    vectors are compared once for all; ``n_links`` counts each of the rows. Vectors shorter
    than the longest count as ended by zeros. Rows that repeat an id are vectors of their own
    with one component. The component is the least id that links reach. No rows give no rows;
    extra columns are not read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_vector"))
    finite = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(finite & F.exists("_vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("_usable", usable)
    classes = rows.where("_usable").groupBy("_vector").agg(F.min("_id").alias("_rep"), F.count("*").alias("_copies"))
    classes = cut_lineage(classes.withColumn("_class", F.monotonically_increasing_id()))
    width = classes.agg(F.max(F.size("_vector"))).first()[0] or 1
    axes = classes.sparkSession.sparkContext.broadcast(principal_axes(classes, width))

    def first_axis(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            along = unit_rows(batch.column(3), width) @ axes.value[:, 0] if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(along)], names=[*names, "_along"])

    names = ["_class", "_rep", "_copies", "_vector"]
    kind = dict(classes.dtypes)["_rep"]
    placed = classes.select(*names).mapInArrow(
        first_axis, f"_class bigint, _rep {kind}, _copies bigint, _vector array<double>, _along double"
    )
    ranked = running_total(placed.withColumn("_one", F.lit(1)), "_one", [F.col("_along"), F.col("_class")], name="_rank")
    blocks = cut_lineage(ranked.withColumn("_block", F.floor(F.col("_rank") / BLOCK)).drop("_one", "_rank"))
    # Blocks in order of the first axis; how far a block reaches is a range of blocks.
    gap = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    ends = blocks.groupBy("_block").agg(F.min("_along").alias("lo"), F.max("_along").alias("hi")).orderBy("_block").collect()
    lows, highs = np.array([e["lo"] for e in ends]), np.array([e["hi"] for e in ends])
    last = np.searchsorted(lows, highs + gap, side="right") - 1
    first = np.searchsorted(highs, lows - gap, side="left")
    reach = classes.sparkSession.createDataFrame(
        [(e["_block"], int(f), int(x)) for e, f, x in zip(ends, first, last, strict=True)],
        "_block bigint, _first bigint, _last bigint",
    )
    met = blocks.join(reach, "_block").select(
        "_class", "_copies", "_vector", "_block", F.explode(F.sequence("_first", "_last")).alias("_other")
    )
    met = met.withColumns({"_low": F.least("_block", "_other"), "_high": F.greatest("_block", "_other")})

    def compare(table: pa.Table) -> pa.Table:
        block = table.column("_block").to_numpy()
        low = block == table.column("_low")[0].as_py()
        both = table.take(np.concatenate((np.flatnonzero(low), np.flatnonzero(~low))))
        vectors = unit_rows(both.column("_vector").combine_chunks(), width)
        size = int(low.sum())
        links, label = np.zeros(len(vectors), np.int64), np.arange(len(vectors))
        copies = both.column("_copies").to_numpy()
        parts = (vectors, None) if size == len(vectors) else (vectors[:size], vectors[size:])
        for i, j in block_links(*parts, axes.value, threshold):
            links += np.bincount(i, copies[j], len(links)).astype(np.int64)
            links += np.bincount(j, copies[i], len(links)).astype(np.int64)
            while True:  # the least label of all linked rows, along trees that are flattened
                least = label.copy()
                np.minimum.at(least, label[i], label[j])
                np.minimum.at(least, label[j], label[i])
                least = least[least]
                least = np.minimum(least[label], label)
                if (least == label).all():
                    break
                label = least
        hit = np.flatnonzero(links)
        name = both.column("_class").to_numpy()
        return pa.table({"_class": name[hit], "_links": links[hit], "_star": name[label[hit]]})

    found = cut_lineage(
        met.groupBy("_low", "_high").applyInArrow(compare, "_class bigint, _links bigint, _star bigint")
    )
    counts = found.groupBy("_class").agg(F.sum("_links").alias("_links"))
    edges = found.where("_class <> _star").select(F.col("_class").alias("a"), F.col("_star").alias("b"))
    tops = star_rounds(edges).select(F.col("a").alias("_class"), F.col("b").alias("_top"))
    named = classes.join(tops, "_class", "left").withColumn("_top", F.coalesce("_top", "_class"))
    least = named.groupBy("_top").agg(F.min("_rep").alias("_component"))
    known = (
        named.join(least, "_top").join(counts, "_class", "left")
        .select("_vector", "_component", (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_links"))
    )
    joined = rows.where("_usable").join(known, "_vector").select("_id", "_links", "_component")
    alone = rows.where("NOT _usable").select("_id", F.lit(0).cast("bigint").alias("_links"), F.col("_id").alias("_component"))
    return joined.unionByName(alone).select(
        F.col("_id").alias(id_col), F.col("_links").alias("n_links"), F.col("_component").alias("component_id"),
        F.col("_id").eqNullSafe(F.col("_component")).alias("kept"),
    )
