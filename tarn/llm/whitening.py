"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Vectors become integers, each distinct one counts once, and n * sum(y y') - (sum y)(sum y)' is an
integer matrix M, the covariance times n squared. Tasks add up exact partial sums. The polynomial
of M comes from its residues: a task reduces M to Hessenberg form modulo one prime at a time, and
Chinese remaindering joins as many primes as the bound on the coefficients asks for. All roots of
the polynomial are real, so Descartes' count of sign changes after a shift is the exact number of
roots above any point: one task per component isolates its root with it, bisects it to ``BITS``
bits behind the point, and takes the component from the null space of M - root by inverse
iteration in fixed point of the same precision. Eigenvectors are therefore right to double
precision however close their eigenvalues are, up to that resolution.

The driver holds the d x d matrix, the d + 1 coefficients and at most ``components`` axes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.session import cut_lineage

#: Binary places of a root and of the inverse iteration. Roots that agree in all of them are one root of higher multiplicity.
BITS = 256
#: Integer vectors stay below this, so that their floor and their sums are exact.
LIMIT = 1 << 53


@dataclass(frozen=True)
class Axes:
    """``vectors`` (d, k) of unit length by falling ``values`` (of the covariance), with ``explained`` shares."""

    count: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``_id, _y`` = floor(scale * entry) of rows whose vector is whole and finite; shorter ones end in zeros."""
    entry = F.col(f"`{vector_col}`")
    whole = entry.isNotNull() & (F.size(entry) > 0) & F.forall(
        entry, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False))
    )
    scaled = F.transform(entry, lambda c: c.cast("double") * F.lit(float(scale)))
    bound = F.lit("an entry is too large to become an exact integer")
    checked = F.transform(scaled, lambda c: F.when(F.abs(c) < float(LIMIT), F.floor(c)).otherwise(F.raise_error(bound).cast("bigint")))
    kept = vectors.where(whole).select(F.col(f"`{id_col}`").alias("_id"), checked.alias("_y"))
    widths = kept.agg(F.min(F.size("_y")).alias("least"), F.max(F.size("_y")).alias("most")).first()
    if widths["least"] == widths["most"]:
        return kept
    zeros = F.array_repeat(F.lit(0).cast("bigint"), F.lit(widths["most"]) - F.size("_y"))
    return kept.select("_id", F.concat("_y", zeros).alias("_y"))


def rows_of_integers(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def exact_product(rows: np.ndarray) -> np.ndarray:
    """rows' rows as Python integers: in doubles where every sum stays below 2^53, else in integers."""
    most = int(np.abs(rows).max(initial=0))
    if most * most * len(rows) < LIMIT:
        as_double = rows.astype(np.float64)
        return (as_double.T @ as_double).astype(np.int64).astype(object)
    exact = rows.astype(object)
    return exact.T @ exact


def scatter(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """The number of vectors, their sums, and the sums of products; d (d + 3) / 2 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, products = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                rows = rows_of_integers(batch.column(0))
                count += len(rows)
                sums = sums + rows.astype(object).sum(axis=0) if int(np.abs(rows).max()) >= 1 << 40 else sums + rows.sum(axis=0).astype(object)
                products = products + exact_product(rows)
        if not count:
            return
        i, j = np.triu_indices(len(sums))
        at_i = np.concatenate([[-2], np.full(len(sums), -1), i]).astype(np.int32)
        at_j = np.concatenate([[0], np.arange(len(sums)), j]).astype(np.int32)
        values = [count, *sums, *products[i, j]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at_i), pa.array(at_j), pa.array([str(v) for v in values])], names=["i", "j", "v"]
        )

    parts = fit.select("_y").mapInArrow(run, "i int, j int, v string")
    added = parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    width = 1 + max((r["j"] for r in added), default=-1)
    count, sums, products = 0, [0] * width, np.zeros((width, width), object)
    for i, j, v in added:
        if i == -2:
            count = int(v)
        elif i == -1:
            sums[j] = int(v)
        else:
            products[i, j] = products[j, i] = int(v)
    return count, sums, products


def is_prime(n: int) -> bool:
    """Exact below 3.3e24 by these bases."""
    if n < 2 or any(n % p == 0 and n != p for p in (2, 3, 5, 7, 11, 13)):
        return False
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11, 13):
        x = pow(base, odd, n)
        if n == base or x in (1, n - 1):
            continue
        if not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_above(bound: int) -> list[int]:
    """The largest primes below 2^31 whose product exceeds ``bound``."""
    found, product, at = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(at):
            found.append(at)
            product *= at
        at -= 2
    return found


def hessenberg(h: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``h`` modulo ``p`` that is zero below the first subdiagonal."""
    for m in range(1, len(h) - 1):
        nonzero = np.flatnonzero(h[m:, m - 1])
        if not len(nonzero):
            continue
        i = m + int(nonzero[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    return h


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, lowest first, of det(x - matrix) modulo a prime below 2^31."""
    d = len(matrix)
    h = hessenberg((matrix % p).astype(np.int64), p)
    leading = np.zeros((d + 1, d + 1), np.int64)  # of the leading k x k blocks
    leading[0, 0] = 1
    for k in range(1, d + 1):
        leading[k, 1:] = leading[k - 1, :-1]
        below, weights = 1, [int(h[k - 1, k - 1])]
        for i in range(k - 2, -1, -1):
            below = below * int(h[i + 1, i]) % p
            weights.append(int(h[i, k - 1]) * below % p)
        earlier = np.array(weights, np.int64)[:, None] * leading[k - 1 :: -1] % p
        leading[k] = (leading[k] - earlier.sum(axis=0)) % p
    return leading[d]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Exact coefficients, lowest first, of det(x - matrix) for a positive semidefinite integer matrix.

    The elementary symmetric sums of non-negative roots are largest when all are equal, which
    bounds the coefficients by the trace.
    """
    d, trace = len(matrix), sum(int(matrix[i, i]) for i in range(len(matrix)))
    bound = max(math.comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    primes = primes_above(2 * bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(0).to_pylist()
            found = [polynomial_mod(matrix, p).tolist() for p in given]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["p", "c"])

    rows = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(min(len(primes), 64))
    residues = {r["p"]: r["c"] for r in rows.mapInArrow(run, "p bigint, c array<bigint>").collect()}
    product = math.prod(primes)
    parts = [(product // p, pow(product // p, -1, p), residues[p], p) for p in primes]
    found = [sum(c[k] * inverse % p * rest for rest, inverse, c, p in parts) % product for k in range(d + 1)]
    return [c - product if c > product // 2 else c for c in found]


def roots_above(polynomial: list[int], a: int, places: int) -> int:
    """How many roots of a polynomial with real roots alone are above a / 2^places, a >= 0.

    Descartes' rule is exact there: the sign changes after moving the point to 0.
    """
    d = len(polynomial) - 1
    shifted = [c << places * (d - k) for k, c in enumerate(polynomial)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            shifted[k] += a * shifted[k + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(s != t for s, t in zip(signs, signs[1:], strict=False))


def above_zero(polynomial: list[int], a: int, places: int) -> int:
    """Sign of the polynomial at a / 2^places."""
    d, value = len(polynomial) - 1, 0
    for k in range(d, -1, -1):
        value = value * a + (polynomial[k] << places * (d - k))
    return (value > 0) - (value < 0)


def isolated_root(polynomial: list[int], place: int, most: int) -> tuple[int, int, int]:
    """The ``place``-th largest root times 2^BITS, rounded up; its place among equal ones, and how many are equal.

    ``most`` is a power of two above all roots.
    """
    low, high, places = 0, most, 0
    below, above = len(polynomial) - 1, 0  # roots above low, above high
    while below - above > 1 and (places < BITS or high - low > 1):
        if high - low == 1:
            step = min(32, BITS - places)
            low, high, places = low << step, high << step, places + step
        middle = (low + high) // 2
        n = roots_above(polynomial, middle, places)
        if n >= place:
            low, below = middle, n
        else:
            high, above = middle, n
    low, high = low << BITS - places, high << BITS - places
    if below - above == 1:
        # A simple root: the sign changes there and nowhere else between low and high.
        behind = above_zero(polynomial, high, BITS)
        while high - low > 1 and behind:
            middle = (low + high) // 2
            sign = above_zero(polynomial, middle, BITS)
            if sign == behind:
                high = middle
            elif sign:
                low = middle
            else:
                return middle, 1, 1
        return high, 1, 1
    return high, place - above, below - above


class Shifted:
    """LU factors of matrix - root in fixed point of ``BITS`` binary places, with row exchanges."""

    def __init__(self, matrix: np.ndarray, root: int):
        a = np.array([[int(v) << BITS for v in row] for row in matrix], object)
        d = len(a)
        for i in range(d):
            a[i, i] -= root
        self.a, self.steps = a, []
        for k in range(d):
            best = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            if best != k:
                a[[k, best]] = a[[best, k]]
            if not a[k, k]:
                a[k, k] = 1
            factor = (a[k + 1 :, k] << BITS) // a[k, k]
            a[k + 1 :, k + 1 :] -= (factor[:, None] * a[k, k + 1 :]) >> BITS
            self.steps.append((best, factor))

    def solve(self, b: np.ndarray) -> np.ndarray:
        b = b.copy()
        d = len(b)
        for k, (best, factor) in enumerate(self.steps):
            b[k], b[best] = b[best], b[k]
            b[k + 1 :] -= (factor * b[k]) >> BITS
        for k in range(d - 1, -1, -1):
            rest = b[k] - (int((self.a[k, k + 1 :] * b[k + 1 :]).sum()) >> BITS) if k + 1 < d else b[k]
            b[k] = (rest << BITS) // self.a[k, k]
        return b


def scaled(x: np.ndarray) -> np.ndarray:
    """``x`` with its largest entry brought to about 2^BITS."""
    most = max(abs(int(v)) for v in x)
    return np.array([(int(v) << BITS) // most for v in x], object)


def null_vector(matrix: np.ndarray, root: int, member: int) -> np.ndarray:
    """The ``member``-th of orthogonal unit vectors of the null space of matrix - root / 2^BITS, in doubles.

    The sign makes the largest entry positive.
    """
    factors, found = Shifted(matrix, root), []
    for m in range(1, member + 1):
        x = np.array([(1 << BITS) + (((i + 1) * 40503 * m * m) % 65521 << BITS - 17) for i in range(len(matrix))], object)
        for _ in range(3):
            for v in found:
                x = x - (v * int((x * v).sum())) // int((v * v).sum())
            x = scaled(factors.solve(x))
        for v in found:
            x = x - (v * int((x * v).sum())) // int((v * v).sum())
        found.append(scaled(x))
    last = np.array([int(v) / (1 << BITS) for v in found[-1]])
    last /= math.sqrt(math.fsum(last * last))
    return last if last[np.abs(last).argmax()] > 0 else -last


def principal_axes(spark: SparkSession, fit: DataFrame, components: int) -> Axes:
    """The axes of the distinct integer vectors in ``fit._y``; those of eigenvalue 0 are left out."""
    count, sums, products = scatter(fit)
    d = len(sums)
    matrix = count * products - np.outer(np.array(sums, object), np.array(sums, object)) if d else products
    shared = math.gcd(*[int(v) for v in matrix.ravel()]) if d else 0
    if not shared:
        return Axes(count, sums, np.zeros((d, 0)), np.zeros(0), np.zeros(0))
    matrix //= shared
    polynomial = characteristic_polynomial(spark, matrix)
    while polynomial[0] == 0:
        polynomial = polynomial[1:]
    trace = sum(int(matrix[i, i]) for i in range(d))
    most, wanted = 1 << trace.bit_length(), min(components, len(polynomial) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in batch.column(0).to_pylist():
                root, member, _ = isolated_root(polynomial, place, most)
                vector = null_vector(matrix, root, member)
                value = root * shared / (count * count << BITS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place], pa.int32()), pa.array([value]), pa.array([root / (trace << BITS)]), pa.array([vector.tolist()])],
                    names=["place", "value", "share", "vector"],
                )

    places = spark.createDataFrame([(i,) for i in range(1, wanted + 1)], "place int").repartition(wanted)
    rows = sorted(places.mapInArrow(run, "place int, value double, share double, vector array<double>").collect())
    return Axes(
        count, sums, np.array([r["vector"] for r in rows]).T, np.array([r["value"] for r in rows]), np.array([r["share"] for r in rows])
    )


def centred(rows: np.ndarray, axes: Axes) -> np.ndarray:
    """n * y - sums, exact: 64-bit integers where they hold it, else Python integers."""
    most = axes.count * int(np.abs(rows).max(initial=0)) + max(abs(s) for s in axes.sums)
    if most * most * len(axes.sums) < 1 << 62:
        return axes.count * rows - np.array(axes.sums, np.int64)
    return axes.count * rows.astype(object) - np.array(axes.sums, object)


def projected(exact: np.ndarray, axes: Axes) -> np.ndarray:
    return (exact.astype(np.float64) / axes.count) @ (axes.vectors / np.sqrt(axes.values))


def identity_error(fit: DataFrame, axes: Axes) -> float:
    """The largest entry of the whitened fit list's covariance less the identity; k (k + 1) sums reach the driver."""
    k = len(axes.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                w = projected(centred(rows_of_integers(batch.column(0)), axes), axes)
                sums += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], names=["at", "v"])

    added = fit.select("_y").mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((k + 1) * k)
    for at, v in added:
        sums[at] = v
    sums = sums.reshape(k + 1, k) / axes.count
    return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max(initial=0.0))


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64, components: int = 16
) -> DataFrame:
    """``<id>, n, deviation, whitened, explained, identity_error`` of every row with a whole vector.

    Entries become y = floor(scale * entry). Axes are fitted to the ``n`` distinct y vectors,
    covariance with divisor n. ``whitened`` holds (y - mean) on each of the leading ``components``
    unit eigenvectors, over the root of its eigenvalue; ``explained`` the eigenvalues over the
    trace. ``deviation`` is the sum of (n y - sums)^2, an exact decimal(38,0). ``identity_error``
    is the largest entry of whitened's covariance over the distinct vectors less the identity.

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped; vectors
    shorter than the longest end in zeros; an entry of 2^53 or more after scaling is an error.
    Repeated vectors are fitted once, and all their rows returned. Axes of eigenvalue 0 (fewer
    distinct vectors than components, all equal vectors) are left out, so lists may be shorter or
    empty. Equal eigenvalues get orthogonal axes of their space. No rows give no rows; extra
    columns are not read, null and repeated ids are kept row by row.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(integer_vectors(vectors, id_col, vector_col, scale))
    fit = cut_lineage(rows.groupBy("_y").agg(F.lit(1).alias("_one")).select("_y"))
    axes = principal_axes(spark, fit, components)
    error = identity_error(fit, axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            exact = centred(rows_of_integers(batch.column(1)), axes)
            squares = (exact * exact).sum(axis=1)
            deviation = pa.array([str(v) for v in squares]).cast(pa.decimal128(38, 0))
            w = projected(exact, axes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], names=["_id", "deviation", "whitened"])

    kind = vectors.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(run, f"_id {kind}, deviation decimal(38,0), whitened array<double>")
    shares = F.array(*[F.lit(float(s)) for s in axes.explained]).cast("array<double>")
    return found.select(
        F.col("_id").alias(id_col), F.lit(axes.count).cast("bigint").alias("n"), "deviation", "whitened",
        shares.alias("explained"), F.lit(error).alias("identity_error"),
    )
