"""Whitening by exact principal components.

Components become integers, so the scatter matrix is an exact integer matrix M = n^2 V (V the covariance).  Its characteristic
polynomial is found modulo many primes by Hessenberg reduction, one Spark task for some primes each, and put together by Chinese
remaindering; the prime count follows from a bound of the coefficients.  All its roots are real, so the sign changes of a shifted
polynomial count the roots above a point exactly: bisection isolates the largest ones, with their multiplicities, to many more
digits than a double.  Each component is the null vector of M - root, by inverse iteration in long fixed-point numbers.

The driver sees the matrix, the polynomial and the components: d x d numbers for vectors of d components, at any row count.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.tables import ship_package

#: Bits to which a root is found, and of the fixed-point numbers of the inverse iteration.
ROOT_BITS, SOLVE_BITS = 110, 384
LONG = 2**63 - 1


# ---------------------------------------------------------------- polynomial

def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``top`` (at most 2**31)."""
    small = [p for p in range(2, 1 << 16) if all(p % q for q in range(2, math.isqrt(p) + 1))] if count else []
    out: list[int] = []
    end = top
    while len(out) < count and end > 1 << 17:
        start = end - (1 << 16)
        alive = np.ones(1 << 16, bool)
        for p in small:
            alive[(-start) % p::p] = False
        out += [start + int(i) for i in np.flatnonzero(alive)[::-1]]
        end = start
    return out[:count]


def charpoly_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(xI - matrix) modulo ``p`` < 2**31, constant first, by similarity to Hessenberg form."""
    h = matrix.astype(np.int64) % p
    n = len(h)
    for k in range(n - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        i = k + 1 + int(below[0])
        if i != k + 1:
            h[[i, k + 1]] = h[[k + 1, i]]
            h[:, [i, k + 1]] = h[:, [k + 1, i]]
        u = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * u % p).sum(axis=1)) % p
    polys = np.zeros((n + 1, n + 1), np.int64)
    polys[0, 0] = 1
    for m in range(n):
        new = np.zeros(n + 1, np.int64)
        new[1:] = polys[m, :-1]
        new = (new - h[m, m] * polys[m]) % p
        run = 1
        for i in range(m - 1, -1, -1):
            run = run * int(h[i + 1, i]) % p
            if not run:
                break
            new = (new - int(h[i, m]) * run % p * polys[i]) % p
        polys[m + 1] = new
    return polys[n]


def primes_needed(trace: int, d: int) -> int:
    """Primes of at least 30 bits whose product exceeds twice every coefficient.

    The eigenvalues are not negative, so the k-th coefficient is at most binomial(d, k) (trace / d)^k < (1 + trace / d)^d.
    """
    return ((trace // d + 2) ** d * 2).bit_length() // 30 + 1


def chinese(primes: list[int], rests: list[np.ndarray]) -> list[int]:
    """The integers of least size that leave ``rests`` modulo ``primes``."""
    whole = math.prod(primes)
    out = [0] * len(rests[0])
    for p, r in zip(primes, rests):
        part = whole // p
        factor = part * pow(part % p, -1, p)
        for i, x in enumerate(r.tolist()):
            out[i] += x * factor
    return [x - whole if 2 * x > whole else x for x in (x % whole for x in out)]


# ---------------------------------------------------------------- roots

def _above(poly: list[int], at: int) -> int:
    """How many roots (all are real), each as often as it counts, lie above ``at``: sign changes of poly(x + at)."""
    c = list(poly)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(poly: list[int], at: int) -> int:
    v = 0
    for c in reversed(poly):
        v = v * at + c
    return (v > 0) - (v < 0)


def largest_roots(poly: list[int], k: int) -> list[tuple[Fraction, int]]:
    """(root, multiplicity) of the largest positive roots, falling, until ``k`` are counted, for a polynomial with only real
    roots, none negative.  Roots that agree in their first :data:`ROOT_BITS` bits count as one."""
    zeros = next(i for i, c in enumerate(poly) if c)
    core = poly[zeros:]
    d = len(core) - 1
    if not d:
        return []
    top = -core[-2]  # the sum of the roots
    bits = max(0, ROOT_BITS + 20 - top.bit_length())
    while True:
        scaled = [c << (bits * (d - i)) for i, c in enumerate(core)]
        found: list[tuple[int, int, int]] = []
        fine = True
        todo = [(0, top << bits, d, 0)]  # roots in (low, high], counts above each
        while todo:
            low, high, above_low, above_high = todo.pop()
            count = above_low - above_high
            if not count or above_high >= min(k, d):
                continue
            if (high - low) << ROOT_BITS <= high or high - low <= 1:
                fine &= (high - low) << 64 <= high
                found.append((low, high, count))
                continue
            if count == 1:
                sign_low = -1 if above_low % 2 else 1  # of the polynomial just above low
                while high - low > 1 and (high - low) << ROOT_BITS > high:
                    mid = (low + high) // 2
                    s = _sign(scaled, mid)
                    if s == 0:
                        low, high = mid - 1, mid
                    elif s == sign_low:
                        low = mid
                    else:
                        high = mid
                todo.append((low, high, above_low, above_high))
                continue
            mid = (low + high) // 2
            above_mid = _above(scaled, mid)
            todo += [(low, mid, above_low, above_mid), (mid, high, above_mid, above_high)]
        if fine:
            return [(Fraction(low + high, 2 << bits), m) for low, high, m in sorted(found, reverse=True)]
        bits += 128


# ---------------------------------------------------------------- components

def null_vectors(matrix: list[list[int]], root: Fraction, count: int) -> list[list[float]]:
    """``count`` orthonormal vectors of the null space of matrix - root, by inverse iteration in fixed-point integers."""
    d, one = len(matrix), 1 << SOLVE_BITS
    size = max(1, sum(matrix[i][i] for i in range(d)))  # the trace bounds every entry
    a = [[(x << SOLVE_BITS) // size for x in row] for row in matrix]
    shift = int(root * one / size) + 1
    for i in range(d):
        a[i][i] -= shift
    order = list(range(d))
    factors: list[list[int]] = [[] for _ in range(d)]
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(a[i][k]))
        a[k], a[best] = a[best], a[k]
        factors[k], factors[best] = factors[best], factors[k]
        order[k], order[best] = order[best], order[k]
        pivot = a[k][k] = a[k][k] or 1
        head = a[k]
        for i in range(k + 1, d):
            row = a[i]
            f = (row[k] << SOLVE_BITS) // pivot
            factors[i].append(f)
            if f:
                for j in range(k + 1, d):
                    row[j] -= f * head[j] >> SOLVE_BITS

    def unit(z: list[int]) -> list[int]:
        norm = math.isqrt(sum(x * x for x in z)) or 1
        return [(x << SOLVE_BITS) // norm for x in z]

    def solve(b: list[int]) -> list[int]:
        y: list[int] = []
        for i in range(d):
            y.append(b[order[i]] - (sum(f * v for f, v in zip(factors[i], y)) >> SOLVE_BITS))
        z = [0] * d
        for i in range(d - 1, -1, -1):
            rest = y[i] - (sum(a[i][j] * z[j] for j in range(i + 1, d)) >> SOLVE_BITS)
            z[i] = (rest << SOLVE_BITS) // a[i][i]
        return unit(z)

    rng = random.Random(12)
    basis: list[list[int]] = []
    for _ in range(count):
        z = [rng.randrange(-one, one) for _ in range(d)]
        for _ in range(3):
            z = solve(z)
            for _ in range(2):
                for q in basis:
                    dot = sum(x * y for x, y in zip(z, q)) >> SOLVE_BITS
                    z = [x - (dot * y >> SOLVE_BITS) for x, y in zip(z, q)]
                z = unit(z)
        basis.append(z)
    out = []
    for z in basis:
        lead = max(range(d), key=lambda i: abs(z[i]))
        out.append([(x if z[lead] > 0 else -x) / one for x in z])
    return out


# ---------------------------------------------------------------- rows

def _integers(column: pa.Array, d: int, scale: int) -> np.ndarray:
    """floor(scale * component) of a batch of vectors; shorter ones are padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(values) != d * len(column):
        padded = np.zeros((len(column), d))
        padded[np.arange(d) < lengths[:, None]] = values
        values = padded
    return np.clip(np.floor(values * scale), -2.0**62, 2.0**62).astype(np.int64).reshape(len(column), d)


def _gram(y: np.ndarray) -> np.ndarray:
    """y.T @ y exactly, in the fastest numbers that hold it."""
    most = int(np.abs(y).max(initial=0)) ** 2 * max(1, len(y))
    if most < 2**53:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64)
    return y.T @ y if most <= LONG else y.astype(object).T @ y.astype(object)


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([str(v) for v in values], pa.string())


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(``id_col``, component, n, deviation, whitened, explained, identity_error, deviation_exact) per row and component.

    Every component c of a vector becomes x = floor(scale * c) + shift.  Vectors that are null or hold a null, NaN or infinite entry
    take no part; shorter ones count as padded with zeros.  Rows with a null id and repeated rows each count.  Components are numbered by
    falling eigenvalue; those with eigenvalue zero can't be whitened and have no rows, so a table of equal vectors, of one, or
    of none gives none.  ``deviation`` is null beyond a long, ``deviation_exact`` holds it as decimal(38, 0) always.  Sums of
    squares must stay below 10^38.  Other columns are not read.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    x = F.col(vector_col)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.filter(x.isNotNull()).filter(~odd).select(id_col, x.alias("v"))
    empty = spark.createDataFrame([], f"{id_col} {dict(vectors.dtypes)[id_col]}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    n, d = size.n, size.d or 0
    if not n or not d:
        return empty

    def summed(start: list[int], pairs: bool) -> dict[int, int]:
        """Sums over all rows, of components minus ``start`` and, with ``pairs``, of products of two of them; cells by number."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, second = np.zeros(d, object), np.zeros((d, d), object)
            for b in batches:
                y = _integers(b.column(0), d, scale) - np.array(start, np.int64)
                if b.num_rows:
                    first = first + (y.sum(axis=0).astype(object) if int(np.abs(y).max()) * len(y) <= LONG else y.astype(object).sum(axis=0))
                    if pairs:
                        second = second + _gram(y).astype(object)
            cells = [*range(d)] + ([d + i * d + j for i in range(d) for j in range(i + 1)] if pairs else [])
            values = [*first.tolist()] + ([second[i, j] for i in range(d) for j in range(i + 1)] if pairs else [])
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), _decimals(values)], names=["cell", "s"])

        parts = rows.select("v").mapInArrow(run, "cell int, s string").select("cell", F.col("s").cast("decimal(38,0)").alias("s"))
        return {r.cell: int(r.s) for r in parts.groupBy("cell").agg(F.sum("s").alias("s")).collect()}

    total = summed([0] * d, False)
    centre = [(2 * total[i] + n) // (2 * n) for i in range(d)]  # the mean, rounded: what is left of it is taken off exactly
    cells = summed(centre, True)
    rest = [cells[i] for i in range(d)]
    pair = lambda i, j: cells[d + max(i, j) * d + min(i, j)]
    scatter = [[n * pair(i, j) - rest[i] * rest[j] for j in range(d)] for i in range(d)]
    trace = sum(scatter[i][i] for i in range(d))
    if not trace:
        return empty

    primes = primes_below(2**31, primes_needed(trace, d))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in b.column(0).to_pylist():
                p = primes[at]
                left = charpoly_mod(np.array([[v % p for v in row] for row in scatter], np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([left.tolist()], pa.list_(pa.int64()))], names=["at", "rests"])

    tasks = min(len(primes), max(1, spark.sparkContext.defaultParallelism))
    rests = {r.at: np.array(r.rests, np.int64) for r in spark.range(0, len(primes), 1, tasks).mapInArrow(reduce, "at long, rests array<long>").collect()}
    roots = largest_roots(chinese(primes, [rests[i] for i in range(len(primes))]), components)

    def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in b.column(0).to_pylist():
                root, count = roots[at]
                found = null_vectors(scatter, root, count)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([found], pa.list_(pa.list_(pa.float64())))], names=["at", "found"])

    got = {r.at: r.found for r in spark.range(0, len(roots), 1, len(roots)).mapInArrow(vectors_of, "at long, found array<array<double>>").collect()}
    axes = [(np.array(v), root) for at, (root, _) in enumerate(roots) for v in got[at]][:components]
    k = len(axes)
    basis = np.stack([v for v, _ in axes], axis=1)
    spread = np.array([math.sqrt(root / n**2) for _, root in axes])
    explained = [float(root / trace) for _, root in axes]
    middle, part = np.array(centre, np.int64), np.array([Fraction(r, n) for r in rest], dtype=np.float64)

    def white(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        y = _integers(column, d, scale) - middle
        return y, (y - part) @ basis / spread

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                w = white(b.column(0))[1]
                mean = w.mean(axis=0)
                within = (w - mean).T @ (w - mean)
                i, j = np.tril_indices(k)
                yield pa.RecordBatch.from_arrays([pa.array(i * k + j, pa.int32()), pa.array(within[i, j]), pa.array(mean[i] * mean[j] * len(w)),
                                                  pa.array(mean[i] * len(w)), pa.array(mean[j] * len(w))], names=["cell", "within", "between", "a", "b"])

    sums = (rows.select("v").mapInArrow(measure, "cell int, within double, between double, a double, b double")
            .groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("within", "between", "a", "b")]).collect())
    error = max(abs((r.within + r.between - r.a * r.b / n) / n - (r.cell // k == r.cell % k)) for r in sums)
    kept_id = dict(vectors.dtypes)[id_col]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            y, w = white(b.column(1))
            if (n * int(np.abs(y).max()) + max(map(abs, rest))) ** 2 * d <= LONG:
                far = ((n * y - np.array(rest, np.int64)) ** 2).sum(axis=1)
                exact, far = pa.array(far).cast(pa.decimal128(38, 0)), pa.array(far)
            else:
                big = ((n * y.astype(object) - np.array(rest, object)) ** 2).sum(axis=1)
                exact, far = _decimals(big.tolist()).cast(pa.decimal128(38, 0)), pa.array([v if v <= LONG else None for v in big], pa.int64())
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), far.take(at),
                pa.array(w.reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)), exact.take(at)],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    out = rows.mapInArrow(emit, f"id {kept_id}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)")
    return out.withColumnRenamed("id", id_col)
