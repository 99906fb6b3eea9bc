"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

1. Entries become whole numbers on a fixed grid. Spark sums them and their products without
   rounding, so ``n * sum(x x') - S S'``, n squared times the covariance, is an exact matrix of
   whole numbers, however far the data lie from zero.
2. Its characteristic polynomial is found modulo primes below 2^31, each by reduction to
   Hessenberg form in a task of its own; Chinese remaindering over as many primes as the
   coefficients' bound asks for gives the whole numbers.
3. The polynomial has real roots only, so the sign changes of its shifted coefficients count
   the roots above a point exactly, with multiplicities. Bisection isolates the largest roots
   and narrows them to ``BITS`` bits, one root a task.
4. Roots that agree to ``SAME`` bits share a null space. Inverse iteration in long decimals
   with the vectors found so far taken out gives an orthonormal basis of it, one task for each.
5. A pass over the rows centres without rounding and projects in doubles.

The scatter, polynomial and components depend on the number of dimensions alone; only these
reach the driver. The rows stay where they are; one table of projections is written, from
which the covariance of the result is measured.

Defined results: a vector that is NULL, holds a NULL, a NaN or an infinity is dropped; so is
one with an entry of ``LARGE`` or more, whose products no longer sum up exactly, or of another
length than the commonest (of equally common ones the longest); vectors without entries have
no components. Components of eigenvalue zero do not exist: with fewer than ``k`` others
there are fewer rows, none if all vectors are equal or there is one. A missing id is kept; equal rows give equal results; an
empty table gives none; other columns are not looked at. A ``deviation`` beyond 64 bits is NULL.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.session import cut_lineage

GRID = 1024
LARGE = 1 << 34
LIMB = 20
ROWS = 1 << 12
BITS = 128
SAME = 80
DIGITS = 90


def grid_rows(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", grid: int = GRID) -> DataFrame:
    """(id, x): the kept vectors as whole numbers, without the constant that centring takes out again."""
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(LARGE)))
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null").where(fine)
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (length.d if length else 0))
    return rows.select("id", F.transform("v", lambda c: F.floor(c * float(grid)).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _products(x: np.ndarray) -> np.ndarray:
    """x' x as Python numbers: products of limbs of ``LIMB`` bits stay exact in doubles over ``ROWS`` rows."""
    limbs, rest = [], x
    while np.any(rest):
        low = rest & ((1 << LIMB) - 1) if np.abs(rest).max() >= 1 << LIMB else rest
        limbs.append(low.astype(np.float64))
        rest = (rest - low) >> LIMB
    total = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, value): sums of products, sums (i = -1) and the number of rows (j = -1) of a task."""
    n, sums, products = 0, 0, 0
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            x = _matrix(batch.column(0).slice(start, ROWS))
            n, sums, products = n + len(x), sums + x.astype(object).sum(axis=0), products + _products(x)
    if n:
        d = len(sums)
        rows = [(-1, -1, n), *((-1, j, v) for j, v in enumerate(sums))]
        rows += [(i, j, products[i, j]) for i in range(d) for j in range(i, d)]
        i, j, value = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(map(Decimal, map(int, value)), pa.decimal128(38, 0))], ["i", "j", "value"])


def scatter(rows: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """The number of rows, the sums, and n squared times the covariance, all exact."""
    summed = rows.select("x").mapInArrow(_moments, "i int, j int, value decimal(38,0)").groupBy("i", "j").agg(F.sum("value").alias("value"))
    found = {(r.i, r.j): int(r.value) for r in summed.collect()}
    n = found.pop((-1, -1), 0)
    sums = [found[-1, j] for j in range(sum(i == -1 for i, _ in found))]
    size = range(len(sums))
    return n, sums, [[n * found[min(i, j), max(i, j)] - sums[i] * sums[j] for j in size] for i in size]


def primes_below(top: int, count: int) -> list[int]:
    """The largest odd primes below ``top`` (at most 2^32), by Miller's test with the bases that decide below 2^32."""
    def is_prime(p: int) -> bool:
        odd, twos = p - 1, 0
        while not odd & 1:
            odd, twos = odd >> 1, twos + 1
        for base in (2, 7, 61):
            x = pow(base, odd, p)
            if x in (1, p - 1):
                continue
            if not any((x := x * x % p) == p - 1 for _ in range(twos - 1)):
                return False
        return True

    found, p = [], top - 1 - top % 2
    while len(found) < count:
        if is_prime(p):
            found.append(p)
        p -= 2
    return found


def polynomial_modulo(matrix: list[list[int]], p: int) -> np.ndarray:
    """Coefficients of det(t - matrix) modulo ``p``, constant first: by similarity to Hessenberg form, then column by column."""
    h = np.array([[v % p for v in row] for row in matrix], dtype=np.int64)
    d = len(h)
    for k in range(d - 2):
        found = np.flatnonzero(h[k + 1:, k])
        if not len(found):
            continue
        pivot = k + 1 + int(found[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factors = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - factors[:, None] * h[k + 1] % p) % p
        # the columns' sum is taken product by product: one of them alone fills 62 bits
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * factors % p).sum(axis=1)) % p
    polynomials = np.zeros((d + 1, d + 1), dtype=np.int64)
    polynomials[0, 0] = 1
    for m in range(1, d + 1):
        new = np.zeros(d + 1, dtype=np.int64)
        new[1:] = polynomials[m - 1, :-1]
        scale = np.ones(m, dtype=object)
        for i in range(m - 2, -1, -1):  # products of the subdiagonal from i to m - 1
            scale[i] = scale[i + 1] * int(h[i + 1, i]) % p
        weights = h[:m, m - 1] * scale.astype(np.int64) % p
        polynomials[m] = (new - (weights[:, None] * polynomials[:m] % p).sum(axis=0)) % p
    return polynomials[d]


def coefficient_bound(matrix: list[list[int]]) -> int:
    """No coefficient is larger: elementary symmetric functions of roots of no sign are largest for equal ones."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    return max(math.comb(d, k) * trace ** k // d ** k + 1 for k in range(d + 1))


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """The coefficients, constant first; a task for every few primes."""
    count = (2 * coefficient_bound(matrix)).bit_length() // 30 + 1
    primes = primes_below(1 << 31, count)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ps = [primes[k] for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ps, pa.int64()), pa.array([polynomial_modulo(matrix, p) for p in ps], pa.list_(pa.int64()))], ["p", "c"])

    parts = spark.range(0, count, 1, min(count, 4 * spark.sparkContext.defaultParallelism))
    found = parts.mapInArrow(residues, "p bigint, c array<bigint>").collect()
    modulus = math.prod(primes)
    factors = [(modulus // r.p) * pow(modulus // r.p, -1, r.p) for r in found]
    whole = [sum(f * r.c[i] for f, r in zip(factors, found, strict=True)) % modulus for i in range(len(matrix) + 1)]
    return [c - modulus if 2 * c > modulus else c for c in whole]


class Roots:
    """Counts and isolates the roots of a polynomial of whole coefficients whose roots are real and not negative."""

    def __init__(self, coefficients: list[int]) -> None:
        zeros = next(i for i, c in enumerate(coefficients) if c)
        self.c = coefficients[zeros:]
        self.positive = len(self.c) - 1
        self.counts: dict[Fraction, int] = {}

    def _scaled(self, bits: int) -> list[int]:
        """Coefficients of the polynomial whose roots are 2^bits times as large."""
        return [c << (bits * (self.positive - i)) for i, c in enumerate(self.c)]

    def above(self, numerator: int, bits: int) -> int:
        """How many roots are larger than numerator / 2^bits."""
        at = Fraction(numerator, 1 << bits)
        if at not in self.counts:
            c = self._scaled(bits)
            for i in range(len(c) - 1):
                for j in range(len(c) - 2, i - 1, -1):
                    c[j] += numerator * c[j + 1]
            signs = [v > 0 for v in c if v]
            self.counts[at] = sum(a != b for a, b in zip(signs, signs[1:]))
        return self.counts[at]

    def _positive_at(self, numerator: int, bits: int) -> int:
        value = 0
        for c in reversed(self._scaled(bits)):
            value = value * numerator + c
        return (value > 0) - (value < 0)

    def narrowed(self, k: int, precision: int = BITS) -> tuple[int, int]:
        """(m, bits): the k-th largest root (from 1) lies in (m, m + 1] / 2^bits, and m has ``precision`` bits."""
        size = 0
        while self.above(1 << size, 0) >= k:
            size += 1
        bits, low = 0, 0
        if size:
            low, step = 1 << (size - 1), 1 << (size - 1)
        else:  # at most 1: scale up until it is not
            step = 1
            while self.above(1, bits) < k:
                bits += 1
            low, step = (1, 1) if bits else (0, 1)
        high = low + step
        while True:
            if low.bit_length() >= precision and high - low == 1:
                return low, bits
            if high - low == 1:
                low, high, bits = 2 * low, 2 * high, bits + 1
            middle = (low + high) // 2
            many = self.above(low, bits) - self.above(high, bits)
            if many == 1 and (at_high := self._positive_at(high, bits)):
                # a simple root inside: the sign alone tells the side
                while not (low.bit_length() >= precision and high - low == 1):
                    if high - low == 1:
                        low, high, bits = 2 * low, 2 * high, bits + 1
                    middle = (low + high) // 2
                    if self._positive_at(middle, bits) == -at_high:
                        low = middle
                    else:
                        high = middle
                return low, bits
            low, high = (middle, high) if self.above(middle, bits) >= k else (low, middle)


def null_space(matrix: list[list[int]], value: Fraction, size: int) -> np.ndarray:
    """``size`` orthonormal eigenvectors for the eigenvalue(s) at ``value``, as rows of doubles."""
    with decimal.localcontext(prec=DIGITS):
        d = len(matrix)
        at = Decimal(value.numerator) / Decimal(value.denominator)
        a = np.array([[Decimal(v) for v in row] for row in matrix], dtype=object)
        a[np.diag_indices(d)] -= at
        tiny = max(abs(at), Decimal(1)).scaleb(-DIGITS)
        order = np.arange(d)
        for k in range(d):
            pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
            a[k, k] = a[k, k] or tiny
            a[k + 1:, k] = a[k + 1:, k] / a[k, k]
            if k + 1 < d:
                a[k + 1:, k + 1:] -= a[k + 1:, k][:, None] * a[k, k + 1:]

        def solved(b: np.ndarray) -> np.ndarray:
            b = b[order]
            for k in range(1, d):
                b[k] -= a[k, :k] @ b[:k]
            for k in range(d - 1, -1, -1):
                b[k] = (b[k] - (a[k, k + 1:] @ b[k + 1:] if k + 1 < d else 0)) / a[k, k]
            return b

        def unit(b: np.ndarray) -> np.ndarray:
            b = b / max(abs(x) for x in b)
            return b / sum(x * x for x in b).sqrt()

        found: list[np.ndarray] = []
        random = np.random.default_rng(11)
        close = Decimal(10) ** -40
        while len(found) < size:
            b, moved = unit(np.array([Decimal(int(x)) for x in random.integers(1, 1 << 30, d)], dtype=object)), Decimal(1)
            for _ in range(DIGITS):  # each step gains many digits; few are needed
                new = solved(b)
                for _ in range(2):
                    for v in found:
                        new = new - (new @ v) * v
                    new = unit(new)
                moved = min(max(abs(x) for x in new - b), max(abs(x) for x in new + b))
                b = new
                if moved < close:
                    break
            found.append(b)
        return np.array([[float(x) for x in v] for v in found])


class Components:
    """Unit eigenvectors (rows), their eigenvalues of the covariance, and shares of its trace."""

    def __init__(self, vectors: np.ndarray, values: list[float], shares: list[float]) -> None:
        self.vectors, self.values, self.shares = vectors, values, shares


def components(spark: SparkSession, n: int, matrix: list[list[int]], k: int = 8) -> Components:
    """The largest ``k`` components of eigenvalue above zero."""
    d = len(matrix)
    common = math.gcd(*(v for row in matrix for v in row)) if d else 0
    if not common:
        return Components(np.zeros((0, d)), [], [])
    reduced = [[v // common for v in row] for row in matrix]
    coefficients = characteristic_polynomial(spark, reduced)
    count = min(k, Roots(coefficients).positive)

    def isolate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = Roots(coefficients)
        for batch in batches:
            ks = batch.column(0).to_pylist()
            found = [roots.narrowed(i) for i in ks]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ks, pa.int64()), pa.array([str(m) for m, _ in found]), pa.array([b for _, b in found], pa.int32())], ["k", "m", "bits"])

    places = spark.range(1, count + 1, 1, count).mapInArrow(isolate, "k bigint, m string, bits int").collect()
    values = [Fraction(2 * int(r.m) + 1, 2 << r.bits) for r in sorted(places, key=lambda r: r.k)]
    groups: list[list[int]] = []
    for i, v in enumerate(values):
        if groups and abs(values[groups[-1][0]] - v) * (1 << SAME) < v:
            groups[-1].append(i)
        else:
            groups.append([i])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gs = batch.column(0).to_pylist()
            found = [null_space(reduced, values[groups[g][0]], len(groups[g])).ravel() for g in gs]
            yield pa.RecordBatch.from_arrays([pa.array(gs, pa.int64()), pa.array(found, pa.list_(pa.float64()))], ["g", "v"])

    spaces = spark.range(0, len(groups), 1, len(groups)).mapInArrow(solve, "g bigint, v array<double>").collect()
    vectors = np.concatenate([np.array(r.v).reshape(-1, d) for r in sorted(spaces, key=lambda r: r.g)])
    trace = sum(reduced[i][i] for i in range(d))
    return Components(vectors, [float(v * common / (n * n)) for v in values], [float(v / trace) for v in values])


def _projected(batches: Iterator[pa.RecordBatch], n: int, sums: list[int], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, deviation, w): exact centring, n times over, and the projection on the scaled components."""
    most = max(map(abs, sums))
    for batch in batches:
        x = _matrix(batch.column(1))
        peak = int(np.abs(x).max()) * n + most if len(x) else 0
        exact = np.int64 if peak < 1 << 62 else object
        centred = x.astype(exact) * n - np.array(sums, dtype=exact)
        if len(sums) * peak * peak < 1 << 63:
            deviation = (centred * centred).sum(axis=1).tolist()
        else:
            whole = centred.astype(object)
            deviation = [v if v < 1 << 63 else None for v in (whole * whole).sum(axis=1)]
        w = (centred / n).astype(np.float64) @ weights
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(deviation, pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], ["id", "deviation", "w"])


def identity_error(table: DataFrame, k: int) -> float:
    """The largest entry of the covariance of ``w`` minus the identity, centred before multiplying."""
    means = table.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(k)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = table.agg(*[F.avg((F.col("w")[i] - means[i]) * (F.col("w")[j] - means[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, found, strict=True))


def whitened(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = 8, grid: int = GRID) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each kept row and component."""
    spark = vectors.sparkSession
    rows = grid_rows(vectors, id_column, vector, grid)
    n, sums, matrix = scatter(rows)
    model = components(spark, n, matrix, k)
    kind = rows.schema["id"].dataType.simpleString()
    count = len(model.values)
    weights = (model.vectors / np.sqrt(np.array(model.values))[:, None]).T if count else np.zeros((len(sums), 0))
    if count:
        table = cut_lineage(rows.mapInArrow(partial(_projected, n=n, sums=sums, weights=weights), f"id {kind}, deviation bigint, w array<double>"))
        error = identity_error(table, count)
    else:
        table = spark.createDataFrame([], f"id {kind}, deviation bigint, w array<double>")
        error = 0.0
    shares = F.array(*map(F.lit, model.shares or [0.0]))
    return table.select(F.col("id"), "deviation", F.posexplode("w").alias("at", "whitened")).select(
        F.col("id").alias(id_column), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"))
