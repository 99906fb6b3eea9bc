"""Exact whitening: polynomials and roots against plain arithmetic, results against numpy, odd vectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from scoreframe.llm import whitening
from scoreframe.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def scatter_of(x):
    n, total = len(x), [sum(c) for c in zip(*x, strict=True)]
    d = range(len(total))
    return [[n * sum(int(r[i]) * int(r[j]) for r in x) - total[i] * total[j] for j in d] for i in d]


def leverrier(m):
    """The characteristic polynomial by traces of powers, constant first."""
    d = len(m)
    a, c, b = np.array(m, dtype=object), [0] * d + [1], np.zeros((d, d), dtype=object)
    unit = np.array([[int(i == j) for j in range(d)] for i in range(d)], dtype=object)
    for k in range(1, d + 1):
        b = a @ b + c[d - k + 1] * unit
        c[d - k] = -int(np.trace(a @ b)) // k
    return c


@pytest.mark.parametrize("d, spread", [(1, 50), (2, 10**9), (3, 1), (7, 300), (12, 10**6)])
def test_polynomial_and_roots_are_exact(spark, d, spread):
    rng = np.random.default_rng(d)
    m = scatter_of(rng.integers(-spread, spread + 1, (d + 20, d)).tolist())
    c = whitening.characteristic_polynomial(spark, m)
    assert c == leverrier(m) and max(map(abs, c)) <= whitening.coefficient_bound(m)
    roots = whitening.Roots(c)
    assert roots.positive == d
    want = np.sort(np.linalg.eigvalsh(np.array(m, dtype=float)))[::-1]
    for k in range(1, d + 1):
        at, bits = roots.narrowed(k)
        assert roots.above(at, bits) >= k > roots.above(at + 1, bits) and at.bit_length() >= whitening.BITS
        assert math.isclose(at / 2**bits, want[k - 1], rel_tol=1e-9)


def test_zero_columns_and_repeated_roots():
    m = [[4, 0, 0, 0], [0, 4, 0, 0], [0, 0, 0, 0], [0, 0, 0, 1]]
    roots = whitening.Roots(leverrier(m))
    assert roots.positive == 3 and [round(roots.narrowed(k)[0] / 2 ** roots.narrowed(k)[1], 12) for k in (1, 2, 3)] == [4, 4, 1]
    basis = whitening.null_space(m, Fraction(4), 2)
    assert np.allclose(basis @ basis.T, np.eye(2), atol=1e-15) and np.allclose(basis[:, 2:], 0, atol=1e-30)
    p = whitening.primes_below(1 << 31, 3)
    assert p == [2147483647, 2147483629, 2147483587]


def test_the_query_equals_numpy_on_the_whole_table(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in rows.values()], dtype=object)
    n, total = len(x), x.sum(axis=0)
    deviation = dict(zip(rows, ((n * x - total) ** 2).sum(axis=1), strict=True))
    centred = (n * x - total).astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    got = QUERIES["op13_embedding_whitening"](spark, FOLDER).collect()
    assert len(got) == 8 * len(rows) and {(r.vec_id, r.component) for r in got} == {(v, c + 1) for v in rows for c in range(8)}
    table = np.zeros((n, 8))
    place = {v: i for i, v in enumerate(rows)}
    for r in got:
        assert r.n == n and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-12
        assert math.isclose(r.explained, values[-r.component] / values.sum(), rel_tol=1e-9)
        table[place[r.vec_id], r.component - 1] = r.whitened
    for c in range(8):
        want = centred @ vectors[:, -1 - c] / math.sqrt(values[-1 - c])
        assert min(abs(table[:, c] - want).max(), abs(table[:, c] + want).max()) < 1e-9
    assert abs(table.T @ table / n - np.eye(8)).max() < 1e-12


def test_odd_vectors_have_defined_results(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 0.25, -0.125]), (1, [0.5, 0.25, -0.125]), (None, [1e9, 0.0, 0.0]), (3, [-1e9, 1.0, 2.0]), (4, [0.0, 3.0, -7.0])]
    bad = [(5, None), (6, [1.0, None, 2.0]), (7, [nan, 0.0, 0.0]), (8, [0.0, inf, 0.0]), (9, [1.0]), (10, []), (11, [-inf, 1.0, 1.0]), (12, [1e12, 0.0, 0.0])]
    table = spark.createDataFrame([(*r, 0, 0.0) for r in good + bad], "vec_id long, embedding array<double>, n int, whitened double")
    got = whitening.whitened(table.repartition(3)).collect()
    x = [[math.floor(1024 * c) for c in v] for _, v in good]
    total = [sum(c) for c in zip(*x, strict=True)]
    big = {k: sum((5 * a - t) ** 2 for a, t in zip(v, total, strict=True)) for (k, _), v in zip(good, x, strict=True)}
    assert len(got) == 5 * 3 and all(r.n == 5 and r.identity_error < 1e-9 for r in got)
    assert {r.vec_id: r.deviation for r in got} == {k: v if v < 2**63 else None for k, v in big.items()}
    assert any(v >= 2**63 for v in big.values()) and math.isclose(sum({r.component: r.explained for r in got}.values()), 1)


def test_low_rank_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    line = spark.createDataFrame([(i, [float(i), float(2 * i), 1.0]) for i in range(9)], schema)
    got = whitening.whitened(line).collect()
    assert len(got) == 9 and {r.component for r in got} == {1} and math.isclose(got[0].explained, 1)
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)], [(1, [])]):
        out = whitening.whitened(spark.createDataFrame(rows, schema))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_sums_stay_exact_at_any_size(spark):
    rng = np.random.default_rng(5)
    x = [[int(v) for v in r] for r in rng.integers(-(1 << 44), 1 << 44, (300, 4))]
    rows = spark.createDataFrame([(1, r) for r in x], "id long, x array<long>").repartition(4)
    n, sums, matrix = whitening.scatter(rows)
    assert (n, sums, matrix) == (300, [sum(c) for c in zip(*x, strict=True)], scatter_of(x))
