"""Fits over packed rows: few jobs, the same results with levels too large for a block and with every vector as a table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreframe.operators import absorbed, blocks, mixed, ordinal_mode
from tests.test_ordinal_mode import marks  # noqa: F401


@pytest.fixture
def jobs(spark):
    """Counts the jobs that a call starts."""
    def count(name, call):
        spark.sparkContext.setJobGroup(name, name)
        try:
            return call(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return count


def scored(fit):
    scores = {(r.s, r.t): (r.theta, r.sd, r.n) for r in fit.scores.collect()}
    cuts = {(r.r, r.u): (*r.cuts, r.n) for r in fit.cuts.collect()}
    return scores, cuts


def check(one, other, atol):
    for a, b in zip(one, other, strict=True):
        assert a.keys() == b.keys()
        for k in a:
            assert np.allclose(a[k], b[k], atol=atol), k


@pytest.mark.parametrize("prior", [None, (["a", "b"], np.array([[1.0, 0.6], [0.6, 1.2]]))])
def test_ordinal_mode_takes_few_jobs_whatever_the_raters_sizes(spark, marks, monkeypatch, jobs, prior):  # noqa: F811
    rows = [(r, f"u{(r or 0) % 2}", s // 2, "ab"[s % 2], y) for r, s, y in marks]
    df = spark.createDataFrame(rows, "r int, u string, s int, t string, y int").repartition(3)

    def fit():
        return ordinal_mode.fit_mode(df, 5, ["s", "t"], ["r", "u"], trait="t" if prior else None, covariance=prior)

    found, taken = jobs(f"packed-{prior is None}", fit)
    assert found.converged and taken < 40 + 8 * (found.steps + found.products)
    monkeypatch.setattr(blocks, "WHOLE", 8)  # some raters' cut points are outer unknowns
    monkeypatch.setattr(blocks, "BLOCK", 16)
    monkeypatch.setattr(blocks, "GATHERED", 0)
    large = fit()
    assert large.converged
    check(scored(found), scored(large), 1e-6)
    if prior is None:
        monkeypatch.setattr(blocks, "HELD", 0)
        tables = fit()
        assert tables.converged
        check(scored(found), scored(tables), 1e-6)


def test_mixed_fit_takes_few_jobs_whatever_the_levels_sizes(spark, monkeypatch, jobs):
    """Levels of 1 to 40 rows, a missing key, a nested factor, a covariate; all rows twice."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 30, 300) // 2 * rng.integers(0, 2, 300), rng.integers(0, 9, 300)
    rows = [(int(i) if i else None, f"b{k}", int(k % 3), float(x), float(1 + x + i / 9 + k + e)) for i, k, x, e in zip(a, b, rng.normal(size=300), rng.normal(size=300))]
    df = spark.createDataFrame(rows * 2, "a int, b string, c int, x double, y double").repartition(3)
    factors = {"a": ["a"], "b": ["b", "c"], "c": ["c"]}

    def fit():
        return mixed.fit_intercepts(df, "y", ["x"], factors)

    def seen(fit):
        effects = {(f, *r[:len(k)]): r[len(k):] for f, k in factors.items() for r in fit.effects[f].collect()}
        return {"beta": fit.beta, "spread": [fit.residual_var, *fit.effect_vars.values()]}, effects

    found, taken = jobs("mixed", fit)
    assert found.converged and taken < 60 + 6 * (found.steps + found.rounds)
    monkeypatch.setattr(blocks, "WHOLE", 20)
    monkeypatch.setattr(blocks, "BLOCK", 16)
    monkeypatch.setattr(blocks, "GATHERED", 0)
    large = fit()
    assert large.converged
    check(seen(found), seen(large), 1e-5)
    monkeypatch.setattr(blocks, "HELD", 0)
    tables = fit()
    assert tables.converged
    check(seen(found), seen(tables), 1e-5)


def test_responses_are_fitted_as_if_alone(spark):
    """Packed once if they are missing in the same rows, and apart otherwise."""
    rng = np.random.default_rng(9)
    rows = [(int(i % 13), int(i % 5), float(rng.normal() + i % 13), float(rng.normal() - i % 5)) for i in range(150)]
    df = spark.createDataFrame(rows, "a int, b int, y double, z double")
    holes = df.withColumn("z", F.when(F.col("a") != 2, F.col("z")))
    for table in (df, holes):
        for name, fit in zip("yz", mixed.fit_responses(table, ["y", "z"], [], {"a": ["a"], "b": ["b"]}), strict=True):
            alone = mixed.fit_intercepts(table, name, [], {"a": ["a"], "b": ["b"]})
            assert fit.converged and np.allclose([fit.residual_var, *fit.beta], [alone.residual_var, *alone.beta], atol=1e-8)
            got, want = ({r.a: r.effect for r in f.effects["a"].collect()} for f in (fit, alone))
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in got)


def test_sweeps_take_few_jobs_whatever_the_levels_sizes(spark, monkeypatch, jobs):
    """Two parts that share no level, levels of 1 to 40 rows, a missing key."""
    rng = np.random.default_rng(4)
    rows = [(i, int(a) or None, f"b{(a % 2) * 3 + k}", float(x), float(2 * x + a + k + e))
            for i, (a, k, x, e) in enumerate(zip(rng.integers(0, 30, 300) // 2 * rng.integers(0, 2, 300), rng.integers(0, 3, 300), rng.normal(size=300), rng.normal(size=300)))]
    df = spark.createDataFrame(rows, "i int, a int, b string, x double, y double").repartition(3)

    def fit():
        table, left = absorbed.fit_absorbed(df, "y", ["x"], {"a": ["a"], "b": ["b"]})
        row = table.first()
        assert row.converged
        return row.steps, ({"x": (row.estimate, row.std_error, row.df)}, {r.i: r.residual for r in left.collect()})

    (steps, found), taken = jobs("swept", fit)
    assert taken < 80 + 6 * steps
    monkeypatch.setattr(blocks, "WHOLE", 20)
    monkeypatch.setattr(blocks, "BLOCK", 16)
    check(found, fit()[1], 1e-7)
    monkeypatch.setattr(blocks, "HELD", 0)
    check(found, fit()[1], 1e-7)
