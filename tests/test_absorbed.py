"""Absorbed categories against dense least squares, and at the edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreframe.operators.absorbed import absorb, fit_absorbed, interaction_terms
from scoreframe.operators.regression import fit_formula


def dense(rows, y, xs, factors):
    """Least squares with a 0/1 column for every level: slopes, errors, residuals, df."""
    columns = [[float(r[x]) for r in rows] for x in xs]
    for key in factors:
        for level in sorted({str(r[key]) for r in rows}):
            columns.append([float(str(r[key]) == level) for r in rows])
    matrix, target = np.array(columns).T, np.array([float(r[y]) for r in rows])
    beta, _, rank, _ = np.linalg.lstsq(matrix, target, rcond=None)
    rest = target - matrix @ beta
    freedom = len(rows) - rank
    spread = rest @ rest / freedom * np.linalg.pinv(matrix.T @ matrix)
    return beta[:len(xs)], np.sqrt(np.diag(spread))[:len(xs)], rest, freedom


def people(n=240, split=False):
    rng = np.random.default_rng(5)
    out = []
    for i in range(n):
        a, b = int(rng.integers(0, 12)), int(rng.integers(0, 9))
        if split:  # two parts that share no level
            a, b = (a % 6, b % 4) if i % 2 else (6 + a % 6, 4 + b % 5)
        x, z = float(rng.normal() + a), float(rng.normal() * (1 + b))
        out.append({"i": i, "a": a, "b": f"b{b}", "x": x, "z": z, "y": 2 * x - 0.5 * z + a * a / 9 + b + float(rng.normal())})
    return out


@pytest.mark.parametrize("split", [False, True])
def test_two_factors_equal_dense_least_squares(spark, split):
    rows = people(split=split)
    table, fitted = fit_absorbed(spark.createDataFrame(rows), "y", ["x", "z"], {"a": ["a"], "b": ["b"]})
    beta, errors, rest, freedom = dense(rows, "y", ["x", "z"], ["a", "b"])
    got = {r.term: r for r in table.collect()}
    assert all(r.converged and r.df == freedom for r in got.values())
    assert np.allclose([got[c].estimate for c in ("x", "z")], beta, atol=1e-8)
    assert np.allclose([got[c].std_error for c in ("x", "z")], errors, atol=1e-8)
    found = {r.i: r.residual for r in fitted.select("i", "residual").collect()}
    assert np.allclose([found[r["i"]] for r in rows], rest, atol=1e-7)


def test_one_factor_needs_one_step_and_three_have_no_errors(spark):
    rows = people()
    df = spark.createDataFrame(rows)
    assert absorb(df, ["y"], {"a": ["a"]}).steps == 1
    table, _ = fit_absorbed(df.withColumn("c", F.col("i") % 4), "y", ["x"], {"a": ["a"], "b": ["b"], "c": ["c"]})
    want, _, _, _ = dense([{**r, "c": r["i"] % 4} for r in rows], "y", ["x"], ["a", "b", "c"])
    row = table.first()
    assert abs(row.estimate - want[0]) < 1e-8 and row.std_error is None and row.df is None


def test_twenty_thousand_categories(spark):
    """Pairs within 20,000 categories: the slope is that of the differences within pairs."""
    df = spark.range(40_000).select((F.col("id") % 20_000).alias("level"), (F.col("id") % 77).cast("double").alias("x"),
                                    (F.col("id") % 13).alias("e"))
    df = df.withColumn("y", 3 * F.col("x") + F.col("level") * 7 % 1000 + F.col("e"))
    table, rows = fit_absorbed(df, "y", ["x"], {"level": ["level"]})
    i = np.arange(40_000)
    x, y = i % 77, 3.0 * (i % 77) + (i % 20_000) * 7 % 1000 + i % 13
    dx, dy = x[20_000:] - x[:20_000], y[20_000:] - y[:20_000]
    row = table.first()
    assert abs(row.estimate - dx @ dy / (dx @ dx)) < 1e-9 and row.df == 40_000 - 20_000 - 1
    assert rows.groupBy("level").agg(F.abs(F.sum("residual")).alias("s")).agg(F.max("s")).first()[0] < 1e-6


def test_explained_terms_missing_values_and_empty_tables(spark):
    rows = people()
    df = spark.createDataFrame(rows).withColumns({"of_a": F.col("a") * 2.0, "twice": F.col("x") * 2, "flat": F.lit(0.1)})
    table, fitted = fit_absorbed(df, "y", ["x", "of_a", "twice", "flat"], {"a": ["a"]})
    found = {r.term: r.estimate for r in table.collect()}
    want, _, _, freedom = dense(rows, "y", ["x"], ["a"])
    assert found["of_a"] is None and found["twice"] is None and found["flat"] is None
    assert abs(found["x"] - want[0]) < 1e-8 and table.first().df == freedom
    holes = df.withColumns({"a": F.when(F.col("a") != 3, F.col("a")), "y": F.when(F.col("i") > 5, F.col("y"))})
    table, fitted = fit_absorbed(holes, "y", ["x"], {"a": ["a"]})
    want, _, _, _ = dense([r for r in rows if r["i"] > 5], "y", ["x"], ["a"])
    assert fitted.count() == len(rows) - 6 and abs(table.first().estimate - want[0]) < 1e-8
    table, fitted = fit_absorbed(df.filter("false"), "y", ["x"], {"a": ["a"], "b": ["b"]})
    assert table.first().estimate is None and table.first().converged and fitted.count() == 0


def test_interaction_terms_equal_the_dense_formula(spark):
    rows = spark.createDataFrame(people()).select("y", "x", F.col("b").alias("group"))
    got = {r.term: r.estimate for r in interaction_terms(rows, "y", "x", "group").collect()}
    levels = [f"b{i}" for i in range(1, 9)]
    wide = rows.withColumns({f"x_x_{v}": F.when(F.col("group") == v, F.col("x")).otherwise(0.0) for v in levels})
    table, _ = fit_formula(wide, "y ~ x + group + " + " + ".join(f"x_x_{v}" for v in levels))
    want = {r.term: r.estimate for r in table.collect()}
    assert set(got) == set(want) and all(abs(got[t] - want[t]) < 1e-8 for t in want)


def test_columns_named_like_the_inner_ones(spark):
    rows = people()
    df = spark.createDataFrame(rows).selectExpr("a AS id", "b AS f", "x AS n", "y AS x0", "i AS level")
    table, fitted = fit_absorbed(df, "x0", ["n"], {"one": ["id"], "two": ["f"]})
    want, _, rest, freedom = dense(rows, "y", ["x"], ["a", "b"])
    assert abs(table.first().estimate - want[0]) < 1e-8 and table.first().df == freedom
    assert fitted.columns == ["id", "f", "n", "x0", "level", "residual"]
    found = {r.level: r.residual for r in fitted.collect()}
    assert np.allclose([found[r["i"]] for r in rows], rest, atol=1e-7)
