"""Leave-one-out predictions against refits without the row, and at the edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreframe.operators.regression import MAX_LEVELS, dummies, indicators, left_out_errors, left_out_predictions

PENALTIES = [0.0, 0.1, 3.0]


def refit(x, y, lam, i):
    """Prediction of row ``i`` from the others; penalty and scales as of all rows."""
    z = (x - x.mean(0)) / x.std(0)
    keep = np.arange(len(y)) != i
    a = np.column_stack([np.ones(keep.sum()), z[keep]])
    penalty = len(y) * lam * np.diag([0.0] + [1.0] * x.shape[1])
    return np.concatenate([[1.0], z[i]]) @ np.linalg.solve(a.T @ a + penalty, a.T @ y[keep])


def test_equal_to_refits_in_every_group(spark):
    rng = np.random.default_rng(2)
    data = [{"i": i, "g": None if i % 3 == 0 else f"g{i % 3}", "a": float(rng.normal() * 5 + 1000), "b": float(rng.integers(0, 4)),
             "c": float(rng.normal())} for i in range(75)]
    for r in data:
        r["y"] = r["a"] * 0.3 - r["b"] + float(rng.normal())
    got = left_out_predictions(spark.createDataFrame(data), "y", ["a", "b", "c"], ["g"], PENALTIES)
    found = {r.i: r.left_out for r in got.collect()}
    errors = {(r.g, r.penalty): r for r in left_out_errors(got, "y", ["g"], PENALTIES).collect()}
    for group in (None, "g1", "g2"):
        rows = [r for r in data if r["g"] == group]
        x, y = np.array([[r["a"], r["b"], r["c"]] for r in rows]), np.array([r["y"] for r in rows])
        squares = []
        for k, lam in enumerate(PENALTIES):
            want = np.array([refit(x, y, lam, i) for i in range(len(rows))])
            assert np.allclose([found[r["i"]][k] for r in rows], want, atol=1e-7)
            squares.append(np.mean((y - want) ** 2))
            assert abs(errors[group, lam].error - squares[-1]) < 1e-7 and errors[group, lam].n_open == 0
        assert [errors[group, lam].chosen for lam in PENALTIES] == [k == int(np.argmin(squares)) for k in range(3)]


def test_constant_missing_lonely_and_empty(spark):
    df = spark.createDataFrame([(1, 1.0, 7.0, 2.0), (2, 2.0, 7.0, 4.0), (3, 3.0, 7.0, 7.0), (4, None, 7.0, 1.0)], "i int, x double, k double, y double")
    got = {r.i: r.left_out for r in left_out_predictions(df, "y", ["x", "k"], [], [0.0]).collect()}
    assert set(got) == {1, 2, 3} and abs(got[1][0] - 1.0) < 1e-9 and abs(got[3][0] - 6.0) < 1e-9
    lonely = left_out_predictions(df.filter("i = 1"), "y", ["x"], [], [0.0, 1.0])
    assert lonely.first().left_out == [None, None]
    assert all(r.n_open == 1 and r.error is None for r in left_out_errors(lonely, "y", [], [0.0, 1.0]).collect())
    assert left_out_predictions(df.filter("false"), "y", ["x"], [], [0.0]).count() == 0


def test_indicators_of_many_categories(spark):
    df = spark.range(3_000).select("id", (F.col("id") % 1500).alias("level"), F.when(F.col("id") > 5, "x").otherwise("w").alias("kind"))
    with pytest.raises(ValueError):
        dummies(df, ["level"])
    found = indicators(df, ["id"], ["level", "kind"])
    assert MAX_LEVELS < found.filter("column = 'level'").select("level").distinct().count() == 1499
    assert found.filter("column = 'level'").count() == 2998 and found.filter("column = 'kind'").count() == 2994
    missing = df.withColumn("kind", F.when(F.col("id") < 2, F.col("kind")))
    assert indicators(missing, ["id"], ["kind"]).count() == 0 and indicators(df.filter("false"), ["id"], ["kind"]).count() == 0
