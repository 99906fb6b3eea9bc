"""The posterior mode of ordinal scores against dense arithmetic: stationary, highest, errors from the second derivatives."""

import math

import numpy as np
import pytest

from scoreframe.operators.ordinal_mode import fit_mode

LEVELS = 5


@pytest.fixture(scope="module")
def marks():
    """Unequal numbers of marks, marks nobody gave, repeats, a missing key, marks out of range."""
    rng = np.random.default_rng(8)
    theta, lenient = rng.normal(size=12), rng.normal(size=7)
    rows = []
    for rater in range(7):
        for person in range(12):
            if rng.random() < 0.7:
                y = 1 + int(np.searchsorted([-2.0, -0.7, 0.7, 2.0], theta[person] - lenient[rater] + rng.logistic()))
                rows.append((rater if rater else None, person, min(y, 3) if rater == 2 else 1 if rater == 4 else y))
    return rows + rows[:5]


def height(rows, theta, cuts):
    value = -sum(t * t for t in theta.values()) / 2
    for c in cuts.values():
        gaps = [b - a for a, b in zip(c, c[1:])]
        if min(gaps) <= 0:
            return -math.inf
        value += sum(map(math.log, gaps)) - sum(x * x for x in c) / 8
    share = lambda x: 1 / (1 + math.exp(-x))
    for r, s, y in rows:
        c = cuts[r]
        value += math.log((share(c[y - 1] - theta[s]) if y < LEVELS else 1) - (share(c[y - 2] - theta[s]) if y > 1 else 0))
    return value


def test_mode_is_stationary_and_errors_follow_from_the_curvature(spark, marks):
    df = spark.createDataFrame([(*m, "t") for m in marks] + [(1, 1, None, "t"), (1, 1, 9, "t")], "n int, s int, y int, r string").repartition(3)
    fit = fit_mode(df, LEVELS, ["s", "r"], ["n"])
    assert fit.converged and fit.gradient <= 1e-6 and fit.steps < 20
    theta = {r.s: r.theta for r in fit.scores.collect()}
    cuts = {r["n"]: list(r.cuts) for r in fit.cuts.toDF("n", "cuts", "marks").collect()}
    assert math.isclose(height(marks, theta, cuts), fit.objective, abs_tol=1e-8)
    people, raters = sorted(theta), sorted(cuts, key=str)
    at = np.array([*(theta[s] for s in people), *(x for r in raters for x in cuts[r])])

    def value(v):
        own = {r: list(v[len(people) + 4 * i:len(people) + 4 * i + 4]) for i, r in enumerate(raters)}
        return height(marks, dict(zip(people, v, strict=False)), own)

    step, unit = 1e-4, np.eye(len(at))
    slopes = [(value(at + step * u) - value(at - step * u)) / (2 * step) for u in unit]
    assert max(map(abs, slopes)) < 1e-4
    curvature = np.array([[-(value(at + step * (u + w)) - value(at + step * (u - w)) - value(at - step * (u - w)) + value(at - step * (u + w)))
                           / (4 * step * step) for w in unit] for u in unit])
    k = len(people)
    left = curvature[:k, :k] - curvature[:k, k:] @ np.linalg.inv(curvature[k:, k:]) @ curvature[k:, :k]
    errors = {r.s: r.sd for r in fit.scores.collect()}
    assert np.allclose([errors[s] for s in people], 1 / np.sqrt(np.diag(left)), rtol=1e-3)


def test_too_little_to_fit_is_refused(spark):
    df = spark.createDataFrame([(1, 1, None)], "r int, s int, y int")
    with pytest.raises(ValueError):
        fit_mode(df, LEVELS, ["s"], ["r"])
