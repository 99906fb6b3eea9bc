"""Fits whose prior lets a person's traits vary together, against dense arithmetic."""

import math

import numpy as np
import pytest

from scoreframe.operators import choice
from scoreframe.operators.covariance import trait_correlations
from scoreframe.operators.ordinal_mode import fit_mode
from tests.test_models import brute_sets, votes  # noqa: F401
from tests.test_ordinal_mode import height, marks  # noqa: F401

TRAITS = ["Boost", "Spike", "Quiet"]
TOGETHER = np.array([[1.0, 0.7, 0.2], [0.7, 1.5, -0.3], [0.2, -0.3, 0.8]])


def slopes_of(members, noms, theta, covariance):
    """The gradient of the choice posterior, every set written out."""
    out = dict.fromkeys(theta, 0.0)
    for (v, t, r), (g, p, s) in brute_sets(members, noms).items():
        if p not in s:
            continue
        total = sum(math.exp(theta[g, m, t]) for m in s)
        out[g, p, t] += 1
        for m in s:
            out[g, m, t] -= math.exp(theta[g, m, t]) / total
    inverse = np.linalg.inv(covariance)
    for g, people in members.items():
        for p in people:
            pull = inverse @ [theta[g, p, t] for t in TRAITS]
            for t, x in zip(TRAITS, pull):
                out[g, p, t] -= x
    return out


def test_correlated_strengths_are_stationary(votes):  # noqa: F811
    members, noms, df, roster = votes
    found = choice.fit_correlated_strengths(choice.choice_sets(df, roster, ["pos"]), roster, TRAITS, TOGETHER)
    rows = found.collect()
    assert len(rows) == 27 * 3 and all(r.converged and r.gradient <= 1e-6 for r in rows)
    theta = {(r.grp, r.person, r.trait): r.theta for r in rows}
    assert max(map(abs, slopes_of(members, noms, theta, TOGETHER).values())) < 2e-6
    # nobody was chosen for the third trait: it is what the prior expects from the other two
    weights = TOGETHER[2, :2] @ np.linalg.inv(TOGETHER[:2, :2])
    for g, p in {(r.grp, r.person) for r in rows}:
        assert math.isclose(theta[g, p, "Quiet"], weights @ [theta[g, p, t] for t in TRAITS[:2]], abs_tol=1e-5)


def test_without_correlation_each_trait_is_fitted_alone(votes):  # noqa: F811
    _, _, df, roster = votes
    sets = choice.choice_sets(df, roster, ["pos"])
    both = {(r.grp, r.person, r.trait): r.theta
            for r in choice.fit_correlated_strengths(sets, roster, TRAITS[:2], np.eye(2)).collect()}
    alone = choice.fit_correlated_strengths(sets, roster, TRAITS[:1], np.eye(1)).collect()
    assert len(both) == 2 * len(alone) and all(math.isclose(both[r.grp, r.person, r.trait], r.theta, abs_tol=1e-5) for r in alone)


def test_correlated_ordinal_scores_are_stationary(spark, marks):  # noqa: F811
    """Odd people are the second trait of the even ones; one person has marks of one trait only."""
    names = ["a", "b"]
    prior = np.array([[1.0, 0.8], [0.8, 1.0]])
    kept = [m for m in marks if m[1] != 3]
    df = spark.createDataFrame([(r, s // 2, names[s % 2], y) for r, s, y in kept], "rater int, person int, trait string, y int")
    fit = fit_mode(df, 5, ["person", "trait"], ["rater"], trait="trait", covariance=(names, prior))
    scores = fit.scores.collect()
    assert fit.converged and len(scores) == 12
    theta = {2 * r.person + names.index(r.trait): r.theta for r in scores}
    assert {r.n for r in scores if (r.person, r.trait) == (1, "b")} == {0}
    assert math.isclose(theta[3], 0.8 * theta[2], abs_tol=1e-5)
    cuts = {r.rater: list(r.cuts) for r in fit.cuts.collect()}
    inverse = np.linalg.inv(prior)

    def value(theta):
        pairs = [np.array([theta[2 * p], theta[2 * p + 1]]) for p in range(6)]
        return height(kept, theta, cuts) + sum(t * t for t in theta.values()) / 2 - sum(v @ inverse @ v for v in pairs) / 2

    assert math.isclose(value(theta), fit.objective, abs_tol=1e-8)
    for s in theta:
        up, down = ({**theta, s: theta[s] + d} for d in (1e-4, -1e-4))
        assert abs(value(up) - value(down)) / 2e-4 < 1e-4


def test_matrices_that_are_no_covariance_are_refused(spark, votes):  # noqa: F811
    _, _, df, roster = votes
    sets = choice.choice_sets(df, roster, ["pos"])
    for bad in (np.array([[1.0, 2.0], [2.0, 1.0]]), np.eye(3), np.array([[1.0, 0.5], [0.0, 1.0]])):
        with pytest.raises(ValueError):
            choice.fit_correlated_strengths(sets, roster, TRAITS[:2], bad)


def test_trait_correlations_skip_missing_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, 5.0), (3.0, None, 5.0), (4.0, 7.0, 5.0)], "a double, b double, c double")
    got = trait_correlations(df, ["a", "b", "c"], shrink=0.1)
    want = 0.9 * np.corrcoef([1, 2, 4], [2, 4, 7])[0, 1]
    assert math.isclose(got[0, 1], want, abs_tol=1e-12) and got[0, 2] == got[2, 1] == 0.0 and np.allclose(np.diag(got), 1)
