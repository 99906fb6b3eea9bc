"""Likelihoods of scores far from the cut points and from each other."""

import math

import pytest

from scoreframe.operators import choice, ordinal
from scoreframe.operators.ordinal import log_likelihood


@pytest.mark.parametrize("theta", [-700.0, -40.0, 0.3, 50.0, 700.0])
@pytest.mark.parametrize("y", [1, 3, 5])
def test_log_likelihood_is_exact_for_extreme_scores(table, theta, y):
    cuts = [-2.0, -0.5, 0.5, 2.0]
    got = log_likelihood(
        table([(1, 1, y)], "rater int, ratee int, y int"), table([(1, theta)], "ratee int, theta double"),
        table([(1, cuts)], "rater int, cuts array<double>"), ["ratee"], ["rater"]).first()["log_lik"]

    def log_logistic(x):
        return min(x, 0.0) - math.log1p(math.exp(-abs(x)))

    want = (log_logistic(cuts[y - 1] - theta) if y < 5 else 0.0) + (log_logistic(theta - cuts[y - 2]) if y > 1 else 0.0)
    if 1 < y < 5:
        want += math.log(-math.expm1(cuts[y - 2] - cuts[y - 1]))
    assert math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize("theta", [36.0, 50.0, 100.0, 700.0])
@pytest.mark.parametrize("out", [(None, None), (1, None), (2, None), (1, 2), (1, 3), (3, 4)])
def test_choice_sums_are_exact_for_dominant_members(table, theta, out):
    thetas = {1: theta, 2: theta / 2, 3: -1.0, 4: 0.5, 5: -theta}
    row = ("v", "t", 3, "g", 5, *out, 5 - sum(o is not None for o in out), True)
    sets = table([row], "nominator string, trait string, rank int, grp string, nominee int, out_1 int, out_2 int, set_size int, winner_in_set boolean")
    strengths = table([("g", p, "t", x) for p, x in thetas.items()], "grp string, person int, trait string, theta double")
    left = [x for p, x in thetas.items() if p not in out]
    top = max(left)
    want = thetas[5] - top - math.log(sum(math.exp(x - top) for x in left))
    got = choice.log_likelihood(sets, strengths).first()["log_lik"]
    assert math.isclose(got, want, rel_tol=1e-12)


@pytest.mark.parametrize("theta", [-700.0, -40.0, 40.0, 700.0])
def test_cut_steps_stay_finite_for_extreme_scores(table, theta):
    counts = table([(1, 1, y, 2) for y in (1, 3, 5)], "rater int, ratee int, y int, n bigint")
    scores, cuts = table([(1, theta)], "ratee int, theta double"), table([(1, [-2.0, -0.5, 0.5, 2.0])], "rater int, cuts array<double>")
    got = ordinal._cut_step(counts, scores, cuts, ["ratee"], ["rater"], 5).first()["cuts"]
    assert all(math.isfinite(c) for c in got) and got == sorted(got)
