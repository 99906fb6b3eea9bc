"""Model jobs against numpy or brute force on small data."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreframe.operators import choice, covariance, mixed, ordinal, proximity, regression
from scoreframe.operators.reshape import to_wide
from tests.conftest import rows_of


@pytest.fixture(scope="module")
def votes(spark):
    """Three groups; one group has most people and the most popular pick."""
    rng = random.Random(5)
    roster = [("big", p, f"n{p:03d}") for p in range(20)] + [("mid", p, f"n{p:03d}") for p in range(20, 26)] + [
        ("one", 26, "n026")]
    members = {}
    for g, p, _ in roster:
        members.setdefault(g, []).append(p)
    noms = []
    for v in range(60):
        g = rng.choice(["big", "big", "mid", "one"])
        for t in ("Boost", "Spike"):
            for rank in range(1, rng.randrange(1, 4) + 1):
                pick = 0 if g == "big" and rng.random() < 0.4 else rng.choice(members[g] + [999])
                noms.append((v, t, rank, g, None if rng.random() < 0.05 else pick, rank))
    return (members, noms, spark.createDataFrame(noms, "nominator int, trait string, rank int, grp string, nominee int, pos int"),
            spark.createDataFrame(roster, "grp string, person int, name string"))


def brute_sets(members, noms):
    first = {}
    for v, t, r, g, p, _ in noms:
        first.setdefault((v, t, r), (g, p))
    out = {}
    for (v, t, r), (g, p) in first.items():
        taken = {first[(v, t, k)][1] for k in range(1, r) if (v, t, k) in first}
        out[(v, t, r)] = (g, p, [m for m in members[g] if m not in taken])
    return out


def test_factored_sets_equal_written_out_sets(votes):
    members, noms, df, roster = votes
    want = {k: (len(s), p in s) for k, (g, p, s) in brute_sets(members, noms).items()}
    got = {(r.nominator, r.trait, r.rank): (r.set_size, r.winner_in_set)
           for r in choice.choice_sets(df, roster, ["pos"]).collect()}
    assert got == want


def test_all_members_when_exclusions_are_off(votes):
    members, noms, df, roster = votes
    sets = choice.choice_sets(df, roster, ["pos"], apply_exclusions=False)
    assert all(r.set_size == len(members[r.grp]) for r in sets.collect())


def test_choice_log_likelihood(votes, spark):
    members, noms, df, roster = votes
    theta = {(g, p, t): math.sin(p + len(t)) * 2 for g, ps in members.items() for p in ps for t in ("Boost", "Spike")}
    strengths = spark.createDataFrame([(*k, v) for k, v in theta.items()], "grp string, person int, trait string, theta double")
    got = {(r.nominator, r.trait, r.rank): r.log_lik
           for r in choice.log_likelihood(choice.choice_sets(df, roster, ["pos"]), strengths).collect()}
    for (v, t, r), (g, p, s) in brute_sets(members, noms).items():
        if p in s:
            want = theta[g, p, t] - math.log(sum(math.exp(theta[g, m, t]) for m in s))
            assert got[v, t, r] == pytest.approx(want, abs=1e-9)
        else:
            assert got[v, t, r] is None


def test_choice_strengths_climb_as_numpy_steps_to_a_zero_gradient(votes):
    members, noms, df, roster = votes
    live = [(g, t, p, s) for (v, t, r), (g, p, s) in brute_sets(members, noms).items() if p in s]
    w = {(g, t, m): 1.0 for g, t, _, _ in live for m in members[g]}
    wins = {k: sum((g, t, p) == k for g, t, p, _ in live) for k in w}

    def posterior():
        fit = sum(math.log(w[g, t, p] / sum(w[g, t, m] for m in s)) for g, t, p, s in live)
        return fit + sum(math.log(x) - x for x in w.values())

    def faced():
        out = {k: 0.0 for k in w}
        for g, t, _, s in live:
            inv = 1 / sum(w[g, t, m] for m in s)
            for m in s:
                out[g, t, m] += inv
        return out

    climbs = [posterior()]
    for _ in range(3):
        mean = {(g, t): np.mean([w[g, t, m] for m in members[g]]) for g, t, _ in w}
        w = {k: x / mean[k[:2]] for k, x in w.items()}
        f = faced()
        w = {k: (wins[k] + 1) / (f[k] + 1) for k in w}
        climbs.append(posterior())
    assert climbs == sorted(climbs)
    sets = choice.choice_sets(df, roster, ["pos"])
    got = choice.fit_strengths(sets, roster, 3).collect()
    assert not any(r.converged for r in got)
    for r in got:
        assert r.theta == pytest.approx(math.log(w[r.grp, r.trait, r.person]), abs=1e-9)
    got = choice.fit_strengths(sets, roster).collect()
    assert all(r.converged for r in got)
    w = {(r.grp, r.trait, r.person): math.exp(r.theta) for r in got}
    f = faced()
    for k, x in w.items():
        assert wins[k] + 1 - x * (f[k] + 1) == pytest.approx(0.0, abs=1e-6)


def test_slice_bounds_are_contiguous(votes):
    _, _, df, roster = votes
    rows = sorted((r.possibles_lower, r.possibles_upper)
                  for r in choice.slice_bounds(choice.choice_sets(df, roster, ["pos"])).collect())
    assert rows[0][0] == 1 and all(b[0] == a[1] + 1 for a, b in zip(rows, rows[1:]))


@pytest.fixture(scope="module")
def marks(spark):
    rng = np.random.default_rng(11)
    theta, lenient = rng.normal(size=40), rng.normal(scale=0.7, size=25)
    rows = []
    for rater in range(25):
        for ratee in range(40):
            x = theta[ratee] - lenient[rater] + rng.logistic()
            rows.append((rater, ratee, "t", 1 + int(np.searchsorted([-2.0, -0.7, 0.7, 2.0], x))))
    return theta, spark.createDataFrame(rows, "rater int, ratee int, trait string, y int")


def test_ordinal_fit_climbs_and_recovers(marks):
    theta, df = marks
    counts = df.withColumn("n", F.lit(1))
    heights, scores = [], None
    for steps in (1, 3, 6):
        scores, cuts = ordinal.fit_scores(df, 5, ["ratee", "trait"], ["rater"], steps)
        heights.append(ordinal.log_posterior(counts, scores, cuts, ["ratee", "trait"], ["rater"]))
    assert heights == sorted(heights)
    found = np.array([r.theta for r in scores.orderBy("ratee").collect()])
    ranks = [np.argsort(np.argsort(v)) for v in (theta, found)]
    assert np.corrcoef(*ranks)[0, 1] > 0.9
    for r in cuts.collect():
        assert all(b > a for a, b in zip(r.cuts, r.cuts[1:]))


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.2] + [0, 3, 1]
    g = rng.integers(0, 3, size=300)
    y = 2 + x @ [1.0, 0.0, -3.0] + 0.5 * g + rng.normal(scale=0.3, size=300)
    rows = [(i, f"g{g[i]}", *map(float, x[i]), float(y[i])) for i in range(300)]
    return x, g, y, spark.createDataFrame(rows, "id int, g string, a double, b double, c double, y double")


def test_least_squares_matches_normal_equations(design):
    x, g, y, df = design
    table, fitted = regression.fit_formula(df, "y ~ a + b + c + g")
    m = np.column_stack([np.ones(300), x, g == 1, g == 2]).astype(float)
    want = np.linalg.lstsq(m, y, rcond=None)[0]
    got = dict(rows_of(table))
    assert np.allclose([got[k] for k in ("(Intercept)", "a", "b", "c", "g_g1", "g_g2")], want)
    resid = np.array([r.residual for r in fitted.orderBy("id").collect()])
    assert np.allclose(resid, y - m @ want)


def glm_objective(x, y, beta, lam, alpha):
    sd = x.std(axis=0)
    b = beta[1:] * sd
    return ((y - beta[0] - x @ beta[1:]) ** 2).mean() / 2 + lam * (alpha * np.abs(b).sum() + (1 - alpha) * (b ** 2).sum() / 2)


def test_ridge_is_the_closed_form(design):
    x, _, y, df = design
    fit = regression.penalised_fits(df, "y", ["a", "b", "c"], [], "id", folds=5, alpha=0.0, n_lambdas=10).first()
    z = (x - x.mean(0)) / x.std(0)
    b = np.linalg.solve(z.T @ z / 300 + fit.lambda_min * np.eye(3), z.T @ (y - y.mean()) / 300) / x.std(0)
    assert np.allclose(fit.coef_min[1:], b) and fit.coef_min[0] == pytest.approx(y.mean() - x.mean(0) @ b)


def test_lasso_is_a_minimum_and_drops_noise(design):
    x, _, y, df = design
    fit = regression.penalised_fits(df, "y", ["a", "b", "c"], [], "id", folds=5, n_lambdas=20).first()
    assert fit.lambda_1se >= fit.lambda_min
    beta = np.array(fit.coef_1se)
    base = glm_objective(x, y, beta, fit.lambda_1se, 1.0)
    rng = np.random.default_rng(0)
    for _ in range(50):
        assert base <= glm_objective(x, y, beta + rng.normal(scale=0.01, size=4), fit.lambda_1se, 1.0) + 1e-9


def test_cross_validation_error_is_the_held_out_error(design):
    x, _, y, df = design
    xs = ["a", "b", "c"]
    fit = regression.penalised_fits(df, "y", xs, [], "id", folds=4, alpha=0.0, n_lambdas=6).first()
    folds = np.array([r[0] for r in df.orderBy("id").select(regression.fold_of("id", 4)).collect()])
    total = 0.0
    for k in range(4):
        tr, te = folds != k, folds == k
        z = (x[tr] - x[tr].mean(0)) / x[tr].std(0)
        b = np.linalg.solve(z.T @ z / tr.sum() + fit.lambda_min * np.eye(3),
                            z.T @ (y[tr] - y[tr].mean()) / tr.sum()) / x[tr].std(0)
        total += ((y[te] - y[tr].mean() - (x[te] - x[tr].mean(0)) @ b) ** 2).sum()
    assert fit.cv_error == pytest.approx(total / 300)


def test_prediction_uses_each_groups_own_fit(design):
    *_, df = design
    fits = regression.penalised_fits(df, "y", ["a", "c"], ["g"], "id", folds=3, alpha=0.0, n_lambdas=5)
    out = regression.predict(df, fits, ["a", "c"], ["g"])
    beta = {r.g: r.coef_min for r in fits.collect()}
    for r in out.limit(20).collect():
        assert r.prediction == pytest.approx(beta[r.g][0] + beta[r.g][1] * r.a + beta[r.g][2] * r.c)


def test_residual_of_own_line(design):
    *_, df = design
    out = regression.within_group_residual(df, "y", "a", ["g"], "res")
    means = out.groupBy("g").agg(F.avg("res").alias("m"), F.covar_pop("res", "a").alias("c")).collect()
    assert all(abs(r.m) < 1e-9 and abs(r.c) < 1e-9 for r in means)


def test_mixed_model_recovers_components(spark):
    rng = np.random.default_rng(4)
    rater, person = rng.normal(scale=1.0, size=60), rng.normal(scale=2.0, size=50)
    rows = [(i, j, float(x := rng.normal()), float(1 + 0.5 * x + rater[i] + person[j] + rng.normal(scale=0.5)))
            for i in range(60) for j in range(50) if rng.random() < 0.4]
    df = spark.createDataFrame(rows, "rater int, person int, x double, y double")
    fit = mixed.fit_intercepts(df, "y", ["x"], {"rater": ["rater"], "person": ["person"]})
    assert fit.converged
    assert fit.beta[1] == pytest.approx(0.5, abs=0.06)
    assert fit.residual_var == pytest.approx(0.25, abs=0.06)
    assert fit.effect_vars["person"] == pytest.approx(person.var(), rel=0.3)
    found = np.array([r.effect for r in fit.effects["person"].orderBy("person").collect()])
    assert np.corrcoef(found, person)[0, 1] > 0.98
    fitted = mixed.fitted_values(df, fit, "y", {"rater": ["rater"], "person": ["person"]})
    assert fitted.agg(F.avg(F.col("residual") * F.col("residual"))).first()[0] < 0.3


def test_mixed_fit_solves_the_dense_equations(spark):
    """200 rows with a missing key, a nested factor and clashing names: effects, coefficients and moments as by matrices."""
    rng = np.random.default_rng(6)
    n, id_, b = 200, rng.integers(0, 12, 200), rng.integers(0, 9, 200)
    g, x = b % 3, rng.normal(size=n)
    y = 1 + 0.5 * x + rng.normal(size=12)[id_] + rng.normal(size=9)[b] * 0.7 + rng.normal(size=n) * 0.7
    rows = [(int(i), int(j) if j else None, int(k), float(u), float(v)) for i, j, k, u, v in zip(id_, b, g, x, y)]
    df = spark.createDataFrame(rows, "id int, b int, n int, x double, y double").repartition(3)
    fit = mixed.fit_intercepts(df, "y", ["x"], {"id": ["id"], "b": ["b", "n"], "n": ["n"]})
    assert fit.converged and fit.gradient <= 1e-6
    levels = [(id_, 12, "id"), (b, 9, "b"), (g, 3, "n")]
    ones, z = np.c_[np.ones(n), x], np.concatenate([(v[:, None] == np.arange(k)) for v, k, _ in levels], axis=1).astype(float)
    penalty = np.concatenate([np.full(k, fit.residual_var / fit.effect_vars[f]) for _, k, f in levels])
    m = np.block([[ones.T @ ones, ones.T @ z], [z.T @ ones, z.T @ z + np.diag(penalty)]])
    want = np.linalg.solve(m, np.r_[ones.T @ y, z.T @ y])
    assert np.allclose(fit.beta, want[:2], atol=1e-6)
    got = np.zeros(24)
    for r in fit.effects["id"].collect():
        got[r.id] = r.effect
    for r in fit.effects["b"].collect():
        got[12 + (r.b or 0)] = r.effect
    for r in fit.effects["n"].collect():
        got[21 + r.n] = r.effect
    assert np.allclose(got, want[2:], atol=1e-6)
    rest = y - ones @ fit.beta
    within = [sum(((rest[v == k] - rest[v == k].mean()) ** 2).sum() for k in set(v)) for v, _, _ in levels]
    c = [(v[:, None] == np.arange(k)).astype(float) for v, k, _ in levels]
    left = [[n - k, *[0 if f == h else n - ((c[f].T @ c[h]) ** 2 / c[f].sum(0)[:, None]).sum() for h in range(3)]] for f, (_, k, _) in enumerate(levels)]
    left.append([n - 1, *[n - (v.sum(0) ** 2).sum() / n for v in c]])
    found = np.linalg.solve(np.array(left), [*within, ((rest - rest.mean()) ** 2).sum()])
    assert np.allclose([fit.residual_var, *fit.effect_vars.values()], [found[0], *np.maximum(found[1:], mixed.LEAST * found[0])], rtol=1e-4)


def test_eigenvalues_match_numpy(spark):
    rng = np.random.default_rng(9)
    traits = ["A", "B", "C"]
    data = {g: rng.normal(size=(12, 3)) @ rng.normal(size=(3, 3)) for g in ("x", "y")}
    rows = [(g, i, t, float(m[i, j])) for g, m in data.items() for i in range(12) for j, t in enumerate(traits)]
    long = spark.createDataFrame(rows, "grp string, id int, trait string, v double")
    pairs = covariance.pair_statistics(to_wide(long, ["grp", "id"], "trait", "v", traits), traits, ["grp"])
    out = covariance.variance_explained(pairs, traits, ["grp"])
    for g, m in data.items():
        want = np.linalg.eigvalsh(np.cov(m.T))[::-1]
        got = [(r.eigenvalue, r.cum_share) for r in out.filter(F.col("grp") == g).orderBy("component").collect()]
        assert np.allclose([v for v, _ in got], want) and np.allclose([s for _, s in got], np.cumsum(want) / want.sum())


def test_proximity_is_symmetric_and_bounded(spark):
    rows = [(i, "u" if i % 2 else "v", float(i % 2) * 10 + i % 5) for i in range(80)]
    people = spark.createDataFrame(rows, "id int, kind string, size double")
    leaves = proximity.leaf_vectors(people, "id", ["kind"], ["size"], trees=10)
    pairs = spark.createDataFrame([(0, 2), (2, 0), (0, 1), (1, 0), (3, 3)], "a int, b int")
    out = {(r.a, r.b): r.proximity for r in proximity.pair_proximity(pairs, leaves, "a", "b", "id").collect()}
    assert (3, 3) not in out and out[0, 2] == out[2, 0] and out[0, 1] == out[1, 0]
    assert all(0 <= v <= 1 for v in out.values()) and out[0, 2] > out[0, 1]


def test_shuffled_columns_keep_their_values(spark):
    people = spark.createDataFrame([(i, f"k{i % 3}", float(i)) for i in range(30)], "id int, kind string, size double")
    out = proximity.shuffled_columns(people, "id", ["kind", "size"])
    assert sorted(r.size for r in out.collect()) == [float(i) for i in range(30)]
    assert out.groupBy("kind").count().filter("count = 10").count() == 3


def test_coefficient_statistics_match_the_normal_equations(spark):
    random = np.random.default_rng(5)
    x, g = random.normal(100.0, 2.0, 40), np.arange(40) % 3
    y = 2.0 + 0.3 * x + 0.5 * (g == 1) + random.normal(size=40)
    rows = [(float(a), "abc"[b], float(c)) for a, b, c in zip(x, g, y)]
    got = {r.term: r for r in regression.coefficient_statistics(
        spark.createDataFrame(rows, "x double, g string, y double"), "y ~ x + g").collect()}
    design = np.stack([np.ones(40), x, g == 1, g == 2], axis=1).astype(float)
    beta, rest = np.linalg.lstsq(design, y, rcond=None)[:2]
    error = np.sqrt(rest[0] / 36 * np.diag(np.linalg.inv(design.T @ design)))
    at = np.linspace(0.0, 400.0, 4_000_001)
    density = (1 + at**2 / 36) ** -18.5
    for term, b, e in zip(["(Intercept)", "x", "g_b", "g_c"], beta, error):
        row = got[term]
        assert np.allclose([row.estimate, row.std_error, row.t], [b, e, b / e], rtol=1e-5)
        assert abs(row.p - density[at >= abs(b / e)].sum() / density.sum()) < 1e-4
        assert row.df == 36 and np.isclose(row.r2, 1 - rest[0] / ((y - y.mean()) ** 2).sum())
