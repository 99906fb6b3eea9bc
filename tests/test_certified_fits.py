"""Optimality of penalised fits, and proximity over trees grown without the pair."""

import math

import numpy as np
from pyspark.sql import functions as F

from scoreframe.operators.proximity import bag_count, bagged_leaves, out_of_bag_proximity
from scoreframe.operators.regression import optimality, penalised_fits


def scores(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        x = rng.normal(size=4)
        rows.append((i, ("a", None, "c")[i % 3], *map(float, x), 5.0, float(x[0] * 2 - x[1] * (i % 3) + rng.normal())))
    return spark.createDataFrame(rows, "i int, g string, w double, x double, y double, z double, flat double, s double")


def test_penalised_fits_meet_their_conditions_and_changed_ones_do_not(spark):
    df, xs = scores(spark), ["w", "x", "y", "z", "flat"]
    for alpha in (1.0, 0.4, 0.0):
        fits = penalised_fits(df, "s", xs, ["g"], "i", folds=5, alpha=alpha)
        for which, penalty in (("coef_min", "lambda_min"), ("coef_1se", "lambda_1se")):
            found = optimality(df, fits, "s", xs, ["g"], which, penalty, alpha).collect()
            assert len(found) == 18 and max(r.off for r in found) < 1e-7
    moved = fits.withColumn("coef_min", F.transform("coef_min", lambda b: b * 1.01))
    assert max(r.off for r in optimality(df, moved, "s", xs, ["g"], "coef_min", "lambda_min", 0.0).collect()) > 1e-3
    # a term set to zero although it pulls harder than the penalty
    lasso = penalised_fits(df, "s", xs, ["g"], "i", folds=5)
    zeroed = lasso.withColumn("coef_min", F.transform("coef_min", lambda b, i: F.when(i == 1, 0.0).otherwise(b)))
    off = {(r.g, r.term): r.off for r in optimality(df, zeroed, "s", xs, ["g"], "coef_min", "lambda_min").collect()}
    assert all(off[g, "w"] > 0.1 for g in ("a", None, "c"))


def people(spark, n=90):
    kinds = ["p", "q", "r"]
    return spark.createDataFrame([(i, kinds[i % 3], float(i % 3 * 10 + i % 4)) for i in range(n)], "id long, kind string, size double")


def test_bags_are_poisson_and_do_not_depend_on_partitions(spark):
    counts = spark.range(20_000).select(bag_count(F.col("id").cast("string"), 1, 7).alias("k"))
    share = {r.k: r["count"] / 20_000 for r in counts.groupBy("k").count().collect()}
    assert all(abs(share[k] - math.exp(-1) / math.factorial(k)) < 0.015 for k in range(4))
    df = people(spark)
    one, many = (bagged_leaves(df.repartition(n), "id", ["kind"], ["size"], trees=4, depth=4) for n in (1, 7))
    got = {r.id: (list(r.leaves), list(r.bags)) for r in one.collect()}
    assert got == {r.id: (list(r.leaves), list(r.bags)) for r in many.collect()} and len(got) == 90
    assert all(any(b[t] == 0 for _, b in got.values()) and any(b[t] > 1 for _, b in got.values()) for t in range(4))


def test_proximity_counts_only_trees_that_know_neither(spark):
    df = people(spark)
    leaves = bagged_leaves(df, "id", ["kind"], ["size"], trees=12, depth=4)
    known = {r.id: (list(r.leaves), list(r.bags)) for r in leaves.collect()}
    pairs = [(a, b) for a in range(0, 90, 7) for b in range(0, 90, 4)] + [(1, 1_000), (None, 2), (3, 3), (1, 1_000)]
    got = {(r.a, r.b): r for r in out_of_bag_proximity(spark.createDataFrame(pairs, "a long, b long"), leaves, "a", "b", "id").collect()}
    assert set(got) == {(a, b) for a, b in pairs if a is not None and a != b}
    near, far = [], []
    for (a, b), row in got.items():
        if b == 1_000:
            assert (row.n_free, row.n_met, row.proximity) == (0, 0, None)
            continue
        free = [t for t in range(12) if known[a][1][t] == 0 and known[b][1][t] == 0]
        met = [t for t in free if known[a][0][t] == known[b][0][t]]
        assert (row.n_free, row.n_met) == (len(free), len(met))
        assert row.proximity == (len(met) / len(free) if free else None)
        if free:
            (near if a % 3 == b % 3 else far).append(row.proximity)
    assert np.mean(near) > np.mean(far) + 0.2


def test_counted_evidence_equals_mark_by_mark(spark):
    from scoreframe.catalog.jobs import interviews_long, teacher_long
    from scoreframe.catalog.jobs_scores import noms_count
    from scoreframe.plans import scores as plans
    from scoreframe.plans.study import Study

    st = Study(spark, "/root/testdata/sf0.001")
    given = interviews_long(st), teacher_long(st), noms_count(st)
    keys = ["trait", "student", "type", "evidence_type", F.round("value", 9).alias("value")]
    one_by_one = plans.evidence_panel(*given).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    counted = plans.evidence_counts(*given).groupBy(*keys).agg(F.sum("n").alias("n"))
    assert one_by_one.count() > 100
    assert one_by_one.exceptAll(counted).count() == 0 and counted.exceptAll(one_by_one).count() == 0
