"""Ordered operators against plain Python, with one group spanning most slices."""

import random
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreframe.operators import grouped, ordered
from tests.conftest import rows_of


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(20)}", i, rng.choice([None, "p", "q"]), rng.randrange(9))
            for i in range(3000)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, pos int, v string, n int").repartition(6)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def test_hot_group_spans_slices(hot):
    _, df = hot
    rows = ordered.sliced(df, ["k"], ["pos"])
    assert rows.filter("k = 'hot'").select(ordered.SLICE).distinct().count() > 3


def test_number_within(hot):
    rows, df = hot
    want = {(k, r[1]): i for k, g in by_key(rows).items() for i, r in enumerate(g, 1)}
    got = {(r.k, r.pos): r.row for r in ordered.number_within(df, ["k"], ["pos"]).collect()}
    assert got == want


def test_running_sum_and_share(hot):
    rows, df = hot
    want = {(k, r[1]): s for k, g in by_key(rows).items() for r, s in zip(g, accumulate(x[3] for x in g))}
    got = {(r.k, r.pos): r.s for r in ordered.running_sum(df, ["k"], ["pos"], "n", "s").collect()}
    assert got == want
    last = ordered.running_share(df, ["k"], ["pos"], "n", "s").groupBy("k").agg(F.max("s").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in last)


def test_run_id(hot):
    rows, df = hot
    want = {}
    for k, g in by_key(rows).items():
        run = 0
        for i, r in enumerate(g):
            run += i > 0 and r[2] != g[i - 1][2]
            want[(k, r[1])] = run
    got = {(r.k, r.pos): r.run for r in ordered.run_id(df, ["k"], ["pos"], "v", "run").collect()}
    assert got == want


def test_bucket_sizes_differ_by_at_most_one(hot):
    _, df = hot
    sizes = [r[1] for r in rows_of(ordered.bucket(df, "n", 7, ["pos"], "b").groupBy("b").count(), "b")]
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True) and len(sizes) == 7


def test_codes_are_dense(hot):
    rows, df = hot
    codes = dict(rows_of(ordered.dictionary(df, "k", "c").select("k", "c")))
    assert codes == {k: i for i, k in enumerate(sorted({r[0] for r in rows}), 1)}


def test_quantiles_match_numpy(hot):
    rows, df = hot
    got = {r.k: (r.a, r.b) for r in ordered.group_quantiles(df, ["k"], "n", {"a": 0.05, "b": 0.5}).collect()}
    for k, g in by_key(rows).items():
        assert np.allclose(got[k], np.quantile([r[3] for r in g], [0.05, 0.5]))


def test_grouped_statistics_use_no_window(hot):
    _, df = hot
    plans = [grouped.zscore(df, {"n": "z"}, ["k"]), grouped.first_rows(df, ["k"], ["pos"]),
             grouped.keep_latest(df, "pos", ["k"]), grouped.share(df, "n", ["k"], "s")]
    for p in plans:
        assert "Window" not in p._jdf.queryExecution().executedPlan().toString()


def test_scaled_groups_have_mean_zero_and_sd_one(hot):
    _, df = hot
    z = grouped.zscore(df, {"n": "z"}, ["k"]).groupBy("k").agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s"))
    assert all(abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9 for r in z.collect())


def test_hot_key_join_is_split(spark, hot):
    """With the thresholds lowered, adaptive execution splits the hot key's partition."""
    _, df = hot
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = grouped.attach(df, ["k"], total=F.sum("n"))
        assert out.count() == 3000
        out = grouped.attach(df, ["k"], total=F.sum("n"))
        out.collect()
        assert "skew" in out._jdf.queryExecution().executedPlan().toString().lower()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_kept_rows_after_cap(table):
    df = table([("i", "s", 1), ("i", "s", 2), ("t", "s", 3), ("t", "s", 4)], "type string, who string, v int")
    out = grouped.cap_repeats(df, ["type", "who"], ["v"], F.col("type") == "i")
    assert rows_of(out, "v") == [("i", "s", 1), ("i", "s", 2), ("t", "s", 3)]
