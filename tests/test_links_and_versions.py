"""Identities over shared addresses, and published versions."""

import random

import pytest
from pyspark.sql import functions as F

from scoreframe.operators.links import components
from scoreframe.sources import store


def brute(rows):
    parent = {m: m for m, _ in rows if m is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for m, k in rows:
        if m is not None and k is not None:
            a, b = sorted((top(m), top(by.setdefault(k, m))))
            parent[b] = a
    return {m: top(m) for m in parent}


def test_components_equal_union_find(spark):
    """A long chain, a key that a third of the members share, loners, repeats, missing keys and members."""
    rng = random.Random(3)
    rows = [(i, f"c{i}") for i in range(40)] + [(i + 1, f"c{i}") for i in range(39)]
    rows += [(i, "hot") for i in range(100, 180)] + [(i, f"own{i}") for i in range(100, 240)]
    rows += [(rng.randrange(300, 380), f"r{rng.randrange(70)}") for _ in range(110)]
    rows += [(500, None), (None, "hot"), (100, "hot"), (None, None)]
    rng.shuffle(rows)
    got = components(spark.createDataFrame(rows, "m int, k string"), "m", "k", "first").collect()
    assert {r.m: r["first"] for r in got} == brute(rows) and len(got) == len(brute(rows))
    assert components(spark.createDataFrame([], "m int, k string"), "m", "k").count() == 0


def test_reader_sees_whole_versions_only(spark, tmp_path):
    root = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        store.read_version(spark, root)
    names = [store.publish_version(spark.range(n), root, keep=2) for n in (3, 4)]
    reader = store.read_version(spark, root)
    broken = spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).alias("id"))
    with pytest.raises(Exception, match="lost"):
        store.publish_version(broken, root)
    assert store.versions(spark, root) == names and store.read_version(spark, root).count() == 4
    names.append(store.publish_version(spark.range(5), root, keep=2))
    assert reader.count() == 4 and store.read_version(spark, root).count() == 5
    assert store.versions(spark, root) == names[1:] and store.read_version(spark, root, names[1]).count() == 4
    with pytest.raises(FileNotFoundError):
        store.read_version(spark, root, names[0])
