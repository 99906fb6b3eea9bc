"""Records that belong to one person: the connected components of shared addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.functions.missing import as_col
from scoreframe.session import cut_lineage


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v), u > v: neighbours move to the least node next to them.

    A large step hangs each node's greater neighbours on the least of all its neighbours, a
    small one the node and its lesser neighbours. The least neighbour is a partially
    aggregated minimum joined back, so a node of any degree is spread over tasks.
    """
    pairs = edges
    if large:
        pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = pairs.join(least, "u")
    if large:
        out = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.filter("u > v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38, 0)"))).first()
    return tuple(row)


def components(lookup: DataFrame, member: str, key: str, out: str = "component") -> DataFrame:
    """(member, out): each member beside the least member it is connected to over shared keys.

    ``lookup`` has a row for each key of a member; rows without a key link nothing, rows
    without a member are left out. A key's members are linked to their least one, which is
    linear in the rows however many share the key; steps go on until no edge changes, about
    as many as the logarithm of the longest chain.
    """
    rows = cut_lineage(lookup.select(as_col(member).alias("u"), as_col(key).alias("k")).filter("u IS NOT NULL").distinct())
    keyed = rows.filter("k IS NOT NULL")
    first = keyed.groupBy("k").agg(F.min("u").alias("v"))
    edges = cut_lineage(keyed.join(first, "k").filter("u > v").select("u", "v").distinct())
    before, now = None, _mark(edges)
    while now != before:
        edges = cut_lineage(_starred(cut_lineage(_starred(edges, large=True)), large=False))
        before, now = now, _mark(edges)
    found = rows.select("u").distinct().join(edges, "u", "left")
    return found.select(F.col("u").alias(member), F.coalesce("v", "u").alias(out))
