"""Left joins with NULL-matching keys, membership flags and identity lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.functions.columns import prefixed


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def left_on(left: DataFrame, right: DataFrame, on: list) -> DataFrame:
    """Left outer equi join in which a missing key matches a missing key.

    ``on`` holds names or ``(left, right)`` pairs; right keys are dropped. The
    optimizer picks broadcast or shuffle from the measured size of ``right``.
    """
    pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in on]
    keys = [rk for _, rk in pairs]
    marked = right.select(
        *[_quoted(rk).alias(f"__key_{i}") for i, rk in enumerate(keys)],
        *[_quoted(c) for c in right.columns if c not in keys],
    )
    condition = reduce(
        lambda a, b: a & b,
        [left[f"`{lk}`"].eqNullSafe(marked[f"__key_{i}"]) for i, (lk, _) in enumerate(pairs)],
    )
    return left.join(marked, condition, "left").drop(*[f"__key_{i}" for i in range(len(pairs))])


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the two tables share no column name")
    return shared


def natural_left(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every column name both tables have."""
    return left_on(left, right, shared_columns(left, right))


def join_in_role(df: DataFrame, dimension: DataFrame, key: str, role_key: str, role: str) -> DataFrame:
    """Attach ``dimension`` under a role: its columns get the prefix ``role_``."""
    return left_on(df, prefixed(dimension, f"{role}_", keep=(key,)), [(role_key, key)])


def keep_known(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key occurs in ``keys``; a missing key occurs if ``keys`` has one."""
    wanted = keys.select(*[_quoted(k).alias(f"__key_{i}") for i, k in enumerate(on)]).distinct()
    condition = reduce(
        lambda a, b: a & b,
        [df[f"`{k}`"].eqNullSafe(wanted[f"__key_{i}"]) for i, k in enumerate(on)],
    )
    return df.join(wanted, condition, "left_semi")


def flag_member(df: DataFrame, key: Column, members: DataFrame, member_key: Column, flag: str) -> DataFrame:
    """Boolean column: does ``key`` occur in ``members``? Never NULL."""
    known = members.select(member_key.alias("__member")).distinct().withColumn("__hit", F.lit(True))
    probe = df.withColumn("__probe", key)
    out = left_on(probe, known, [("__probe", "__member")])
    return out.withColumn(flag, F.coalesce("__hit", F.lit(False))).drop("__hit", "__probe")


def identity_lookup(people: DataFrame, id_col: str, email_cols: list[str]) -> DataFrame:
    """One row per (email, person): every address a person is known under."""
    long = people.unpivot([id_col], email_cols, "__source", "email")
    return long.filter(F.col("email").isNotNull()).select(
        F.lower("email").alias("email"), id_col
    ).distinct()


def ambiguous_keys(lookup: DataFrame, key: str) -> DataFrame:
    """Keys that lead to more than one row, with the number of rows."""
    return lookup.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
