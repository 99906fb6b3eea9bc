"""Choosing and naming columns when the plan is built."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cols_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Column names from ``first`` to ``last``, both included."""
    names = df.columns
    start, end = names.index(first), names.index(last)
    if start > end:
        raise ValueError(f"{first!r} comes after {last!r}")
    return names[start : end + 1]


def cols_containing(df: DataFrame, text: str) -> list[str]:
    return [c for c in df.columns if text.lower() in c.lower()]


def cols_except(df: DataFrame, *drop: str) -> list[str]:
    return [c for c in df.columns if c not in drop]


def safe_name(name: str) -> str:
    cleaned = re.sub(r"[^A-Za-z0-9_]", "_", name)
    return cleaned if re.match(r"[A-Za-z_]", cleaned) else "X" + cleaned


def safe_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[safe_name(c) for c in df.columns])


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(
        *[F.col(f"`{c}`").alias(c if c in keep else prefix + c) for c in df.columns]
    )
