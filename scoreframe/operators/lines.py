"""Straight-line fits per facet, with optional weights and axis limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.functions.missing import as_col, correlation, intercept, slope


def within_limits(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows a plotting limit keeps: they alone enter the fit."""
    return df.filter(as_col(column).between(low, high))


def fit_lines(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """Slope, intercept, r and number of points per facet."""
    return df.groupBy(*by).agg(
        slope(y, x).alias("slope"),
        intercept(y, x).alias("intercept"),
        correlation(x, y).alias("r"),
        F.regr_count(as_col(y), as_col(x)).alias("n_points"),
    )


def fit_weighted_lines(df: DataFrame, x: str, y: str, weight: str, by: list[str] = ()) -> DataFrame:
    """Weighted least-squares line per facet, from one pass of weighted sums."""
    known = df.filter(as_col(x).isNotNull() & as_col(y).isNotNull() & as_col(weight).isNotNull())
    w, px, py = as_col(weight), as_col(x), as_col(y)
    sums = known.groupBy(*by).agg(
        F.sum(w).alias("sw"), F.sum(w * px).alias("sx"), F.sum(w * py).alias("sy"),
        F.sum(w * px * px).alias("sxx"), F.sum(w * px * py).alias("sxy"),
        F.count(F.lit(1)).alias("n_points"),
    )
    tilt = F.try_divide(F.expr("sw * sxy - sx * sy"), F.expr("sw * sxx - sx * sx"))
    return sums.withColumn("slope", tilt).withColumn(
        "intercept", F.try_divide(F.expr("sy - slope * sx"), F.col("sw"))
    ).select(*by, "slope", "intercept", "n_points")
