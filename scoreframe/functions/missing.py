"""Missing-value rules: strict aggregates, three-way conditionals, safe division.

A *strict* aggregate is NULL when any input of the group is NULL; a *lenient*
one skips NULLs, which is what Spark's own aggregates do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(x: str | Column) -> Column:
    return F.col(f"`{x}`") if isinstance(x, str) else x


def all_present(x: str | Column) -> Column:
    return F.count(as_col(x)) == F.count(F.lit(1))


def _strict(agg, x):
    return F.when(all_present(x), agg(as_col(x)))


def strict_avg(x):
    return _strict(F.avg, x)


def strict_sum(x):
    return _strict(F.sum, x)


def strict_min(x):
    return _strict(F.min, x)


def strict_max(x):
    return _strict(F.max, x)


def strict_sd(x):
    return _strict(F.stddev_samp, x)


def count_matches(is_match: Column) -> Column:
    """Number of true rows; NULL when the outcome of any row is unknown."""
    return strict_sum(is_match.cast("int"))


def distinct_with_missing(x) -> Column:
    """Distinct values, a missing value being one more value."""
    return F.count_distinct(as_col(x)) + F.max(as_col(x).isNull().cast("int"))


def weighted_avg(x, w) -> Column:
    """Weighted mean, NULL if any value or weight is missing."""
    value, weight = as_col(x), as_col(w)
    return F.when(
        all_present(value * weight), F.try_divide(F.sum(value * weight), F.sum(weight))
    )


def if_known(condition: Column, yes, no) -> Column:
    """Two-way choice that stays NULL where the condition is NULL."""
    return F.when(condition, yes).when(~condition, no)


def missing_as_number(x) -> Column:
    """NaN is a missing value too."""
    return F.when(~F.isnan(as_col(x)), as_col(x))


def _paired(x, y) -> tuple[Column, Column]:
    """Both values where both are present."""
    return F.when(as_col(y).isNotNull(), as_col(x)), F.when(as_col(x).isNotNull(), as_col(y))


def correlation(x, y) -> Column:
    """Pearson correlation; NULL when either side does not vary."""
    px, py = _paired(x, y)
    return F.try_divide(F.covar_pop(px, py), F.sqrt(F.var_pop(px) * F.var_pop(py)))


def slope(y, x) -> Column:
    """Least-squares slope; NULL when ``x`` does not vary."""
    px, py = _paired(x, y)
    return F.try_divide(F.covar_pop(px, py), F.var_pop(px))


def intercept(y, x) -> Column:
    px, py = _paired(x, y)
    return F.avg(py) - slope(y, x) * F.avg(px)


def add_all(columns) -> Column:
    """Row sum; NULL if any term is NULL."""
    total = as_col(columns[0])
    for c in columns[1:]:
        total = total + as_col(c)
    return total


def fill_and_flag(df, columns, value):
    """``missing_<c>`` flags first, then the constant in place of NULL."""
    flags = {f"missing_{c.lower()}": as_col(c).isNull() for c in columns}
    fills = {c: F.coalesce(as_col(c), F.lit(value)) for c in columns}
    return df.withColumns(flags).withColumns(fills)
