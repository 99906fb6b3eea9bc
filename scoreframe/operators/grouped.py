"""Grouped statistics returned to the rows they came from.

Every operator here aggregates first, so a group shrinks to one row per map task
before it is exchanged, and then joins the statistics back. No window holds a
whole group, so a group with a third of all rows is spread over many tasks.

The statistics are written before the join. Their size is then known when the join
is planned: small ones are broadcast and the rows are not shuffled at all, large
ones are joined by shuffle, split at a hot key by adaptive execution. A chain of
such steps reads its input once per step and computes no statistic twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.functions.missing import as_col, distinct_with_missing, strict_max, strict_min
from scoreframe.operators.joins import keep_known, left_on
from scoreframe.session import cut_lineage


def attach(df: DataFrame, by: list[str], **aggregates: Column) -> DataFrame:
    """Add group aggregates as columns; an empty ``by`` means the whole table."""
    columns = [c.alias(name) for name, c in aggregates.items()]
    if not by:
        whole = cut_lineage(df.agg(*columns))
        return df.withColumns({n: whole.select(n).scalar() for n in aggregates})
    return left_on(df, cut_lineage(df.groupBy(*by).agg(*columns)), by)


def zscore(df: DataFrame, columns: dict[str, str] | list[str], by: list[str]) -> DataFrame:
    """Centre and scale within groups; NULL for constant or single-value groups.

    ``columns`` maps input to output names, or lists columns scaled in place.
    """
    if not isinstance(columns, dict):
        columns = {c: c for c in columns}
    stats = {}
    for i, c in enumerate(columns):
        stats[f"__avg{i}"] = F.avg(as_col(c))
        stats[f"__sd{i}"] = F.stddev_samp(as_col(c))
    out = attach(df, by, **stats)
    scaled = {
        new: F.try_divide(as_col(c) - F.col(f"__avg{i}"), F.col(f"__sd{i}"))
        for i, (c, new) in enumerate(columns.items())
    }
    return out.withColumns(scaled).drop(*stats)


def centre(df: DataFrame, column: str, by: list[str], out: str) -> DataFrame:
    return (
        attach(df, by, __avg=F.avg(as_col(column)))
        .withColumn(out, as_col(column) - F.col("__avg"))
        .drop("__avg")
    )


def share(df: DataFrame, column: str, by: list[str], out: str) -> DataFrame:
    """Value over the group total; missing values are left out of the total."""
    return (
        attach(df, by, __total=F.sum(as_col(column)))
        .withColumn(out, F.try_divide(as_col(column), F.col("__total")))
        .drop("__total")
    )


def spread_within(df: DataFrame, column: str, by: list[str], out: str) -> DataFrame:
    """Strict max minus min of the group on every row."""
    return attach(df, by, **{out: strict_max(column) - strict_min(column)})


def value_where(df: DataFrame, column: str, condition: Column, by: list[str], out: str) -> DataFrame:
    """The value of ``column`` on the group's one row that meets ``condition``."""
    return attach(df, by, **{out: F.max(F.when(condition, as_col(column)))})


def violations_of_one_match(df: DataFrame, condition: Column, by: list[str]) -> DataFrame:
    """Groups in which ``value_where`` is not well defined."""
    hits = F.sum(F.when(condition, 1).otherwise(0))
    return df.groupBy(*by).agg(hits.alias("n_matches")).filter("n_matches <> 1")


def keep_groups_with(df: DataFrame, condition: Column, by: list[str]) -> DataFrame:
    """All rows of the groups that have at least one row meeting ``condition``."""
    return keep_known(df, cut_lineage(df.filter(condition).select(*[as_col(c) for c in by]).distinct()), by)


def keep_latest(df: DataFrame, column: str, by: list[str], latest: bool = True) -> DataFrame:
    """Rows at the group's latest (or first) time; ties are all kept."""
    agg = F.max if latest else F.min
    out = attach(df, by, __edge=agg(as_col(column)))
    return out.filter(as_col(column) == F.col("__edge")).drop("__edge")


def keep_within_range(df: DataFrame, column: str, by: list[str], inclusive: bool = True) -> DataFrame:
    """Rows between the group's own strict min and max.

    Inclusive by default: it keeps complete groups whole and drops a group that
    has a missing value. ``inclusive=False`` trims both extremes.
    """
    out = attach(df, by, __lo=strict_min(column), __hi=strict_max(column))
    value = as_col(column)
    if inclusive:
        kept = value.between(F.col("__lo"), F.col("__hi"))
    else:
        kept = (value > F.col("__lo")) & (value < F.col("__hi"))
    return out.filter(kept).drop("__lo", "__hi")


def order_key(order: list[str]) -> Column:
    """Comparable key with missing values last."""
    parts = []
    for c in order:
        parts += [as_col(c).isNull(), as_col(c)]
    return F.struct(*[p.alias(f"o{i}") for i, p in enumerate(parts)])


def first_value(x, order: list[str]) -> Column:
    return F.min_by(as_col(x), order_key(order))


def first_present(x, order: list[str]) -> Column:
    """First non-missing value of the group."""
    return F.min_by(as_col(x), F.when(as_col(x).isNotNull(), order_key(order)))


def first_rows(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row per group, the first in ``order`` (make the order total)."""
    row = F.struct(*[as_col(c) for c in df.columns])
    picked = df.groupBy(*by).agg(F.min_by(row, order_key(order)).alias("__row"))
    return picked.select("__row.*")


def cap_repeats(df: DataFrame, by: list[str], order: list[str], uncapped: Column) -> DataFrame:
    """Keep every row where ``uncapped`` holds and one row per group elsewhere."""
    free = F.coalesce(uncapped, F.lit(False))
    return df.filter(free).unionByName(first_rows(df.filter(~free), by, order))


def response_profile(df: DataFrame, rater: str, value: str) -> DataFrame:
    """Number of marks and of different marks per rater (straight-liner check)."""
    return df.groupBy(rater).agg(
        F.count(F.lit(1)).alias("n"), distinct_with_missing(value).alias("n_values")
    )


def null_fractions(df: DataFrame) -> DataFrame:
    """Share of missing values of every column, in one pass."""
    return df.agg(*[F.avg(as_col(c).isNull().cast("double")).alias(c) for c in df.columns])


def signal_to_noise(df: DataFrame, score: str, rater: str, ratee: str, trait: str) -> DataFrame:
    """Spread between people over spread within people, per trait, weighted by rows.

    Scores are scaled within raters. One aggregation per (trait, person) yields both
    spreads: between the means, and within them. A person with an undefined scaled
    score is left out.
    """
    z = zscore(df.filter(as_col(score).isNotNull()), {score: "z"}, [rater])
    people = z.groupBy(trait, ratee).agg(
        F.count(F.lit(1)).alias("n"), F.count("z").alias("n_z"), F.avg("z").alias("m"), F.var_pop("z").alias("v"))
    n, m = F.col("n"), F.col("m")
    whole = people.filter("n = n_z").groupBy(trait).agg(
        F.sum("n").alias("n_rows"), F.sum(n * m).alias("s1"), F.sum(n * m * m).alias("s2"),
        F.sum(n * F.col("v")).alias("within"))
    freedom = F.col("n_rows") - 1
    between = F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n_rows"), F.lit(0.0))
    return whole.select(
        trait, F.sqrt(F.try_divide(between, freedom)).alias("sd_people"),
        F.sqrt(F.try_divide(F.col("within"), freedom)).alias("sd_noise"),
    ).withColumn("signal_to_noise", F.try_divide("sd_people", "sd_noise"))
