"""Row order at scale: numbering, running sums, runs, buckets, codes, quantiles.

A window ordered over a large group is one task. These operators sort by range
over the whole cluster instead: a group may continue from one slice to the next,
and only the state at the slice edges (at most one open group per slice, so never
more rows than slices) is combined and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreframe.functions.missing import as_col
from scoreframe.operators.grouped import attach
from scoreframe.operators.joins import left_on
from scoreframe.session import cut_lineage

SLICE, POS = "__slice", "__pos"


def sliced(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """Range-sorted rows with slice number and position, written once.

    Range bounds are sampled anew by each run of a plan, so the numbered rows are
    written: all later steps must see the same slices.
    """
    keys = [as_col(c).asc_nulls_last() for c in by]
    keys += [as_col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn(SLICE, F.spark_partition_id())
        .withColumn(POS, F.monotonically_increasing_id())
    )
    return cut_lineage(numbered)


def _unslice(df: DataFrame) -> DataFrame:
    return df.drop(SLICE, POS)


def _numbered(rows: DataFrame, out: str) -> DataFrame:
    sizes = rows.groupBy(SLICE).agg(F.min(POS).alias("__start"), F.count(F.lit(1)).alias("__n"))
    # One row per slice: the only ungrouped window, bounded by the number of slices.
    before = F.coalesce(F.sum("__n").over(W.orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(SLICE, "__start", before.alias("__before"))
    return (
        rows.join(F.broadcast(starts), SLICE)
        .withColumn(out, F.col("__before") + F.col(POS) - F.col("__start") + 1)
        .drop("__before", "__start")
    )


def number_rows(df: DataFrame, order: list, out: str = "id") -> DataFrame:
    """1-based row number over the whole table."""
    return _unslice(_numbered(sliced(df, [], order), out))


def number_within(df: DataFrame, by: list[str], order: list, out: str = "row") -> DataFrame:
    """1-based row number within groups."""
    rows = _numbered(sliced(df, by, order), "__global")
    return _unslice(
        attach(rows, by, __first=F.min("__global"))
        .withColumn(out, F.col("__global") - F.col("__first") + 1)
        .drop("__global", "__first")
    )


def _local(by: list[str]):
    return W.partitionBy(SLICE, *[as_col(c) for c in by]).orderBy(POS)


def _running(rows: DataFrame, by: list[str], value: Column, out: str) -> DataFrame:
    local = _local(by).rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = rows.groupBy(SLICE, *by).agg(F.sum(value).alias("__sum"))
    earlier = W.partitionBy(*[as_col(c) for c in by]) if by else W.partitionBy()
    earlier = earlier.orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.withColumn("__carry", F.sum("__sum").over(earlier)).drop("__sum")
    carried = carried.filter(F.col("__carry").isNotNull())
    return (
        left_on(rows, F.broadcast(carried), [SLICE, *by])
        .withColumn(out, F.coalesce("__carry", F.lit(0)) + F.sum(value).over(local))
        .drop("__carry")
    )


def running_sum(df: DataFrame, by: list[str], order: list, column: str, out: str) -> DataFrame:
    return _unslice(_running(sliced(df, by, order), by, as_col(column), out))


def running_share(df: DataFrame, by: list[str], order: list, column: str, out: str) -> DataFrame:
    """Cumulative sum over group total."""
    rows = _running(sliced(df, by, order), by, as_col(column), "__run")
    return _unslice(
        attach(rows, by, __total=F.sum(as_col(column)))
        .withColumn(out, F.try_divide(F.col("__run"), F.col("__total")))
        .drop("__run", "__total")
    )


def _previous(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """Adds ``__prev`` and ``__has_prev`` (the previous row may hold NULL)."""
    last = rows.groupBy(SLICE, *by).agg(F.max_by(F.struct(as_col(column).alias("v")), POS).alias("__last"))
    edge = W.partitionBy(*[as_col(c) for c in by]).orderBy(SLICE)
    carried = last.withColumn("__carry", F.lag("__last").over(edge)).drop("__last")
    carried = carried.filter(F.col("__carry").isNotNull())
    here = F.lag(F.struct(as_col(column).alias("v"))).over(_local(by))
    before = F.coalesce(here, F.col("__carry"))
    return (
        left_on(rows, F.broadcast(carried), [SLICE, *by])
        .withColumn("__before", before)
        .withColumn("__prev", F.col("__before.v"))
        .withColumn("__has_prev", F.col("__before").isNotNull())
        .drop("__before", "__carry")
    )


def run_id(df: DataFrame, by: list[str], order: list, column: str, out: str) -> DataFrame:
    """0-based number of the run of equal values a row belongs to.

    Two missing values are equal, so a missing value starts a run of its own and
    numbering goes on after it.
    """
    rows = _previous(sliced(df, by, order), by, column)
    changed = F.col("__has_prev") & ~as_col(column).eqNullSafe(F.col("__prev"))
    rows = rows.withColumn("__changed", changed.cast("int"))
    runs = _running(rows, by, F.col("__changed"), out)
    return _unslice(runs.drop("__changed", "__prev", "__has_prev"))


def bucket(df: DataFrame, column: str, n: int, tiebreak: list[str], out: str) -> DataFrame:
    """SQL NTILE(n) over the non-missing values; missing values get no bucket."""
    known = number_rows(df.filter(as_col(column).isNotNull()), [column, *tiebreak], "__row")
    total = known.agg(F.count(F.lit(1))).scalar()
    size, extra = F.floor(total / n), total % n
    wide = extra * (size + 1)
    row = F.col("__row")
    tile = F.when(row <= wide, F.ceil(row / (size + 1))).otherwise(
        extra + F.ceil(F.try_divide(row - wide, size))
    )
    filled = known.withColumn(out, tile.cast("int")).drop("__row")
    empty = df.filter(as_col(column).isNull()).withColumn(out, F.lit(None).cast("int"))
    return filled.unionByName(empty)


def dictionary(df: DataFrame, column: str, code: str) -> DataFrame:
    """Dense 1-based codes of the sorted distinct non-missing values."""
    values = df.select(as_col(column)).filter(as_col(column).isNotNull()).distinct()
    return number_rows(values, [column], code)


def encode(df: DataFrame, column: str, code: str) -> DataFrame:
    return left_on(df, dictionary(df, column, code), [column])


def order_by_group_mean(df: DataFrame, by: list[str], column: str, out: str) -> DataFrame:
    """One row per category with its place when sorted by mean, then by key."""
    means = df.groupBy(*by).agg(F.avg(as_col(column)).alias("mean_value"))
    return number_rows(means, ["mean_value", *by], out)


def group_quantiles(df: DataFrame, by: list[str], column: str, probs: dict[str, float],
                    strict: bool = False) -> DataFrame:
    """Exact interpolated quantiles per group.

    Missing values are left out, and groups without a value dropped; with ``strict``
    a group that has a missing value gets NULL. Works on counts of distinct values,
    cumulated by the distributed running sum, so that no task holds the values of a
    group.
    """
    value, n = F.col("__value"), F.col("__n")
    counts = df.groupBy(*by, as_col(column).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    rows = _running(sliced(counts, by, ["__value"]), by, n, "__upto")
    present = F.sum(F.when(value.isNotNull(), n).otherwise(0))
    rows = attach(rows, by, __total=present, __gaps=F.max(value.isNull()))
    first = F.col("__upto") - n

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < F.col("__upto")), value))

    picks = {"__size": F.max("__total"), "__any_gap": F.max("__gaps")}
    for name, p in probs.items():
        place = (F.col("__total") - 1) * F.lit(float(p))
        picks[f"__lo_{name}"] = at(F.floor(place))
        picks[f"__hi_{name}"] = at(F.ceil(place))
    wide = rows.groupBy(*by).agg(*[c.alias(k) for k, c in picks.items()])
    outs = []
    for name, p in probs.items():
        place = (F.col("__size") - 1) * F.lit(float(p))
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        found = low + (high - low) * (place - F.floor(place))
        outs.append((F.when(~F.col("__any_gap"), found) if strict else found).alias(name))
    kept = wide if strict else wide.filter("__size > 0")
    return kept.select(*[as_col(c) for c in by], *outs)


def group_median(df: DataFrame, by: list[str], column: str, out: str) -> DataFrame:
    """Strict exact median: NULL when the group has a missing value."""
    return group_quantiles(df, by, column, {out: 0.5}, strict=True)


def positional_score(df: DataFrame, by: list[str], order: list, size: int, out: str) -> DataFrame:
    """``size`` for the first row of a group down to 1 for the last of ``size`` rows."""
    return number_within(df, by, order, "__place").withColumn(
        out, F.lit(size + 1) - F.col("__place")
    ).drop("__place")


def groups_not_of_size(df: DataFrame, by: list[str], size: int) -> DataFrame:
    """Groups for which ``positional_score`` of that size is not well defined."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != size)
