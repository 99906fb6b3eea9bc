"""Wide to long, long to wide, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.functions.missing import as_col


def to_long(df: DataFrame, values: list[str], key: str, value: str, position: str | None = None,
            ids: list[str] | None = None) -> DataFrame:
    """Unpivot ``values``, keeping missing ones; every other column (or ``ids``) stays.

    Columns of different types are turned into text. ``position`` adds the 1-based
    ordinal of the source column, which later steps need for a stable order.
    """
    ids = ids if ids is not None else [c for c in df.columns if c not in values]
    types = {t for c, t in df.dtypes if c in values}
    if len(types) > 1:
        df = df.withColumns({c: as_col(c).cast("string") for c in values})
    long = df.unpivot([as_col(c) for c in ids], [as_col(c) for c in values], key, value)
    if position:
        places = [F.lit(x) for i, c in enumerate(values, 1) for x in (c, i)]
        long = long.withColumn(position, F.element_at(F.create_map(*places), as_col(key)))
    return long


def duplicate_cells(df: DataFrame, ids: list[str], key: str) -> DataFrame:
    """Cells that a pivot could not fill with one value."""
    return df.groupBy(*ids, key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def to_wide(df: DataFrame, ids: list[str], key: str, value: str, names: list, fill=None) -> DataFrame:
    """Pivot over the listed key values; check ``duplicate_cells`` first."""
    wide = df.groupBy(*ids).agg(
        *[F.max(F.when(as_col(key) == F.lit(n), as_col(value))).alias(str(n)) for n in names]
    )
    return wide.fillna(fill, [str(n) for n in names]) if fill is not None else wide


def list_length(x, separator: str = ", ") -> Column:
    return F.size(F.split(as_col(x), separator))


def split_columns(df: DataFrame, column: str, separator: str, into: list[str]) -> DataFrame:
    parts = F.split(as_col(column), separator)
    return df.withColumns({n: F.get(parts, i) for i, n in enumerate(into)}).drop(column)
