"""Reading survey tables with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreframe.functions.missing import as_col
from scoreframe.functions.text import extract

# One letter per column in a compact type string.
TYPE_LETTERS = {"c": T.StringType(), "n": T.DoubleType(), "l": T.BooleanType()}


def typed_schema(names: list[str], letters: str) -> T.StructType:
    if len(names) != len(letters):
        raise ValueError(f"{len(names)} names for {len(letters)} type letters")
    return T.StructType([T.StructField(n, TYPE_LETTERS[t]) for n, t in zip(names, letters)])


def scan_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               skip: int = 0) -> DataFrame:
    """Parquet, or CSV (by file ending) with ``skip`` lines above its header."""
    if not path.rstrip("/").endswith(".csv"):
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(path)
    if schema is None:
        raise ValueError("a CSV scan needs an explicit schema")
    reader = spark.read.schema(schema).option("enforceSchema", "true")
    if skip == 0:
        return reader.csv(path, header=True)
    # With the header off, the lines above the data arrive as the first rows of the
    # block that starts at offset 0 of each file, and are counted from there.
    raw = reader.csv(path, header=False).select(
        "*", F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
    )
    numbered = raw.withColumn("__at", F.monotonically_increasing_id())
    heads = numbered.filter("__block = 0").groupBy("__file").agg(F.min("__at").alias("__head"))
    kept = numbered.join(heads, "__file").filter(
        (F.col("__block") > 0) | (F.col("__at") - F.col("__head") > skip)
    )
    return kept.select(*schema.names)


def scan_tagged_union(spark: SparkSession, paths: dict[str, str], tag: str,
                      schema: T.StructType | None = None) -> DataFrame:
    """One scan per source, united by column name, each row tagged with its source."""
    parts = [scan_table(spark, p, schema).withColumn(tag, F.lit(name)) for name, p in paths.items()]
    return unite(parts)


def unite(parts: list[DataFrame]) -> DataFrame:
    """Union by name; a column that a part lacks is missing there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def scan_sheets(spark: SparkSession, folder: str, ids: list[str], key: str, value: str,
                sheets: list[str], tag: str = "Form") -> DataFrame:
    """A workbook landed as one parquet table per sheet: unpivot each, unite all.

    A sheet's questions differ from the next one's, so each is unpivoted by itself;
    a sheet without rows adds none.
    """
    from scoreframe.operators.reshape import to_long

    parts = []
    for name in sheets:
        sheet = spark.read.parquet(f"{folder}/{name}")
        questions = [c for c in sheet.columns if c not in ids]
        long = to_long(sheet.withColumns({q: as_col(q).cast("string") for q in questions}),
                       questions, key, value, position="pos")
        parts.append(long.withColumn(tag, F.lit(name)))
    return unite(parts)


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Literal table of any size; the optimizer sees its size and broadcasts it if it is small."""
    return spark.createDataFrame(rows, schema)


def draws_to_long(draws: DataFrame, parameter: str, ids: list[str]) -> DataFrame:
    """Fitted draws with one column per parameter cell to (ids, param, i, c, value)."""
    cells = [c for c in draws.columns if c.startswith(parameter + "[") or c.startswith(parameter + ".")]
    long = draws.select(*ids, *[as_col(c).cast("double").alias(c.replace(".", "_")) for c in cells])
    long = long.unpivot(ids, [c for c in long.columns if c not in ids], "variable", "value")
    found = extract("variable", r"([0-9]+)[,_]([0-9]+)\]?$", 1)
    other = extract("variable", r"([0-9]+)[,_]([0-9]+)\]?$", 2)
    return long.select(*ids, F.lit(parameter).alias("param"), found.cast("int").alias("i"),
                       other.cast("int").alias("c"), "value")


def scan_draws(spark: SparkSession, path: str, names: list[str], parameter: str,
               ids: list[str]) -> DataFrame:
    """CSV draws with ``#`` comment lines and a header row of parameter cells."""
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    draws = spark.read.schema(schema).csv(path, header=True, comment="#")
    return draws_to_long(draws, parameter, ids)
