"""Writing score tables and day-stamped snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def publish(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace the published table; the write is a distributed one."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def snapshot_path(root: str, name: str, as_of: str) -> str:
    return f"{root}/{name}/as_of={as_of}"


def save_snapshot(df: DataFrame, root: str, name: str, as_of: str) -> str:
    path = snapshot_path(root, name, as_of)
    publish(df, path)
    return path


def has_snapshot(spark: SparkSession, root: str, name: str, as_of: str) -> bool:
    """A snapshot counts once its write is committed."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(snapshot_path(root, name, as_of) + "/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def snapshot(spark: SparkSession, root: str, name: str, as_of: str,
             build: Callable[[], DataFrame]) -> DataFrame:
    """Reuse the table stamped ``as_of`` or build and save it."""
    if not has_snapshot(spark, root, name, as_of):
        save_snapshot(build(), root, name, as_of)
    return spark.read.parquet(snapshot_path(root, name, as_of))


def history(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All snapshots; ``as_of`` is a partition column, so dates prune files."""
    return spark.read.parquet(f"{root}/{name}")


def _at(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the finished versions of a table, oldest first."""
    fs, where = _at(spark, f"{root}/finished")
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def publish_version(df: DataFrame, root: str, keep: int = 3) -> str:
    """Write a new version beside the old ones, then make it the current one; returns its name.

    The rows go to a folder of their own. Only when they are all there does an empty file of
    the version's name appear under ``finished``, in one step, so a reader sees the old
    version or the new one and a failed write changes nothing. Readers that began earlier go
    on with the old files: the last ``keep`` versions stay, older ones are removed, their mark
    first. Of two writers at the same time the one with the greater name is current.
    """
    if keep < 1:
        raise ValueError("keep one version at least")
    spark = df.sparkSession
    known = versions(spark, root)
    name = f"{int(known[-1].split('-')[0]) + 1 if known else 1:012d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/rows/{name}")
    fs, mark = _at(spark, f"{root}/finished/{name}")
    if not fs.createNewFile(mark):
        raise FileExistsError(f"{root}/finished/{name}")
    for old in versions(spark, root)[:-keep]:
        for part in ("finished", "rows"):
            fs, where = _at(spark, f"{root}/{part}/{old}")
            fs.delete(where, True)
    return name


def read_version(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    """The current version of a published table, or the named one."""
    known = versions(spark, root)
    if not known or (name is not None and name not in known):
        raise FileNotFoundError(f"no version {name or ''} under {root}")
    return spark.read.parquet(f"{root}/rows/{name or known[-1]}")
