"""One registered query per operator, each with the SQL that checks it."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from scoreframe.plans.study import Study, with_views
from scoreframe.session import tune

QUERIES: dict = {}
CHECKS: dict[str, str] = {}
MODULES = ["tables", "rows", "joining", "shapes", "aggregates", "windows", "scalars",
           "jobs", "jobs_scores", "fits", "figures"]


def query(name: str, sql: str | None = None):
    """Register ``fn(study)`` under ``name`` with its checking SQL."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Study(tune(spark), folder))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = with_views(sql)
        return fn

    return register


def load() -> None:
    for module in MODULES:
        import_module(f"scoreframe.catalog.{module}")
