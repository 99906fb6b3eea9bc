"""From raw documents to a training mix: one stage after the other, each on what the last kept.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, folder) and returns
the documents it keeps, with the columns of documents, the last one the mix. ``run`` writes
every stage's rows to the shared folder and reads them back for the next.

A missing or empty text, a missing id or source, repeated rows and extra columns are
treated as each operator's docstring says; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.llm import mixture, nbsvm, pii, simhash, templates
from scoreframe.llm.text import unused
from scoreframe.session import cut_lineage, tune

#: No SQL states the fitted stages; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier rejects go: those of a score below 0.3."""
    labels = tune(spark).read.parquet(f"{folder}/labels.parquet")
    score = unused(docs, "_quality_score")
    return nbsvm.with_score(docs, nbsvm.fit(docs, labels), score).where(F.col(score) >= 0.3).drop(score)


def dedup_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays: the one of smallest id."""
    tune(spark)
    return simhash.first_of_groups(docs, size=3, max_bits=2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    return templates.without_leaks(docs, tune(spark).read.parquet(f"{folder}/benchmark.parquet"))


def privacy_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal data gives way to its kind, as <EMAIL>; ``n_chars`` follows the text."""
    tune(spark)
    out = pii.masked(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out


def mixing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The mix: for each document its source's target and the words taken, repeats counted."""
    tune(spark)
    return mixture.taken_words(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("pii", privacy_stage),
    ("mixing to target weights", mixing_stage),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = tune(spark).read.parquet(f"{folder}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
