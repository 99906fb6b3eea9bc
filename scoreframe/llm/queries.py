"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.llm import (
    licenses, main_text, mixture, nbsvm, pii, ranked_search, simhash, suffix_dedup, templates, url_model, warc, weak_rules, whitening,
)
from scoreframe.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(job):
        QUERIES[name] = job
        if sql:
            CHECKS[name] = sql
        return job
    return keep


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{table}.parquet")


@register("op9_simhash_near_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, folder, "documents"), size=3, max_bits=2)


@register("op4_suffix_array_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.without_repeats(read(spark, folder, "documents"), length=400)


@register("op10_quality_classifier")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return nbsvm.quality(read(spark, folder, "documents"), read(spark, folder, "labels"), cut=0.3)


@register("op1_quality_rules")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return weak_rules.judge(read(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "posterior")


@register("op7_source_mixing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.taken_words(read(spark, folder, "documents")).drop("source")


#: Verdict, host and path of each rule.
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


@register("op5_url_filters")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return url_model.judge(read(spark, folder, "pages"), URL_RULES)


@register("op6_benchmark_decontamination")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return templates.leaks(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@register("op3_personal_data")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(read(spark, folder, "documents"))


@register("op2_license_scans")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files: every tenth is a licence file of its language's directory, every
    hundredth one of its source's, the others lie in directories of a hundred."""
    path = F.expr("""concat_ws('/', source, case
        when doc_id % 100 = 0 then concat('LICENSE-', doc_id)
        when doc_id % 10 = 0 then concat_ws('/', lang, concat('LICENSE-', doc_id))
        else concat_ws('/', lang, doc_id div 100, concat(doc_id, '.txt')) end)""")
    files = read(spark, folder, "documents").select("doc_id", path.alias("path"), "text")
    return licenses.scan(files)


@register("op8_warc_derivatives")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages").select(
        F.col("page_id"), F.col("url").alias("uri"), F.lit("2024-01-01T00:00:00Z").alias("date"),
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8").alias("headers"), F.col("html").alias("payload"))
    return warc.derived(pages, "page_id")


@register("op11_html_extraction")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extracted(read(spark, folder, "pages"))


SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@register("op12_ranked_search", rf"""
with folded as (
  select doc_id, row_number() over () as row, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}'), lambda x: x <> '') as own from documents),
sized as (select row, doc_id, own, len(own) as n from folded where len(own) > 0),
total as (select count(*) as n_docs, sum(n)::bigint as n_terms from sized),
counted as (select row, doc_id, n, term, count(*) as tf from (select row, doc_id, n, unnest(own) as term from sized) group by all),
lists as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::bigint as w from counted, total group by term),
impacts as (
  select row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) as impact
  from counted join lists using (term), total),
wanted as (
  select item, item_id, term, count(*) as times from (
    select row_number() over () as item, item_id, unnest(list_filter(regexp_split_to_array(translate(text,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}'), lambda x: x <> '')) as term from benchmark) group by all),
scored as (
  select item, item_id, row, doc_id, sum(impact * times)::bigint as score
  from wanted join impacts using (term) group by all having score > 0),
ranked as (
  select item_id, row_number() over (partition by item order by score desc, doc_id nulls last, row) as rank, doc_id, score from scored)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 20""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"), k=20)


@register("op13_embedding_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(read(spark, folder, "embeddings"), k=8)
