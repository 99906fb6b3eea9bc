"""Sources and sinks."""

from __future__ import annotations

from itertools import chain

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreframe.catalog import query
from scoreframe.functions.text import QUESTION_TRAITS, extract
from scoreframe.operators.joins import left_on
from scoreframe.operators.regression import fit_formula
from scoreframe.session import scratch_root
from scoreframe.sources import scan, store

LINE_SCHEMA = T.StructType([
    T.StructField("l_returnflag", T.StringType()), T.StructField("l_quantity", T.DoubleType()),
])


@query("s1_typed_scan", """
SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY l_returnflag""")
def s1(st):
    lines = scan.scan_table(st.spark, f"{st.folder}/lineitem.parquet", LINE_SCHEMA)
    return lines.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("s2_tagged_union", """
SELECT 'customers' AS source, count(*) AS n, count(c_custkey) AS n_customer, 0 AS n_supplier FROM customer
UNION ALL SELECT 'suppliers', count(*), 0, count(s_suppkey) FROM supplier""")
def s2(st):
    paths = {"customers": f"{st.folder}/customer.parquet", "suppliers": f"{st.folder}/supplier.parquet"}
    both = scan.scan_tagged_union(st.spark, paths, "source")
    return both.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("c_custkey").alias("n_customer"),
        F.count("s_suppkey").alias("n_supplier"))


@query("s3_workbook_scan", """
WITH sheets AS (
  SELECT 'documents' AS form, u.* FROM (SELECT doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents) d
  UNPIVOT INCLUDE NULLS (answer FOR question IN (text, lang, source, n_chars)) u
  UNION ALL
  SELECT 'labels', u.* FROM (SELECT doc_id, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic FROM labels) l
  UNPIVOT INCLUDE NULLS (answer FOR question IN (quality, toxic)) u)
SELECT form, question, count(*) AS n, count(DISTINCT answer) AS n_answers,
  CAST(sum(length(answer)) AS BIGINT) AS chars FROM sheets GROUP BY form, question""")
def s3(st):
    long = scan.scan_sheets(st.spark, st.folder, ["doc_id"], "question", "answer",
                            ["documents.parquet", "labels.parquet"], tag="form")
    long = long.withColumn("form", F.regexp_replace("form", r"\.parquet$", ""))
    return long.groupBy("form", "question").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("answer").alias("n_answers"),
        F.sum(F.length("answer")).alias("chars"))


@query("s4_inline_table", f"""
WITH question_trait(trait, question_text) AS (VALUES {", ".join(f"('{t}', '{q}')" for t, q in QUESTION_TRAITS)})
SELECT trait, count(*) AS n FROM review_rows
LEFT JOIN question_trait ON nullif(regexp_extract(question, 'Q[0-9]{{1,2}}.*'), '') = question_text GROUP BY trait""")
def s4(st):
    inline = scan.inline_table(st.spark, QUESTION_TRAITS, "trait string, question_text string")
    rows = st.review_rows.withColumn("question_text", extract("question", "Q[0-9]{1,2}.*"))
    return left_on(rows, inline, ["question_text"]).groupBy("trait").agg(F.count(F.lit(1)).alias("n"))


@query("s5_snapshot", """
SELECT grp, trait, count(*) AS n FROM nominations GROUP BY grp, trait""")
def s5(st):
    root = scratch_root(st.spark)

    def build():
        return st.nominations.groupBy("grp", "trait").agg(F.count(F.lit(1)).alias("n"))

    store.snapshot(st.spark, root, "nominations", "2020-09-17", build)
    return store.snapshot(st.spark, root, "nominations", "2020-09-17", build)


@query("s6_configured_sheets", """
SELECT 'group_2' AS grp, count(*) AS n FROM nation UNION ALL SELECT 'group_3', count(*) FROM region""")
def s6(st):
    config = {"group_1": "supplier", "group_2": "nation", "group_3": "region"}
    later = {tag: f"{st.folder}/{name}.parquet" for tag, name in list(config.items())[1:]}
    return scan.scan_tagged_union(st.spark, later, "grp").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


@query("s7_draws_scan", """
SELECT l_linenumber AS i, t AS c, count(*) AS n_draws, sum(v) AS total FROM (
  SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS t, max(l_quantity) AS v
  FROM lineitem GROUP BY ALL) GROUP BY ALL""")
def s7(st):
    code = F.expr("CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END")
    cells = [
        F.max(F.when((F.col("l_linenumber") == i) & (code == c), F.col("l_quantity"))).alias(f"theta[{i},{c}]")
        for i in range(1, 8) for c in range(1, 4)
    ]
    wide = st.table("lineitem").groupBy(F.col("l_orderkey").alias("draw")).agg(*cells)
    long = scan.draws_to_long(wide, "theta", ["draw"])
    return long.filter("value IS NOT NULL").groupBy("i", "c").agg(
        F.count(F.lit(1)).alias("n_draws"), F.sum("value").alias("total"))


def landed(df, name: str, above: list[str]) -> str:
    """``df`` as CSV text files that each open with the lines ``above``; the folder's path."""
    path = f"{scratch_root(df.sparkSession)}/{name}.csv"
    lines = df.select(F.to_csv(F.struct(*df.columns)).alias("value"))
    opened = lines.mapInPandas(lambda parts: chain([pd.DataFrame({"value": above})], parts), "value string")
    opened.write.text(path)
    return path


@query("s1_csv_skip", """
SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS qty, count(*) FILTER (l_linenumber > 3) AS n_later
FROM lineitem GROUP BY l_returnflag""")
def s1_csv(st):
    """Text columns read by a compact type string, below a line that is not part of the table."""
    names = ["l_returnflag", "l_quantity", "l_later"]
    lines = st.table("lineitem").select("l_returnflag", "l_quantity", (F.col("l_linenumber") > 3).alias("l_later"))
    path = landed(lines, "lines", ["Exported answers", ",".join(names)])
    rows = scan.scan_table(st.spark, path, scan.typed_schema(names, "cnl"), skip=1)
    return rows.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"), F.count_if("l_later").alias("n_later"))


@query("s7_draws_csv", """
SELECT l_linenumber AS i, 1 AS c, count(*) AS n_draws, sum(v) AS total
FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS v FROM lineitem GROUP BY ALL) GROUP BY ALL""")
def s7_csv(st):
    """Draws from text files with comment lines above the header."""
    cells = [F.max(F.when(F.col("l_linenumber") == i, F.col("l_quantity"))).alias(f"cell{i}") for i in range(1, 8)]
    wide = st.table("lineitem").groupBy(F.col("l_orderkey").alias("draw")).agg(*cells)
    names = ["draw", *(f"theta.{i}.1" for i in range(1, 8))]
    path = landed(wide, "draws", ["# model = choices", "# method = sample", ",".join(names)])
    long = scan.scan_draws(st.spark, path, names, "theta", ["draw"])
    return long.filter("value IS NOT NULL").groupBy("i", "c").agg(
        F.count(F.lit(1)).alias("n_draws"), F.sum("value").alias("total"))


@query("k1_publish_scores", """
SELECT person, grp, trait, theta FROM person_scores""")
def k1(st):
    path = scratch_root(st.spark) + "/scores"
    store.publish(st.person_scores.select("person", "grp", "trait", "theta"), path)
    return st.spark.read.parquet(path)


@query("k1_versioned_scores", """
SELECT person, grp, trait, theta FROM person_scores""")
def k1_versioned(st):
    """The current version: the whole table, published after one that lacks the people without an interview."""
    root = scratch_root(st.spark) + "/scores"
    rows = st.person_scores
    store.publish_version(rows.filter("interview_score IS NOT NULL").select("person", "grp", "trait", "theta"), root)
    store.publish_version(rows.select("person", "grp", "trait", "theta"), root)
    return store.read_version(st.spark, root)


@query("k2_day_stamped_table", """
SELECT grp, count(*) AS n, DATE '2020-09-17' AS as_of FROM roster GROUP BY grp""")
def k2(st):
    root = scratch_root(st.spark)
    sizes = st.roster.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    store.save_snapshot(sizes, root, "roster_sizes", "2020-09-16")
    store.save_snapshot(sizes, root, "roster_sizes", "2020-09-17")
    return store.history(st.spark, root, "roster_sizes").filter("as_of = DATE '2020-09-17'")


@query("k3_saved_model_result", """
SELECT '(Intercept)' AS term, round(regr_intercept(theta, interview_score), 6) AS estimate FROM person_scores
UNION ALL SELECT 'interview_score', round(regr_slope(theta, interview_score), 6) FROM person_scores""")
def k3(st):
    path = scratch_root(st.spark) + "/coefficients"
    table, _ = fit_formula(st.person_scores.dropna(subset=["interview_score"]), "theta ~ interview_score")
    store.publish(table, path)
    return st.spark.read.parquet(path).select("term", F.round("estimate", 6).alias("estimate"))
