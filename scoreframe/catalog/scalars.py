"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreframe.catalog import query
from scoreframe.functions import missing, text
from scoreframe.functions.text import EDUCATION_NOT_SAID, GUARDIAN_EDUCATION, INCOME_QUINTILES, OTHER_EDUCATION
from scoreframe.operators.regression import interactions

QUINTILE_SQL = "CASE quintile " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in INCOME_QUINTILES.items()) + " END"


def education_sql(column: str) -> str:
    cases = " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in GUARDIAN_EDUCATION.items())
    return f"CASE WHEN {column} IS NULL THEN '{EDUCATION_NOT_SAID}' {cases} ELSE '{OTHER_EDUCATION}' END"


@query("f1_lower_id", "SELECT id, lower(student_id) AS student_id FROM demographic_form")
def f1(st):
    return st.demographic_form.select("id", F.lower("student_id").alias("student_id"))


@query("f2_parse_number", """
SELECT p_partkey, CAST(nullif(regexp_extract(p_brand, '-?[0-9]+'), '') AS DOUBLE) AS brand,
  CAST(nullif(regexp_extract(p_name, '-?[0-9]+'), '') AS DOUBLE) AS name_number FROM part""")
def f2(st):
    return st.table("part").select("p_partkey", text.parse_number("p_brand").alias("brand"),
                                   text.parse_number("p_name").alias("name_number"))


@query("f3_extract", "SELECT pos, nullif(regexp_extract(question, 'Q[0-9]'), '') AS question FROM review_rows")
def f3(st):
    return st.review_rows.select("pos", text.extract("question", "Q[0-9]").alias("question"))


@query("f4_after_marker", """
SELECT pos, CASE WHEN contains(question, 'UID: ') THEN regexp_extract(question, 'UID: (.*)', 1) END AS uid FROM review_rows""")
def f4(st):
    return st.review_rows.select("pos", text.after_uid("question").alias("uid"))


@query("f5_question_number", """
SELECT s_suppkey, CAST(nullif(regexp_extract(s_name, '[1-9][0-9]?'), '') AS INT) - 3 AS number FROM supplier""")
def f5(st):
    trimmed = st.table("supplier").withColumn("tail", F.regexp_replace("s_name", "#0*", "#"))
    return trimmed.select("s_suppkey", text.question_number("tail", 3).alias("number"))


@query("f6_strip_ordinal", """
SELECT DISTINCT header, regexp_replace(header, ' [0-9]', '', 'g') AS kind FROM (
  SELECT regexp_replace(question, '[Uu]ID', 'Uid') || ' ' || CAST(pos % 10 AS VARCHAR) AS header FROM review_rows)""")
def f6(st):
    header = F.concat_ws(" ", F.regexp_replace("question", "[Uu]ID", "Uid"), (F.col("pos") % 10).cast("string"))
    return st.review_rows.select(header.alias("header")).distinct().withColumn("kind", text.strip_ordinal("header"))


@query("f7_cell_index", """
SELECT draw, CAST(regexp_extract(variable, '\\[([0-9]+),([0-9]+)\\]', 1) AS INT) AS i,
  CAST(regexp_extract(variable, '\\[([0-9]+),([0-9]+)\\]', 2) AS INT) AS c FROM draws""")
def f7(st):
    return st.draws.select("draw", text.cell_index("variable", 1).alias("i"), text.cell_index("variable", 2).alias("c"))


@query("f8_default_for_missing", """
SELECT id, coalesce(scholarship, 'Unanswered') AS scholarship, coalesce(school, 'Unanswered') AS school,
  CASE WHEN other_language IS NULL THEN 'No' ELSE 'Yes' END AS esl FROM demographic_form""")
def f8(st):
    return st.demographic_form.select(
        "id", F.coalesce("scholarship", F.lit("Unanswered")).alias("scholarship"),
        F.coalesce("school", F.lit("Unanswered")).alias("school"),
        F.when(F.col("other_language").isNull(), "No").otherwise("Yes").alias("esl"))


@query("f9_missing_flags", """
SELECT person, trait, interview_score IS NULL AS missing_interview_score,
  coalesce(interview_score, -5) AS interview_score FROM person_scores""")
def f9(st):
    scores = st.person_scores.select("person", "trait", "interview_score")
    return missing.fill_and_flag(scores, ["interview_score"], -5.0)


@query("f10_recodes", f"""
SELECT id, CASE gender WHEN 'Female' THEN 'Female' WHEN 'Male' THEN 'Male' ELSE 'Other' END AS gender,
  {education_sql('guardian_1')} AS g1, {QUINTILE_SQL} AS income FROM demographic_form""")
def f10(st):
    return st.demographic_form.select(
        "id", text.recode("gender", {"Female": "Female", "Male": "Male"}, "Other").alias("gender"),
        text.education_level("guardian_1").alias("g1"), text.income_code("quintile").alias("income"))


@query("f11_name_corrections", """
SELECT id, CASE name WHEN 'Person 0' THEN 'Person zero' WHEN 'Person 1' THEN 'Person one' ELSE name END AS name
FROM demographic_form""")
def f11(st):
    fixes = {"Person 0": "Person zero", "Person 1": "Person one"}
    return text.correct_names(st.demographic_form.select("id", "name"), "name", fixes)


@query("f12_full_name", """
SELECT id, CASE WHEN school IS NULL THEN name ELSE name || ' ' || school END AS full_name FROM demographic_form""")
def f12(st):
    return st.demographic_form.select("id", text.full_name("name", "school").alias("full_name"))


@query("f13_age", """
SELECT o_orderkey, round(date_diff('day', CAST(o_orderdate AS DATE), DATE '2020-09-17') / 365.25, 6) AS age FROM orders""")
def f13(st):
    dated = st.table("orders").withColumn("d", F.col("o_orderdate").cast("date"))
    return dated.select("o_orderkey", F.round(text.age_in_years("d", "2020-09-17"), 6).alias("age"))


@query("f14_casts", """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS cust, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority,
  TRY_CAST(o_orderstatus AS DOUBLE) AS status, CAST(o_orderdate AS DATE) AS day FROM orders""")
def f14(st):
    return st.table("orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("cust"),
        F.substring("o_orderpriority", 1, 1).try_cast("double").alias("priority"),
        F.col("o_orderstatus").try_cast("double").alias("status"), F.col("o_orderdate").cast("date").alias("day"))


@query("f15_arithmetic_features", """
SELECT person, trait, theta / 10 AS theta_10, theta * theta AS theta_sq,
  (theta - teacher_theta) * (theta - teacher_theta) AS gap_sq, theta = teacher_theta AS same,
  CASE WHEN trait = 'Spike' THEN theta ELSE 0 END AS theta_x_spike FROM person_scores""")
def f15(st):
    with_products, _ = interactions(st.person_scores, "trait", "theta")
    gap = F.col("theta") - F.col("teacher_theta")
    return with_products.select(
        "person", "trait", (F.col("theta") / 10).alias("theta_10"), (F.col("theta") * F.col("theta")).alias("theta_sq"),
        (gap * gap).alias("gap_sq"), (F.col("theta") == F.col("teacher_theta")).alias("same"),
        F.col("theta_x_Spike").alias("theta_x_spike"))


@query("f16_comparison_label", """
SELECT person, trait, CASE WHEN interview_score > theta THEN 'Help' WHEN NOT interview_score > theta THEN 'Hurt' END AS label
FROM person_scores""")
def f16(st):
    label = missing.if_known(F.col("interview_score") > F.col("theta"), "Help", "Hurt")
    return st.person_scores.select("person", "trait", label.alias("label"))


@query("f17_paste", """
SELECT id, coalesce(school, 'NA') || coalesce(gender, 'NA') AS key FROM demographic_form""")
def f17(st):
    return st.demographic_form.select("id", text.paste("school", "gender").alias("key"))


@query("f18_log_sum_exp", """
SELECT grp, trait, round(max(theta / 10) + ln(sum(exp(theta / 10 - m))), 6) AS lse,
  round(sum(1 / (1 + exp(-theta / 10))), 6) AS sum_logistic FROM (
  SELECT *, max(theta / 10) OVER (PARTITION BY grp, trait) AS m FROM person_scores) GROUP BY ALL""")
def f18(st):
    from scoreframe.operators.grouped import attach

    s = st.person_scores.withColumn("t", F.col("theta") / 10)
    s = attach(s, ["grp", "trait"], m=F.max("t"))
    out = s.groupBy("grp", "trait").agg(
        (F.max("m") + F.log(F.sum(F.exp(F.col("t") - F.col("m"))))).alias("lse"),
        F.sum(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("t")))).alias("sum_logistic"))
    return out.select("grp", "trait", F.round("lse", 6).alias("lse"), F.round("sum_logistic", 6).alias("sum_logistic"))
