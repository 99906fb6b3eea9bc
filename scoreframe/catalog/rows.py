"""Projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreframe.catalog import query
from scoreframe.functions.columns import cols_between, cols_containing, safe_name, safe_names
from scoreframe.functions.missing import as_col
from scoreframe.functions.text import after_uid, age_in_years, matches, not_given, parse_number
from scoreframe.operators import grouped, ordered
from scoreframe.operators.joins import left_on
from scoreframe.operators.lines import fit_lines, within_limits
from scoreframe.operators.reshape import to_long
from scoreframe.plans.study import SELF_QUESTIONS, STEPS


@query("p1_select_drop", "SELECT rater, ratee, trait, score FROM ratings")
def p1(st):
    return st.ratings.drop("grp", "name", "qty", "tax", "l_orderkey", "l_linenumber", "l_shipdate")


@query("p2_column_range", f"""
SELECT {", ".join(f'"{s}"' for s in STEPS)} FROM progress WHERE "Name" IS NOT NULL""")
def p2(st):
    known = st.progress.filter("Name IS NOT NULL")
    return known.select(*[as_col(c) for c in cols_between(known, "1. Consent", "7. Feedback")])


@query("p3_columns_containing", """
SELECT "Student ID", group_peer, COLUMNS('(?i).*classmate.*') FROM nomination_form""")
def p3(st):
    form = st.nomination_form
    return form.select("Student ID", "group_peer", *[as_col(c) for c in cols_containing(form, "Classmate")])


@query("p4_rename", "SELECT \"Student ID\", group_peer, " + ", ".join(
    f'{q} AS "{n}"' for q, n in zip(SELF_QUESTIONS, ["Intelligence", "Integrity", "Perseverance", "Empathy", "Spike", "Boost"]))
    + " FROM self_form")
def p4(st):
    names = ["Intelligence", "Integrity", "Perseverance", "Empathy", "Spike", "Boost"]
    return st.self_form.withColumnsRenamed(dict(zip(SELF_QUESTIONS, names)))


@query("p5_compute_and_keep", """
SELECT id AS demographics_id, CASE WHEN other_language IS NULL THEN 'No' ELSE 'Yes' END AS esl,
  round(date_diff('day', DATE '1985-01-01' + birth_days, DATE '2020-09-17') / 365.25, 6) AS age
FROM demographic_form""")
def p5(st):
    born = F.date_add(F.lit("1985-01-01").cast("date"), F.col("birth_days"))
    return st.demographic_form.select(
        F.col("id").alias("demographics_id"),
        F.when(F.col("other_language").isNull(), "No").otherwise("Yes").alias("esl"),
        F.round(age_in_years(born, "2020-09-17"), 6).alias("age"),
    )


@query("p6_safe_names", "SELECT " + ", ".join(f'"{s}" AS {safe_name(s)}' for s in ["Name", *STEPS]) + " FROM progress")
def p6(st):
    return safe_names(st.progress)


@query("p7_row_number_id", """
SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS id FROM customer""")
def p7(st):
    return ordered.number_rows(st.table("customer").select("c_custkey", "c_acctbal"),
                               ["c_acctbal", "c_custkey"], "id").select("c_custkey", "id")


@query("p8_strings_to_codes", """
SELECT id, dense_rank() OVER (ORDER BY country) AS country,
  CASE WHEN school IS NULL THEN NULL ELSE dense_rank() OVER (ORDER BY school NULLS LAST) END AS school,
  dense_rank() OVER (ORDER BY english) AS english, balance
FROM demographic_form""")
def p8(st):
    people = st.demographic_form.select("id", "country", "school", "english", "balance")
    for name, kind in people.dtypes:
        if kind == "string":
            coded = ordered.encode(people, name, "__code")
            people = coded.drop(name).withColumnRenamed("__code", name)
    return people


@query("p9_anonymous_groups", """
SELECT person, 'Class ' || CAST(dense_rank() OVER (ORDER BY grp) AS VARCHAR) AS class FROM roster""")
def p9(st):
    coded = ordered.encode(st.roster, "grp", "number")
    return coded.select("person", F.concat(F.lit("Class "), F.col("number").cast("string")).alias("class"))


@query("p10_row_in_group", """
SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS row
FROM customer""")
def p10(st):
    people = st.table("customer").select("c_custkey", "c_nationkey", "c_acctbal")
    order = [F.desc("c_acctbal"), "c_custkey"]
    return ordered.number_within(people, ["c_nationkey"], order, "row").drop("c_acctbal")


@query("w1_not_missing", "SELECT * FROM tracker WHERE \"Name\" IS NOT NULL AND \"User ID\" IS NOT NULL")
def w1(st):
    return st.tracker.dropna(subset=["Name", "User ID"])


@query("w2_complete_cases", """
SELECT id, school, scholarship, phone, balance FROM demographic_form
WHERE school IS NOT NULL AND scholarship IS NOT NULL AND phone IS NOT NULL AND balance IS NOT NULL""")
def w2(st):
    return st.demographic_form.select("id", "school", "scholarship", "phone", "balance").dropna("any")


@query("w3_sentinel_and_range", """
SELECT candidate, "Interviewer", v AS score, count(*) AS n FROM (
  SELECT candidate, "Interviewer", nullif(CAST(nullif(regexp_extract("Boost", '-?[0-9]+'), '') AS DOUBLE), -9) AS v
  FROM interview_form) WHERE v > 0 GROUP BY ALL""")
def w3(st):
    marks = st.interview_form.withColumn("score", not_given(parse_number("Boost"), -9)).filter("score > 0")
    return marks.groupBy("candidate", "Interviewer", "score").agg(F.count(F.lit(1)).alias("n"))


@query("w4_literal_sets", """
SELECT trait, grp, count(*) AS n FROM ratings WHERE trait IN ('Boost', 'Spike')
  AND grp NOT IN ('REGION_0') GROUP BY ALL""")
def w4(st):
    kept = st.ratings.filter(F.col("trait").isin("Boost", "Spike") & ~F.col("grp").isin("REGION_0"))
    return kept.groupBy("trait", "grp").agg(F.count(F.lit(1)).alias("n"))


RELEVANT = {"Spike": (1, 2), "Boost": (2, 4), "Intelligence": (2,)}


def relevant_pair():
    """Question numbers that count for a trait; false for any other pair."""
    hit = F.lit(False)
    for trait, questions in RELEVANT.items():
        hit = hit | ((F.col("trait") == trait) & F.col("l_linenumber").isin(*questions))
    return F.coalesce(hit, F.lit(False))


RELEVANT_SQL = """((trait = 'Spike' AND l_linenumber IN (1, 2)) OR (trait = 'Boost' AND l_linenumber IN (2, 4))
  OR (trait = 'Intelligence' AND l_linenumber = 2))"""


@query("w5_pair_conditional", f"""
SELECT trait, l_linenumber, count(*) AS n FROM ratings WHERE {RELEVANT_SQL} GROUP BY ALL""")
def w5(st):
    return st.ratings.filter(relevant_pair()).groupBy("trait", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("w6_regex_predicate", """
SELECT form, count(*) FILTER (WHERE regexp_matches(question, 'Scaled Feedback')) AS n_scaled,
  count(*) FILTER (WHERE NOT coalesce(regexp_matches(regexp_extract(question, 'UID: (.*)', 1), '^10'), false)) AS n_rest
FROM review_rows GROUP BY form""")
def w6(st):
    scaled = matches("question", "Scaled Feedback")
    return st.review_rows.groupBy("form").agg(
        F.count_if(scaled).alias("n_scaled"),
        F.count_if(~matches(after_uid("question"), "^10")).alias("n_rest"))


@query("w7_groups_with_any", """
SELECT rater, ratee, trait, score FROM ratings r WHERE EXISTS (
  SELECT 1 FROM ratings s WHERE s.rater = r.rater AND s.ratee = r.ratee AND s.trait = 'Spike')""")
def w7(st):
    return grouped.keep_groups_with(st.ratings, F.col("trait") == "Spike", ["rater", "ratee"]).select(
        "rater", "ratee", "trait", "score")


@query("w8_latest_attempt", """
SELECT name, submitted, event_id FROM quiz_form
QUALIFY submitted = max(submitted) OVER (PARTITION BY name)""")
def w8(st):
    return grouped.keep_latest(st.quiz_form, "submitted", ["name"]).select("name", "submitted", "event_id")


@query("w8_first_attempt", """
SELECT name, submitted, event_id FROM quiz_form
QUALIFY submitted = min(submitted) OVER (PARTITION BY name)""")
def w8_first(st):
    return grouped.keep_latest(st.quiz_form, "submitted", ["name"], latest=False).select(
        "name", "submitted", "event_id")


@query("w9_range_trim", """
SELECT ratee, trait, l_linenumber, score FROM ratings
WINDOW w AS (PARTITION BY ratee, trait, l_linenumber)
QUALIFY count(score) OVER w = count(*) OVER w AND score BETWEEN min(score) OVER w AND max(score) OVER w""")
def w9(st):
    kept = grouped.keep_within_range(st.ratings, "score", ["ratee", "trait", "l_linenumber"])
    return kept.select("ratee", "trait", "l_linenumber", "score")


@query("w10_conditional_cap", """
SELECT grp, trait, ratee, l_orderkey, l_linenumber, qty FROM ratings
QUALIFY grp = 'REGION_1' OR row_number() OVER (PARTITION BY trait, ratee, grp = 'REGION_1'
  ORDER BY l_shipdate, l_orderkey, l_linenumber, qty) = 1""")
def w10(st):
    capped = grouped.cap_repeats(
        st.ratings.select("grp", "trait", "ratee", "l_orderkey", "l_linenumber", "qty", "l_shipdate"),
        ["trait", "ratee"], ["l_shipdate", "l_orderkey", "l_linenumber", "qty"], F.col("grp") == "REGION_1")
    return capped.drop("l_shipdate")


@query("w11_limits_before_fit", """
SELECT trait, round(regr_slope(theta, interview_score), 6) AS slope, CAST(regr_count(theta, interview_score) AS BIGINT) AS n_points
FROM person_scores WHERE theta BETWEEN 3 AND 12 GROUP BY trait""")
def w11(st):
    lines = fit_lines(within_limits(st.person_scores, "theta", 3, 12), "interview_score", "theta", ["trait"])
    return lines.select("trait", F.round("slope", 6).alias("slope"), "n_points")


@query("w12_no_self_pairs", """
SELECT o_custkey AS rater, l_suppkey AS ratee, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_custkey <> l_suppkey GROUP BY ALL""")
def w12(st):
    pairs = st.table("lineitem").join(st.table("orders"), F.expr("l_orderkey = o_orderkey"))
    pairs = pairs.select(F.col("o_custkey").alias("rater"), F.col("l_suppkey").alias("ratee"))
    return pairs.filter("rater <> ratee").groupBy("rater", "ratee").agg(F.count(F.lit(1)).alias("n"))


@query("w13_category_parameter", """
SELECT person, grp, theta, teacher_theta FROM person_scores WHERE trait = 'Perseverance'""")
def w13(st):
    wanted = "Perseverance"
    return st.person_scores.filter(F.col("trait") == F.lit(wanted)).select("person", "grp", "theta", "teacher_theta")


@query("w_step_flags_long", """
SELECT step, count(*) AS n, count(done) AS n_known FROM progress UNPIVOT INCLUDE NULLS (done FOR step IN (
  "1. Consent", "2. Quiz", "3. Nominate", "4. Rate", "5. Video", "6. Review", "7. Feedback")) GROUP BY step""")
def w_steps(st):
    long = to_long(st.progress, STEPS, "step", "done")
    return left_on(long.groupBy("step").agg(F.count(F.lit(1)).alias("n")),
                   long.groupBy("step").agg(F.count("done").alias("n_known")), ["step"])
