"""Cleaning jobs: forms to long tables, identities, funnel."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreframe.catalog import checks as ck
from scoreframe.catalog import query
from scoreframe.functions.columns import cols_between
from scoreframe.functions.text import QUESTION_TRAITS
from scoreframe.operators import joins
from scoreframe.plans import forms
from scoreframe.plans.study import INTERVIEW_TRAITS, SELF_QUESTIONS, STEPS, TEACHER_TRAITS
from scoreframe.session import cut_lineage
from scoreframe.sources.scan import inline_table

AS_OF = "2020-09-17"
ITEMS = ["Item 4", "Item 5", "Item 6", "Item 7"]


# Cleaned tables that other jobs read several times are written once per query, as a
# day's snapshot would be.


def teacher_form_to_long(st):
    traits = cols_between(st.teacher_form, TEACHER_TRAITS[0], "Interview-ability")
    return forms.teacher_marks_to_long(st.teacher_form, traits)


def teacher_long(st):
    return st.once("teacher_long", lambda: cut_lineage(teacher_form_to_long(st)))


def noms_long(st):
    return forms.nominations_to_long(st.nomination_form, st.tracker, {ck.WRONG_NAME: ck.RIGHT_NAME})


def noms_count(st):
    return st.once("noms_count", lambda: cut_lineage(
        noms_long(st).groupBy("name", "trait", "group_peer").agg(
            F.count(F.lit(1)).alias("n_nominations"), F.min("student_id").alias("student_id"))))


def self_long(st):
    return forms.self_ratings_to_long(st.self_form, st.tracker, dict(zip(SELF_QUESTIONS, ck.SELF_TRAITS)))


def interviews_long(st, need_user=False):
    return forms.interviews_to_long(st.interview_form, st.tracker, INTERVIEW_TRAITS, need_user)


def people_clean(st):
    return forms.clean_demographics(st.demographic_form, AS_OF)


def people_with_roles(st):
    interviewers = st.table("events").select(F.concat(F.lit("Person "), F.col("user_id").cast("string")).alias("name"))
    voters = st.nominations.select("nominator").distinct().select(
        F.lit(None).cast("string").alias("name"),
        F.concat(F.lit("S"), F.col("nominator").cast("string")).alias("student_id"))
    participants = st.tracker.select(F.col("Student ID").alias("student_id"))
    return forms.with_role(people_clean(st), interviewers.distinct(), voters, participants)


def people_table(st):
    """Clean demographics written once: one row per person, read many times."""
    return st.once("people", lambda: cut_lineage(people_clean(st)))


def reviews_clean(st):
    first_questions = inline_table(st.spark, QUESTION_TRAITS, "trait string, question_text string")
    return st.once("reviews_clean", lambda: forms.clean_reviews(st.review_rows, first_questions, {}))


def likert(st):
    return st.once("likert", lambda: cut_lineage(forms.likert_reviews(reviews_clean(st))))


def quiz_scores(st, attempt="last"):
    return forms.score_quiz(st.quiz_form, st.quiz_key, ITEMS, 3, ["submitted", "event_id"], attempt)


def quiz_sql(edge: str) -> str:
    return f"""
WITH kept AS (SELECT * FROM quiz_form QUALIFY submitted = {edge}(submitted) OVER (PARTITION BY name)),
long AS (SELECT * FROM kept UNPIVOT INCLUDE NULLS (answer FOR item IN ({ck.quoted(ITEMS)}))),
s AS (SELECT name, min(lower(student_id)) AS student_id,
  CASE WHEN count(answer) = count(*) THEN CAST(sum(CASE WHEN answer = correct THEN 1 ELSE 0 END) AS BIGINT) END AS score
  FROM long LEFT JOIN quiz_key ON question_number = CAST(substr(item, 6, 1) AS INT) - 3 GROUP BY name)
SELECT *, CAST(ntile(100) OVER (ORDER BY score, name) AS INT) AS percentile FROM s WHERE score IS NOT NULL
UNION ALL SELECT *, NULL FROM s WHERE score IS NULL"""


@query("c1_quiz_scores_last_attempt", quiz_sql("max"))
def c1(st):
    return quiz_scores(st)


@query("c1_quiz_scores_first_attempt", quiz_sql("min"))
def c1_first(st):
    return quiz_scores(st, "first")


@query("c2_nominations_long", "SELECT * FROM noms_long")
def c2(st):
    return noms_long(st)


@query("c3_teacher_long", """
SELECT name, student_id, grp, trait, teacher_raw, round(teacher_score, 6) AS teacher_score,
  round(standardized_test, 6) AS standardized_test, round(interviewability, 6) AS interviewability,
  round(creativity, 6) AS creativity FROM teacher_long""")
def c3(st):
    rounded = ["teacher_score", "standardized_test", "interviewability", "creativity"]
    return teacher_form_to_long(st).withColumns({c: F.round(c, 6) for c in rounded})


@query("c4_interviews_long", """
SELECT interviewer, student_id, trait, score, name, count(*) AS n FROM interviews_long GROUP BY ALL""")
def c4(st):
    return interviews_long(st).groupBy("interviewer", "student_id", "trait", "score", "name").agg(
        F.count(F.lit(1)).alias("n"))


@query("c4_interviews_long_known_user", """
SELECT trait, user_id, count(*) AS n, count(score) AS n_marks FROM interviews_long WHERE user_id IS NOT NULL GROUP BY ALL""")
def c4_user(st):
    return interviews_long(st, need_user=True).groupBy("trait", "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("score").alias("n_marks"))


@query("c5_self_ratings_long", """
SELECT group_peer, student_id, trait, response, score, round(scaled_score, 6) AS scaled_score, name FROM self_long""")
def c5(st):
    return self_long(st).withColumn("scaled_score", F.round("scaled_score", 6))


@query("c6_demographics", "SELECT * EXCLUDE (income, age), round(age, 6) AS age FROM people_clean")
def c6(st):
    return people_with_roles(st).withColumn("age", F.round("age", 6))


@query("c7_reviews_long", "SELECT * FROM reviews_clean")
def c7(st):
    return reviews_clean(st)


@query("c8_video_lookup", "SELECT * FROM form_videos")
def c8(st):
    return forms.videos_in_forms(reviews_clean(st))


@query("c9_likert_centred", """
SELECT pos, name, uid2, trait, question_number, numeric_response, round(scaled_numeric, 6) AS scaled_numeric FROM likert""")
def c9(st):
    return forms.likert_reviews(reviews_clean(st)).select("pos", "name", "uid2", "trait", "question_number", "numeric_response",
                             F.round("scaled_numeric", 6).alias("scaled_numeric"))


ADDRESSES = ["student_id", "alternate_email"]
LOOKUP_SQL = """addresses AS (SELECT DISTINCT lower(email) AS email, demographics_id AS id FROM (
  SELECT demographics_id, student_id, alternate_email FROM people_clean)
  UNPIVOT (email FOR source IN (student_id, alternate_email)))"""


def address_lookup(st):
    people = people_table(st).select(F.col("demographics_id").alias("id"), *ADDRESSES)
    return joins.identity_lookup(people, "id", ADDRESSES)


@query("c13_reviewer_identities", f"""
WITH {LOOKUP_SQL}, r AS (SELECT email, name, count(*) AS n FROM likert GROUP BY ALL)
SELECT r.email, r.name, n, id FROM r LEFT JOIN addresses a ON a.email = r.email""")
def c13(st):
    from scoreframe.plans.scores import reviewer_identities

    return reviewer_identities(likert(st), address_lookup(st))


@query("c13_candidate_identities", f"""
WITH {LOOKUP_SQL} SELECT "User ID" AS user_id, id AS reviewee_id FROM tracker
LEFT JOIN addresses a ON a.email = lower("Student ID") WHERE "Student ID" IS NOT NULL""")
def c13_candidates(st):
    from scoreframe.plans.scores import candidate_identities

    return candidate_identities(st.tracker, address_lookup(st))


@query("c27_completion_funnel", f"""
SELECT step, CASE WHEN count(done) = count(*) THEN CAST(sum(CAST(done AS INT)) AS BIGINT) END AS n_completed
FROM (SELECT * FROM progress WHERE "Name" IS NOT NULL) UNPIVOT INCLUDE NULLS (done FOR step IN ({ck.quoted(STEPS)})) GROUP BY step""")
def c27(st):
    known = st.progress.filter("Name IS NOT NULL")
    return forms.completion_funnel(known, cols_between(known, STEPS[0], STEPS[-1]))
