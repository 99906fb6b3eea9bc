"""Checking SQL shared by the job queries."""

from __future__ import annotations

from scoreframe.catalog.scalars import QUINTILE_SQL, education_sql
from scoreframe.catalog.windows import z_sql
from scoreframe.functions.text import QUESTION_TRAITS
from scoreframe.plans.study import CLASSMATE, INTERVIEW_TRAITS, SELF_QUESTIONS, TEACHER_TRAITS, VIEW_SQL

SELF_TRAITS = ["Intelligence", "Integrity", "Perseverance", "Empathy", "Spike", "Boost"]
WRONG_NAME, RIGHT_NAME = "Supplier#000000003", "Supplier#000000001"
_BOXES = ", ".join(f'"{c} {k}"' for c in CLASSMATE.values() for k in (1, 2, 3))


def quoted(names) -> str:
    return ", ".join(f'"{n}"' for n in names)


def number_sql(text: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({text}, '-?[0-9]+'), '') AS DOUBLE)"


def strict_avg_sql(x: str) -> str:
    return f"CASE WHEN count({x}) = count(*) THEN avg({x}) END"


VIEW_SQL.update({
    "teacher_long": f"""
      SELECT *, max(CASE WHEN trait = 'Interview-ability' THEN teacher_score END) OVER (PARTITION BY name) AS interviewability,
        max(CASE WHEN trait = 'Creativity' THEN teacher_score END) OVER (PARTITION BY name) AS creativity
      FROM (SELECT name, student_id, grp, trait, teacher_raw, {z_sql('teacher_raw', 'trait, grp')} AS teacher_score,
          {z_sql('test_raw', 'trait, grp')} AS standardized_test
        FROM (SELECT "Student" AS name, lower("Student ID") AS student_id, grp, trait, teacher_raw, "Standardized Test" AS test_raw
          FROM teacher_form UNPIVOT INCLUDE NULLS (teacher_raw FOR trait IN ({quoted(TEACHER_TRAITS)}))))""",
    "noms_long": f"""
      SELECT nominator_id, group_peer, CASE n.name WHEN '{WRONG_NAME}' THEN '{RIGHT_NAME}' ELSE n.name END AS name,
        nomination_number, trait, "Student ID" AS student_id
      FROM (SELECT lower("Student ID") AS nominator_id, group_peer, picked AS name, CAST(right(box, 1) AS INT) AS nomination_number,
          CASE WHEN box LIKE 'Boostable%' THEN 'Boost' WHEN box LIKE 'Intelligent%' THEN 'Intelligence'
            WHEN box LIKE 'Persevering%' THEN 'Perseverance' WHEN box LIKE 'High integrity%' THEN 'Integrity'
            WHEN box LIKE 'Empathetic%' THEN 'Empathy' ELSE 'Spike' END AS trait
        FROM nomination_form UNPIVOT INCLUDE NULLS (picked FOR box IN ({_BOXES}))) n
      LEFT JOIN tracker t ON t."Name" = n.name""",
    "noms_count": """
      SELECT name, trait, group_peer, count(*) AS n_nominations, min(student_id) AS student_id FROM noms_long GROUP BY ALL""",
    "self_long": f"""
      SELECT group_peer, s.student_id, trait, response, score, scaled_score, "Name" AS name FROM (
        SELECT *, {z_sql('score', 'group_peer, trait')} AS scaled_score FROM (
          SELECT group_peer, lower("Student ID") AS student_id, trait, response, {number_sql('response')} AS score
          FROM (SELECT "Student ID", group_peer, {", ".join(f'{q} AS "{t}"' for q, t in zip(SELF_QUESTIONS, SELF_TRAITS))} FROM self_form)
          UNPIVOT INCLUDE NULLS (response FOR trait IN ({quoted(SELF_TRAITS)})))) s
      LEFT JOIN tracker t ON lower(t."Student ID") = s.student_id""",
    "interviews_long": f"""
      SELECT "Interviewer" AS interviewer, lower(candidate) AS student_id, trait, nullif({number_sql('rating')}, -9) AS score,
        "Name" AS name, "User ID" AS user_id
      FROM (SELECT * FROM interview_form UNPIVOT INCLUDE NULLS (rating FOR trait IN ({quoted(INTERVIEW_TRAITS)}))) i
      LEFT JOIN tracker t ON t."Student ID" = lower(candidate)""",
    "people_clean": f"""
      SELECT id AS demographics_id, name, lower(student_id) AS student_id,
        CASE WHEN other_language IS NULL THEN 'No' ELSE 'Yes' END AS esl,
        date_diff('day', DATE '1985-01-01' + birth_days, DATE '2020-09-17') / 365.25 AS age, alternate_email,
        CASE gender WHEN 'Female' THEN 'Female' WHEN 'Male' THEN 'Male' ELSE 'Other' END AS gender,
        english AS english_household, country AS education_country, coalesce(scholarship, 'Unanswered') AS scholarship,
        coalesce(school, 'Unanswered') AS school_type, {education_sql('guardian_1')} AS guardian_one,
        {education_sql('guardian_2')} AS guardian_two, coalesce(quintile, 'Prefer not to say') AS income_quintile,
        coalesce(phone, 'Unanswered') AS mobile_plan,
        CAST(len(string_split(coalesce(subscriptions, 'Unanswered'), ', ')) AS INT) AS paid_subscriptions, balance,
        CASE WHEN id IN (SELECT user_id FROM events) THEN 'Interviewer'
          WHEN id IN (SELECT nominator FROM nominations) THEN 'Peer reviewer'
          WHEN lower(student_id) IN (SELECT "Student ID" FROM tracker) THEN 'Study participant' ELSE 'Other' END AS type,
        {QUINTILE_SQL} AS income
      FROM demographic_form QUALIFY row_number() OVER (PARTITION BY name ORDER BY id) = 1""",
    "first_questions": "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{q}')" for t, q in QUESTION_TRAITS) + ") v(q_trait, q_text)",
    "reviews_clean": """
      SELECT pos, name, lower(email) AS email, form, submitted, question, answer, uid, question_text,
        'Video ' || CAST(CAST(sum(changed) OVER (PARTITION BY name, form ORDER BY pos) AS BIGINT) AS VARCHAR) AS video_number,
        first_value(q_trait IGNORE NULLS) OVER (PARTITION BY form ORDER BY CASE WHEN q_trait IS NULL THEN 1 ELSE 0 END, pos) AS trait
      FROM (SELECT *, CASE WHEN row_number() OVER w > 1 AND uid IS DISTINCT FROM lag(uid) OVER w THEN 1 ELSE 0 END AS changed
        FROM (SELECT *, nullif(regexp_extract(question, 'UID: [0-9]{4}'), '') AS uid,
            nullif(regexp_extract(question, 'Q[0-9]{1,2}.*'), '') AS question_text FROM review_rows)
        LEFT JOIN first_questions ON q_text = question_text
        WINDOW w AS (PARTITION BY name, form ORDER BY pos))""",
    "form_videos": """
      SELECT form, video_number, regexp_extract(first(uid ORDER BY pos), 'UID: (.*)', 1) AS uid
      FROM reviews_clean WHERE uid IS NOT NULL GROUP BY ALL""",
    "likert": f"""
      SELECT *, numeric_response - avg(numeric_response) OVER (PARTITION BY name, question_text) AS scaled_numeric FROM (
        SELECT *, regexp_extract(uid, 'UID: (.*)', 1) AS uid2, regexp_extract(question, 'Q[0-9]') AS question_number,
          {number_sql('answer')} AS numeric_response FROM reviews_clean WHERE contains(question_text, 'Scaled Feedback'))""",
    "likert_person": """SELECT l.*, person FROM likert l LEFT JOIN tracker t ON t."User ID" = uid2""",
})
