"""The driver's tables seen as a rating study.

Suppliers are the people who are rated, regions their classes, parts the raters,
customers the nominators and demographic respondents, events quiz and review
submissions. Each view is a lazy DataFrame over whole tables; ``VIEW_SQL`` states
the same mapping for the SQL checks.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.functions.text import QUESTION_TRAITS

# The six trait names, by return flag and line status.
TRAIT_CASE = """CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'Boost' WHEN 'AO' THEN 'Empathy'
  WHEN 'NF' THEN 'Integrity' WHEN 'NO' THEN 'Intelligence' WHEN 'RF' THEN 'Perseverance' ELSE 'Spike' END"""
TRAIT_NUMBER = """CASE l_returnflag || l_linestatus WHEN 'AF' THEN 1 WHEN 'AO' THEN 2
  WHEN 'NF' THEN 3 WHEN 'NO' THEN 4 WHEN 'RF' THEN 5 ELSE 6 END"""
RANK = "CAST(1 + (l_linenumber - 1) % 3 AS INT)"  # a form has three boxes a trait
CLASSMATE = {
    "Boost": "Boostable classmate", "Empathy": "Empathetic classmate",
    "Integrity": "High integrity classmate", "Intelligence": "Intelligent classmate",
    "Perseverance": "Persevering classmate", "Spike": "Driven classmate",
}
FORM_TRAITS = {"click": "Intelligence", "error": "Perseverance", "purchase": "Integrity",
               "signup": "Empathy", "view": "Spike"}
INTERVIEW_TRAITS = ["Intelligence", "Integrity", "Perseverance", "Empathy", "Spike", "Boost"]
SELF_QUESTIONS = ["self_intelligence", "self_integrity", "self_perseverance", "self_empathy",
                  "self_drive", "self_need"]
TEACHER_TRAITS = ["Boost", "Empathy", "Integrity", "Intelligence", "Perseverance", "Spike",
                  "Creativity", "Interview-ability"]
STEPS = ["1. Consent", "2. Quiz", "3. Nominate", "4. Rate", "5. Video", "6. Review", "7. Feedback"]
QUIZ_KEY = [(1, "a"), (2, "c"), (3, "b"), (4, "d")]

_QUESTION = dict(QUESTION_TRAITS)
_FORM_QUESTION = "CASE event_type " + " ".join(
    f"WHEN '{form}' THEN '{_QUESTION[trait]}'" for form, trait in FORM_TRAITS.items()
) + " END"

# Expressions that read the same in Spark SQL and in the checking SQL.
_PROGRESS = {
    "1. Consent": "o_orderstatus IN ('F', 'O', 'P')",
    "2. Quiz": "o_orderstatus <> 'O'",
    "3. Nominate": "o_orderpriority < '3'",
    "4. Rate": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus = 'F' END",
    "5. Video": "o_totalprice > 200000",
    "6. Review": "o_totalprice > 300000",
    "7. Feedback": "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderstatus = 'P' END",
}
_DEMOGRAPHIC = {
    "id": "c_custkey",
    "name": "'Person ' || CAST(c_custkey - CASE WHEN c_custkey % 20 = 19 THEN 1 ELSE 0 END AS STRING)",
    "student_id": "'S' || CAST(c_custkey AS STRING)",
    "alternate_email": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'User' || CAST(c_custkey AS STRING) || '@Mail.org' END",
    "birth_days": "CAST((c_custkey * 37) % 9000 AS INT)",
    "gender": "CASE c_custkey % 4 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' WHEN 3 THEN 'Another' END",
    "english": "CASE WHEN c_custkey % 5 < 3 THEN 'Yes' ELSE 'No' END",
    "other_language": "CASE WHEN c_custkey % 5 < 3 THEN NULL ELSE 'Language ' || CAST(c_custkey % 9 AS STRING) END",
    "country": "n_name",
    "scholarship": "CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 6 < 4 THEN 'Yes' ELSE 'No' END",
    "school": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END",
    "guardian_1": """CASE c_custkey % 8 WHEN 0 THEN 'Graduate Degree (PhD, MD, JD...)'
      WHEN 1 THEN 'Bachelor’s Degree (finished university)' WHEN 2 THEN 'Not been to school'
      WHEN 3 THEN 'They terminated school at or before age thirteen'
      WHEN 4 THEN 'They terminated school before age eighteen'
      WHEN 5 THEN 'They completed high school, or their primary education' WHEN 6 THEN 'Trade certificate' END""",
    "guardian_2": """CASE (c_custkey + 3) % 8 WHEN 0 THEN 'Graduate Degree (PhD, MD, JD...)'
      WHEN 1 THEN 'Bachelor’s Degree (finished university)' WHEN 2 THEN 'Not been to school'
      WHEN 5 THEN 'They completed high school, or their primary education' WHEN 6 THEN 'Trade certificate' END""",
    "quintile": """CASE (c_custkey + CAST(floor(c_acctbal) AS INT)) % 7 WHEN 0 THEN 'Fifth quintile (Bottom 20%)'
      WHEN 1 THEN 'Fourth quintile' WHEN 2 THEN 'Third quintile' WHEN 3 THEN 'Second quintile'
      WHEN 4 THEN 'Top quintile (Top 20%)' WHEN 5 THEN 'Unsure' END""",
    "phone": "CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Pre-paid' ELSE 'Post-paid' END",
    "subscriptions": """CASE c_custkey % 5 WHEN 1 THEN 'News' WHEN 2 THEN 'News, Music'
      WHEN 3 THEN 'News, Music, Video' WHEN 4 THEN 'Music, Games' END""",
    "balance": "c_acctbal",
}


def _self_answer(factor: int) -> str:
    return (f"CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'n/a' "
            f"ELSE CAST(1 + (c_custkey * {factor} + 3) % 10 AS STRING) || ' out of 10' END")


def _interview_answer(j: int) -> str:
    skipped = "WHEN l_tax = 0 THEN NULL" if j % 2 == 0 else ""
    return (f"CASE WHEN l_discount = 0 THEN '-9' {skipped} "
            f"ELSE CAST(1 + (CAST(l_quantity AS INT) + {j}) % 5 AS STRING) || ' pts' END")


def _quiz_answer(j: int) -> str:
    return (f"CASE WHEN (k + {j}) % 29 = 0 THEN NULL "
            f"ELSE substr('abcd', CAST(1 + (k + {7 * j} + event_id) % 4 AS INT), 1) END")


_REVIEW = {
    "pos": "event_id",
    "name": "'User ' || CAST(user_id AS STRING)",
    "email": "'User' || CAST(user_id AS STRING) || '@Mail.org'",
    "form": "event_type",
    "submitted": "CAST(ts AS DATE)",
    "question": f"""CASE WHEN k % 11 = 0 THEN 'Rank the videos' WHEN k % 17 = 0 THEN 'Do you have any feedback for us?'
      ELSE 'UID: ' || CAST(1000 + CAST(floor(event_id / 500.0) AS INT) % 100 AS STRING) || ' ' ||
      CASE WHEN k % 4 = 0 THEN {_FORM_QUESTION}
      ELSE 'Q' || CAST(1 + k % 4 AS STRING) || '. How strong is this? [Scaled Feedback]' END END""",
    "answer": """CASE WHEN k % 11 = 0 THEN 'Video ' || CAST(k % 6 AS STRING) WHEN k % 17 = 0 THEN 'ok'
      WHEN k % 23 = 0 THEN NULL ELSE CAST(1 + (k + event_id) % 5 AS STRING) || ' stars' END""",
}


class Study:
    """Lazy study views over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._built: dict[str, DataFrame] = {}

    def once(self, name: str, build) -> DataFrame:
        """A derived table that several steps of one query share."""
        if name not in self._built:
            self._built[name] = build()
        return self._built[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def places(self) -> DataFrame:
        regions = self.table("region")
        return self.table("nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))

    @cached_property
    def roster(self) -> DataFrame:
        people = self.table("supplier").join(self.places, F.col("s_nationkey") == F.col("n_nationkey"))
        return people.select(F.col("r_name").alias("grp"), F.col("s_suppkey").alias("person"),
                             F.col("s_name").alias("name"))

    @cached_property
    def ratings(self) -> DataFrame:
        lines = self.table("lineitem").join(self.roster, F.col("l_suppkey") == F.col("person"))
        return lines.select(
            F.col("l_partkey").alias("rater"), F.col("l_suppkey").alias("ratee"),
            F.expr(TRAIT_CASE).alias("trait"), "grp", "name",
            F.expr("CASE WHEN l_discount = 0 THEN NULL "
                   "ELSE CAST(1 + CAST(l_quantity AS INT) % 5 AS DOUBLE) END").alias("score"),
            F.expr("CAST(l_quantity AS INT)").alias("qty"),
            F.expr("CAST(round(l_tax * 100) AS INT)").alias("tax"),
            "l_orderkey", "l_linenumber", "l_shipdate",
        )

    @cached_property
    def person_scores(self) -> DataFrame:
        return self.ratings.groupBy(F.col("ratee").alias("person"), "grp", "trait").agg(
            F.expr("CAST(sum(qty) % 17 AS DOUBLE)").alias("theta"),
            F.expr("CAST(count(1) % 11 AS DOUBLE)").alias("teacher_theta"),
            F.expr("CAST(sum(tax) % 13 AS DOUBLE)").alias("student_theta"),
            F.expr("sum(score) % 19").alias("interview_score"),
        )

    @cached_property
    def teacher_form(self) -> DataFrame:
        marks = [F.expr(f"CAST(sum(CASE WHEN trait = '{t}' THEN qty END) % 6 AS DOUBLE)").alias(t)
                 for t in TEACHER_TRAITS[:6]]
        return self.ratings.groupBy(F.col("name").alias("Student"), F.col("ratee").alias("person"), "grp").agg(
            *marks,
            F.expr("CAST(1 + count(1) % 7 AS DOUBLE)").alias("Creativity"),
            F.expr("CAST(1 + sum(l_linenumber) % 6 AS DOUBLE)").alias("Interview-ability"),
            F.expr("CAST(sum(qty) % 100 AS DOUBLE)").alias("Standardized Test"),
        ).select("Student", F.expr("'S' || CAST(person AS STRING)").alias("Student ID"),
                 *TEACHER_TRAITS, "Standardized Test", "grp")

    @cached_property
    def nominations(self) -> DataFrame:
        places = self.places.select("n_nationkey", "r_name")
        voters = self.table("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
            "c_custkey", F.col("r_name").alias("grp"))
        picked = self.roster.select("person", "name")
        return (
            self.table("lineitem")
            .join(self.table("orders").select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey"))
            .join(voters, F.expr("o_custkey = c_custkey"))
            .join(picked, F.expr("l_suppkey = person"))
            .select(F.col("o_custkey").alias("nominator"), F.expr(TRAIT_CASE).alias("trait"),
                    F.expr(RANK).alias("rank"), "grp", F.col("l_suppkey").alias("nominee"),
                    F.col("name").alias("nominee_name"), "l_shipdate", "l_orderkey")
        )

    @cached_property
    def nomination_form(self) -> DataFrame:
        order = F.struct("l_shipdate", "l_orderkey", "nominee")
        cells = [
            F.min_by("nominee_name", F.when((F.col("trait") == t) & (F.col("rank") == k), order))
            .alias(f"{CLASSMATE[t]} {k}")
            for t in CLASSMATE for k in (1, 2, 3)
        ]
        return self.nominations.groupBy("nominator", "grp").agg(*cells).select(
            F.expr("'S' || CAST(nominator AS STRING)").alias("Student ID"),
            F.col("grp").alias("group_peer"), *[f"{CLASSMATE[t]} {k}" for t in CLASSMATE for k in (1, 2, 3)],
        )

    @cached_property
    def self_form(self) -> DataFrame:
        people = self.table("customer").join(self.places, F.col("c_nationkey") == F.col("n_nationkey"))
        return people.select(
            F.expr("'S' || CAST(c_custkey AS STRING)").alias("Student ID"), F.col("r_name").alias("group_peer"),
            *[F.expr(_self_answer(2 * i + 3)).alias(q) for i, q in enumerate(SELF_QUESTIONS)],
        )

    @cached_property
    def interview_form(self) -> DataFrame:
        return self.table("lineitem").select(
            F.expr("'S' || CAST(l_suppkey AS STRING)").alias("candidate"),
            F.expr("'I' || CAST(l_partkey AS STRING)").alias("Interviewer"),
            *[F.expr(_interview_answer(j)).alias(t) for j, t in enumerate(INTERVIEW_TRAITS)],
        )

    @cached_property
    def tracker(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_name").alias("Name"), F.expr("'s' || CAST(s_suppkey AS STRING)").alias("Student ID"),
            F.expr("CAST(1000 + s_suppkey AS STRING)").alias("User ID"), F.col("s_suppkey").alias("person"),
        )

    @cached_property
    def progress(self) -> DataFrame:
        return self.table("orders").select(
            F.expr("CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'P' || CAST(o_custkey AS STRING) END").alias("Name"),
            *[F.expr(_PROGRESS[s]).alias(s) for s in STEPS],
        )

    @cached_property
    def submissions(self) -> DataFrame:
        return self.table("events").withColumn("k", F.expr("CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"))

    @cached_property
    def quiz_form(self) -> DataFrame:
        return self.submissions.select(
            F.expr("CAST(ts AS DATE)").alias("submitted"), F.expr("'User ' || CAST(user_id AS STRING)").alias("name"),
            F.expr("'S' || CAST(user_id AS STRING)").alias("student_id"), "event_id",
            *[F.expr(_quiz_answer(j)).alias(f"Item {j + 3}") for j in range(1, 5)],
        )

    @cached_property
    def quiz_key(self) -> DataFrame:
        from scoreframe.sources.scan import inline_table

        return inline_table(self.spark, QUIZ_KEY, "question_number int, correct string")

    @cached_property
    def review_rows(self) -> DataFrame:
        return self.submissions.select(*[F.expr(e).alias(c) for c, e in _REVIEW.items()])

    @cached_property
    def demographic_form(self) -> DataFrame:
        people = self.table("customer").join(self.places, F.col("c_nationkey") == F.col("n_nationkey"))
        return people.select(*[F.expr(e).alias(c) for c, e in _DEMOGRAPHIC.items()])

    @cached_property
    def draws(self) -> DataFrame:
        cell = f"'theta[' || CAST(l_suppkey + 1 AS STRING) || ',' || CAST({TRAIT_NUMBER} AS STRING) || ']'"
        return self.table("lineitem").select(
            F.expr("l_orderkey * 10 + l_linenumber").alias("draw"), F.expr(cell).alias("variable"),
            F.expr("l_quantity - 25").alias("value"),
        )


def _list(columns: dict[str, str]) -> str:
    return ", ".join(f'{e} AS "{c}"' for c, e in columns.items())


def _sql(text: str) -> str:
    return text.replace("AS STRING)", "AS VARCHAR)")


_PLACES = "nation JOIN region ON n_regionkey = r_regionkey"
VIEW_SQL = {k: _sql(v) for k, v in {
    "roster": f"""SELECT r_name AS grp, s_suppkey AS person, s_name AS name
      FROM supplier JOIN ({_PLACES}) ON s_nationkey = n_nationkey""",
    "ratings": f"""SELECT l_partkey AS rater, l_suppkey AS ratee, {TRAIT_CASE} AS trait, grp, name,
      CASE WHEN l_discount = 0 THEN NULL ELSE CAST(1 + CAST(l_quantity AS INT) % 5 AS DOUBLE) END AS score,
      CAST(l_quantity AS INT) AS qty, CAST(round(l_tax * 100) AS INT) AS tax, l_orderkey, l_linenumber, l_shipdate
      FROM lineitem JOIN roster ON l_suppkey = person""",
    "person_scores": """SELECT ratee AS person, grp, trait, CAST(sum(qty) % 17 AS DOUBLE) AS theta,
      CAST(count(*) % 11 AS DOUBLE) AS teacher_theta, CAST(sum(tax) % 13 AS DOUBLE) AS student_theta,
      sum(score) % 19 AS interview_score FROM ratings GROUP BY ALL""",
    "teacher_form": "SELECT name AS \"Student\", 'S' || CAST(ratee AS STRING) AS \"Student ID\", "
      + ", ".join(f"CAST(sum(CASE WHEN trait = '{t}' THEN qty END) % 6 AS DOUBLE) AS \"{t}\"" for t in TEACHER_TRAITS[:6])
      + """, CAST(1 + count(*) % 7 AS DOUBLE) AS "Creativity", CAST(1 + sum(l_linenumber) % 6 AS DOUBLE) AS "Interview-ability",
      CAST(sum(qty) % 100 AS DOUBLE) AS "Standardized Test", grp FROM ratings GROUP BY name, ratee, grp""",
    "nominations": f"""SELECT o_custkey AS nominator, {TRAIT_CASE} AS trait, {RANK} AS rank, r_name AS grp,
      l_suppkey AS nominee, name AS nominee_name, l_shipdate, l_orderkey
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN ({_PLACES}) ON c_nationkey = n_nationkey JOIN roster ON l_suppkey = person""",
    "nomination_form": "SELECT 'S' || CAST(nominator AS STRING) AS \"Student ID\", grp AS group_peer, " + ", ".join(
      f"first(nominee_name ORDER BY l_shipdate, l_orderkey, nominee) FILTER (WHERE trait = '{t}' AND rank = {k}) AS \"{CLASSMATE[t]} {k}\""
      for t in CLASSMATE for k in (1, 2, 3)) + " FROM nominations GROUP BY nominator, grp",
    "self_form": "SELECT 'S' || CAST(c_custkey AS STRING) AS \"Student ID\", r_name AS group_peer, "
      + _list({q: _self_answer(2 * i + 3) for i, q in enumerate(SELF_QUESTIONS)})
      + f" FROM customer JOIN ({_PLACES}) ON c_nationkey = n_nationkey",
    "interview_form": "SELECT 'S' || CAST(l_suppkey AS STRING) AS candidate, 'I' || CAST(l_partkey AS STRING) AS \"Interviewer\", "
      + _list({t: _interview_answer(j) for j, t in enumerate(INTERVIEW_TRAITS)}) + " FROM lineitem",
    "tracker": """SELECT s_name AS "Name", 's' || CAST(s_suppkey AS STRING) AS "Student ID",
      CAST(1000 + s_suppkey AS STRING) AS "User ID", s_suppkey AS person FROM supplier""",
    "progress": "SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'P' || CAST(o_custkey AS STRING) END AS \"Name\", "
      + _list(_PROGRESS) + " FROM orders",
    "submissions": "SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events",
    "quiz_form": "SELECT CAST(ts AS DATE) AS submitted, 'User ' || CAST(user_id AS STRING) AS name, "
      "'S' || CAST(user_id AS STRING) AS student_id, event_id, "
      + _list({f"Item {j + 3}": _quiz_answer(j) for j in range(1, 5)}) + " FROM submissions",
    "quiz_key": "SELECT * FROM (VALUES " + ", ".join(str(r) for r in QUIZ_KEY) + ") v(question_number, correct)",
    "review_rows": f"SELECT {_list(_REVIEW)} FROM submissions",
    "demographic_form": f"SELECT {_list(_DEMOGRAPHIC)} FROM customer JOIN ({_PLACES}) ON c_nationkey = n_nationkey",
    "draws": f"""SELECT l_orderkey * 10 + l_linenumber AS draw,
      'theta[' || CAST(l_suppkey + 1 AS STRING) || ',' || CAST({TRAIT_NUMBER} AS STRING) || ']' AS variable,
      l_quantity - 25 AS value FROM lineitem""",
}.items()}


def with_views(sql: str) -> str:
    """Prefix a checking query with the study views it names."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for view in VIEW_SQL:
            if view not in needed and re.search(rf"\b{view}\b", text):
                visit(VIEW_SQL[view])
                needed.append(view)

    visit(sql)
    body = sql.strip()
    head = ",\n".join(f"{v} AS MATERIALIZED ({VIEW_SQL[v]})" for v in needed)
    if not head:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{head},\n{body[len(start):]}"
    return f"WITH {head}\n{body}"
