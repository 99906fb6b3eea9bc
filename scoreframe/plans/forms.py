"""From response forms to long measurement tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.functions import text
from scoreframe.functions.columns import cols_containing
from scoreframe.functions.missing import as_col, count_matches, strict_sum
from scoreframe.operators import grouped, joins, ordered, reshape
from scoreframe.sources.scan import inline_table


def score_quiz(form: DataFrame, key: DataFrame, questions: list[str], offset: int,
               order: list[str], attempt: str = "last") -> DataFrame:
    """Score of each person's last (or first) attempt and its percentile bucket.

    ``form``: (name, student_id, submitted, *order*, one column per question). Attempts
    at the same time all count. An unanswered item makes the score missing.
    """
    kept = grouped.keep_latest(form, "submitted", ["name"], latest=attempt == "last")
    long = reshape.to_long(kept, questions, "question", "answer", "pos")
    long = long.withColumn("question_number", text.question_number("question", offset))
    marked = joins.left_on(long, key, ["question_number"])
    scores = marked.groupBy("name").agg(
        F.lower(grouped.first_value("student_id", [*order, "pos"])).alias("student_id"),
        count_matches(F.col("answer") == F.col("correct")).alias("score"),
    )
    return ordered.bucket(scores, "score", 100, ["name"], "percentile")


def nominations_to_long(form: DataFrame, people: DataFrame, corrections: dict[str, str]) -> DataFrame:
    """One row per nomination box: nominator, trait, number of the pick, nominee.

    The nominee's id is looked up before the name corrections are applied.
    """
    boxes = cols_containing(form, "classmate")
    headers = inline_table(form.sparkSession, [(b,) for b in boxes], "box string").select(
        "box", text.parse_number("box").cast("int").alias("nomination_number"),
        text.nomination_trait(text.strip_ordinal("box")).alias("trait"))
    long = reshape.to_long(form, boxes, "box", "name").join(headers, "box")
    long = long.select(F.lower("Student ID").alias("nominator_id"), "group_peer", "name",
                       "nomination_number", "trait")
    ids = people.select(F.col("Name").alias("name"), F.col("Student ID").alias("student_id"))
    return text.correct_names(joins.left_on(long, ids, ["name"]), "name", corrections)


def teacher_marks_to_long(form: DataFrame, traits: list[str]) -> DataFrame:
    """Teacher marks scaled within (trait, group), with two companion traits per student."""
    ids = ["Student", "Student ID", "grp", "Standardized Test"]
    long = reshape.to_long(form.select(*[as_col(c) for c in [*ids, *traits]]), traits, "trait", "teacher_raw")
    long = long.select(
        F.col("Student").alias("name"), F.lower("Student ID").alias("student_id"), "grp", "trait",
        "teacher_raw", F.col("Standardized Test").alias("test_raw"),
    )
    long = grouped.zscore(long, {"teacher_raw": "teacher_score", "test_raw": "standardized_test"}, ["trait", "grp"])

    def companion(trait: str) -> Column:
        return F.max(F.when(F.col("trait") == trait, F.col("teacher_score")))

    return grouped.attach(long, ["name"], interviewability=companion("Interview-ability"),
                          creativity=companion("Creativity")).drop("test_raw")


def interviews_to_long(form: DataFrame, people: DataFrame, traits: list[str],
                       need_user: bool = False) -> DataFrame:
    """Interview marks as numbers, the sentinel removed, candidate looked up."""
    long = reshape.to_long(form, traits, "trait", "rating", ids=["candidate", "Interviewer"])
    long = long.select(
        F.col("Interviewer").alias("interviewer"), F.lower("candidate").alias("student_id"), "trait",
        text.not_given(text.parse_number("rating"), -9).alias("score"),
    )
    ids = people.select(F.col("Student ID").alias("student_id"), F.col("Name").alias("name"),
                        F.col("User ID").alias("user_id"))
    out = joins.left_on(long, ids, ["student_id"])
    return out.filter(F.col("user_id").isNotNull()) if need_user else out.drop("user_id")


def self_ratings_to_long(form: DataFrame, people: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Self ratings scaled within (group, trait)."""
    named = form.withColumnsRenamed(renames)
    long = reshape.to_long(named, list(renames.values()), "trait", "response")
    long = long.select("group_peer", F.lower("Student ID").alias("student_id"), "trait", "response",
                       text.parse_number("response").alias("score"))
    long = grouped.zscore(long, {"score": "scaled_score"}, ["group_peer", "trait"])
    ids = people.select(F.lower("Student ID").alias("student_id"), F.col("Name").alias("name"))
    return joins.left_on(long, ids, ["student_id"])


def clean_demographics(form: DataFrame, as_of: str) -> DataFrame:
    """One row per name with recoded answers and subscription count; the first row of a name (by id) is kept."""
    def answered(c: str) -> Column:
        return F.coalesce(as_col(c), F.lit("Unanswered"))

    people = grouped.first_rows(form, ["name"], ["id"])
    born = F.date_add(F.lit("1985-01-01").cast("date"), F.col("birth_days"))
    return people.select(
        F.col("id").alias("demographics_id"), "name", F.lower("student_id").alias("student_id"),
        F.when(F.col("other_language").isNull(), "No").otherwise("Yes").alias("esl"),
        text.age_in_years(born, as_of).alias("age"), "alternate_email",
        text.recode("gender", {"Female": "Female", "Male": "Male"}, "Other").alias("gender"),
        F.col("english").alias("english_household"), F.col("country").alias("education_country"),
        answered("scholarship").alias("scholarship"), answered("school").alias("school_type"),
        text.education_level("guardian_1").alias("guardian_one"),
        text.education_level("guardian_2").alias("guardian_two"),
        F.coalesce("quintile", F.lit("Prefer not to say")).alias("income_quintile"),
        answered("phone").alias("mobile_plan"),
        reshape.list_length(answered("subscriptions")).alias("paid_subscriptions"), "balance",
    )


def with_role(people: DataFrame, interviewers: DataFrame, reviewers: DataFrame, participants: DataFrame) -> DataFrame:
    """Adds ``type``, the role: ``interviewers`` (name); ``reviewers`` (name, student_id); ``participants`` (student_id)."""
    people = joins.flag_member(people, F.col("name"), interviewers, F.col("name"), "is_interviewer")
    people = joins.flag_member(people, F.col("student_id"), reviewers, F.lower("student_id"), "is_reviewer_id")
    people = joins.flag_member(people, F.col("name"), reviewers, F.col("name"), "is_reviewer_name")
    people = joins.flag_member(people, F.col("student_id"), participants, F.lower("student_id"), "is_participant")
    role = (
        F.when(F.col("is_interviewer"), "Interviewer")
        .when(F.col("is_reviewer_id") | F.col("is_reviewer_name"), "Peer reviewer")
        .when(F.col("is_participant"), "Study participant").otherwise("Other")
    )
    return people.withColumn("type", role).drop(
        "is_interviewer", "is_reviewer_id", "is_reviewer_name", "is_participant")


def clean_reviews(rows: DataFrame, question_trait: DataFrame, corrections: dict[str, str]) -> DataFrame:
    """Video review rows with person id, question text, video number and trait of the form.

    ``rows``: (pos, name, email, form, submitted, question, answer), ``pos`` giving the
    order in which the questions were shown.
    """
    parsed = rows.withColumns({
        "uid": text.extract("question", "UID: [0-9]{4}"),
        "question_text": text.extract("question", "Q[0-9]{1,2}.*"),
    })
    runs = ordered.run_id(parsed, ["name", "form"], ["pos"], "uid", "run")
    runs = runs.withColumn("video_number", F.concat(F.lit("Video "), F.col("run").cast("string"))).drop("run")
    first_questions = question_trait.withColumnRenamed("trait", "question_trait")
    known = joins.left_on(runs, first_questions, ["question_text"])
    out = grouped.attach(known, ["form"], trait=grouped.first_present("question_trait", ["pos"]))
    out = out.drop("question_trait").withColumn("email", F.lower("email"))
    return text.correct_names(out, "name", corrections)


def videos_in_forms(reviews: DataFrame) -> DataFrame:
    """(form, video_number) to the person shown."""
    shown = reviews.filter(F.col("uid").isNotNull())
    first = shown.groupBy("form", "video_number").agg(grouped.first_value("uid", ["pos"]).alias("uid"))
    return first.withColumn("uid", text.after_uid("uid"))


def likert_reviews(reviews: DataFrame) -> DataFrame:
    """Numeric review answers, centred on each rater's mean for the question."""
    scaled = reviews.filter(text.matches("question_text", "Scaled Feedback"))
    scaled = scaled.withColumns({
        "uid2": text.after_uid("uid"),
        "question_number": text.extract("question", "Q[0-9]{1}"),
        "numeric_response": text.parse_number("answer"),
    })
    return grouped.centre(scaled, "numeric_response", ["name", "question_text"], "scaled_numeric")


def completion_funnel(progress: DataFrame, steps: list[str]) -> DataFrame:
    """People who completed each step; unknown where any person's flag is unknown."""
    long = reshape.to_long(progress.select(*[as_col(s) for s in steps]), steps, "step", "completed")
    return long.groupBy("step").agg(strict_sum(F.col("completed").cast("int")).alias("n_completed"))
