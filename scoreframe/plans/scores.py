"""Scores per person and trait, agreement between sources, analysis tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.functions import text
from scoreframe.functions.missing import (as_col, fill_and_flag, if_known, strict_avg, weighted_avg)
from scoreframe.operators import grouped, joins, ordered, reshape
from scoreframe.session import cut_lineage


def teacher_with_nominations(teacher: DataFrame, counts: DataFrame) -> DataFrame:
    """Teacher rows with their number of nominations, none counting as zero."""
    out = joins.left_on(teacher, counts, ["name", "student_id", "trait"])
    return out.withColumn("n_nominations", F.coalesce("n_nominations", F.lit(0)))


def ground_truth_table(teacher: DataFrame, counts: DataFrame, self_ratings: DataFrame) -> DataFrame:
    """Teacher score, nominations scaled within the group over all traits, self score.

    ``counts``: (name, student_id, trait, group_peer, n_nominations). A row without
    nominations has no ``group_peer`` and meets only self ratings without one.
    """
    out = teacher_with_nominations(teacher, counts)
    out = grouped.zscore(out, {"n_nominations": "scaled_nominations"}, ["grp"])
    own = self_ratings.select("student_id", "trait", "name", "group_peer",
                              F.col("scaled_score").alias("self_score"))
    return joins.left_on(out, own, ["name", "student_id", "trait", "group_peer"])


def normalised_interviews(ratings: DataFrame, reference: DataFrame, strict: bool = False) -> DataFrame:
    """Mean rater-scaled mark per (person, trait) beside the reference, scaled by group.

    ``ratings``: (rater, ratee, trait, score); ``reference``: (person, grp, trait, theta).
    """
    scaled = grouped.zscore(ratings.select("rater", "ratee", "trait", "score"), {"score": "z"}, ["rater"])
    mean = strict_avg("z") if strict else F.avg("z")
    people = scaled.groupBy(F.col("ratee").alias("person"), "trait").agg(mean.alias("interview"))
    joined = joins.left_on(people, reference, ["person", "trait"])
    out = grouped.zscore(joined, {"interview": "interview_z"}, ["grp"])
    return out.filter("interview_z IS NOT NULL AND theta IS NOT NULL")


def with_person(likert: DataFrame, tracker: DataFrame) -> DataFrame:
    ids = tracker.select(F.col("User ID").alias("uid2"), "person")
    return joins.left_on(likert, ids, ["uid2"])


def naive_peer_scores(likert: DataFrame, tracker: DataFrame, reference: DataFrame,
                      inclusive: bool = True) -> DataFrame:
    """Mean centred review mark per person beside the reference, scaled within groups."""
    rows = with_person(likert, tracker)
    rows = joins.left_on(rows, reference.select("person", "trait", "grp", "theta", "interview_score"),
                         ["person", "trait"])
    rows = grouped.keep_within_range(rows, "scaled_numeric", ["uid2", "trait"], inclusive)
    means = rows.groupBy("trait", "uid2", "grp").agg(
        F.avg("scaled_numeric").alias("peer_mean"), F.avg("theta").alias("theta"),
        F.avg("interview_score").alias("interview_score"))
    return grouped.zscore(means, ["peer_mean", "theta", "interview_score"], ["grp"])


def ranked_choice_scores(reviews: DataFrame, videos: DataFrame, size: int = 6) -> DataFrame:
    """Position of each video in the raters' last rankings, as ``size`` down to 1."""
    last = grouped.keep_latest(reviews, "submitted", ["email"])
    ranked = last.filter(F.col("uid").isNull() & ~text.matches("question", "Do you have any feedback for us"))
    ranked = ranked.select("trait", "name", "email", "answer", "question", "form", "pos")
    shown = videos.withColumnRenamed("uid", "uid_reviewee")
    ranked = joins.left_on(ranked, shown, ["form", ("answer", "video_number")])
    return ordered.positional_score(ranked, ["form", "email"], ["pos"], size, "score")


def reviewer_identities(likert: DataFrame, lookup: DataFrame) -> DataFrame:
    """Each reviewer address with its demographics id."""
    addresses = likert.groupBy("email", "name").agg(F.count(F.lit(1)).alias("n"))
    return joins.left_on(addresses, lookup, ["email"])


def candidate_identities(tracker: DataFrame, lookup: DataFrame) -> DataFrame:
    known = tracker.filter(F.col("Student ID").isNotNull())
    ids = known.select(F.col("User ID").alias("user_id"), F.lower("Student ID").alias("email"))
    out = joins.left_on(ids, lookup.withColumnRenamed("id", "reviewee_id"), ["email"])
    return out.select("user_id", "reviewee_id")


def rating_facts(likert: DataFrame, reviewers: DataFrame, candidates: DataFrame, people: DataFrame,
                 reference: DataFrame, quiz: DataFrame) -> DataFrame:
    """Review marks with the attributes and quiz scores of both parties.

    A party whose identity is unknown has no proximity to the other, so such rows
    leave early instead of meeting every other unknown identity.

    ``reviewers``: (email, id); ``candidates``: (user_id, reviewee_id); ``people`` has
    ``demographics_id``; ``reference``: (uid2, trait, grp, theta); ``quiz``: (id, score).
    """
    facts = likert.filter("numeric_response IS NOT NULL")
    facts = joins.left_on(facts, reviewers.select("email", F.col("id").alias("reviewer_id")).distinct(), ["email"])
    facts = joins.left_on(facts, candidates, [("uid2", "user_id")])
    facts = facts.dropna(subset=["reviewer_id", "reviewee_id"])
    facts = joins.join_in_role(facts, people, "demographics_id", "reviewee_id", "reviewee")
    facts = joins.join_in_role(facts, people, "demographics_id", "reviewer_id", "reviewer")
    facts = joins.left_on(facts, reference, ["uid2", "trait"])
    for role in ("reviewee", "reviewer"):
        facts = joins.left_on(facts, quiz.withColumnRenamed("score", f"{role}_quiz"), [(f"{role}_id", "id")])
    return facts.dropna(subset=["theta", "reviewee_quiz", "reviewer_quiz"])


def with_proximity(facts: DataFrame, proximity: DataFrame) -> DataFrame:
    """Facts whose two parties have a known proximity."""
    return joins.left_on(facts, proximity, ["reviewer_id", "reviewee_id"]).filter("proximity IS NOT NULL")


def indexed_facts(facts: DataFrame, codes: dict[str, str]) -> DataFrame:
    """Facts with a dense 1-based index per coded column."""
    for column, code in codes.items():
        facts = ordered.encode(facts, column, code)
    return facts


def peer_teacher_alignment(cells: DataFrame, students: DataFrame, traits: DataFrame) -> DataFrame:
    """Two fitted scores per parameter cell, scaled within (trait, group)."""
    keyed = cells.withColumns({
        "student_index": text.cell_index("variable", 1).cast("bigint"),
        "trait_index": text.cell_index("variable", 2).cast("bigint"),
    }).drop("variable")
    out = joins.natural_left(joins.natural_left(keyed, students), traits)
    return grouped.zscore(out, ["teacher_theta", "student_theta"], ["trait", "grp"])


def scores_by_income(scores: DataFrame, people: DataFrame, values: list[str]) -> DataFrame:
    """Mean of each score per (trait, income quintile) and which way interviews err.

    People whose answer is none of the five quintiles form a group of their own.
    """
    answers = people.select(F.col("demographics_id").alias("person"), "income_quintile")
    out = joins.left_on(scores, answers, ["person"]).filter("income_quintile IS NOT NULL")
    out = out.withColumn("income", text.income_code("income_quintile"))
    means = out.groupBy("trait", "income").agg(
        F.count(F.lit(1)).alias("n"), *[strict_avg(v).alias(v) for v in values])
    gap = F.col("theta") > F.col("interview_score")
    return means.withColumn("help_hurt", if_known(gap, "1", "2"))


def scaled_scores_by_income(scores: DataFrame, people: DataFrame) -> DataFrame:
    """The same with scores scaled per trait first and unknown quintiles left out."""
    answers = people.select(F.col("demographics_id").alias("person"), "income_quintile")
    out = joins.left_on(scores, answers, ["person"])
    out = out.withColumn("income", text.income_code("income_quintile")).filter("income IS NOT NULL")
    out = grouped.zscore(out.select("person", "trait", "income", "theta", "interview_score"),
                         ["theta", "interview_score"], ["trait"])
    means = out.groupBy("income", "trait").agg(
        F.count(F.lit(1)).alias("n"), strict_avg("interview_score").alias("interviews"),
        strict_avg("theta").alias("ground_truth"))
    return means.withColumn(
        "interview_overestimate", if_known(F.col("interviews") > F.col("ground_truth"), "Help", "Hurt"))


def selection_scores(scores: DataFrame, traits: list[str]) -> DataFrame:
    """Mean over a set of traits per person, for the reference and the interview."""
    chosen = scores.filter(F.col("trait").isin(*traits))
    return chosen.groupBy("person").agg(
        strict_avg("theta").alias("true_selection"), strict_avg("interview_score").alias("interview_selection"))


def item_scores(likert: DataFrame, tracker: DataFrame, roster: DataFrame) -> DataFrame:
    """Mean review mark per (person, item); an item is a trait's question number."""
    rows = with_person(likert.filter("numeric_response IS NOT NULL"), tracker).filter("person IS NOT NULL")
    rows = rows.withColumn("item", F.concat("trait", "question_number"))
    means = rows.groupBy("person", "trait", "item").agg(F.avg("numeric_response").alias("peer_review"))
    means = ordered.encode(means, "item", "item_index")
    return joins.left_on(means, roster.select("person", "grp"), ["person"])


def item_scores_beside_reference(items: DataFrame, reference: DataFrame, chosen: list[int]) -> DataFrame:
    """Item scores scaled within (group, item), averaged per (person, trait)."""
    kept = items.filter(F.col("item_index").isin(*chosen))
    kept = joins.left_on(kept, reference.select("person", "trait", "theta", "interview_score"), ["person", "trait"])
    kept = grouped.zscore(kept, ["peer_review"], ["grp", "item_index"])
    return kept.groupBy("person", "trait").agg(
        strict_avg("peer_review").alias("peer_review"), strict_avg("theta").alias("theta"),
        strict_avg("interview_score").alias("interview"))


def weighted_peer_scores(likert: DataFrame) -> DataFrame:
    """Rater-centred marks averaged per (person, trait), questions weighted by 1 / sd."""
    centred = grouped.centre(likert, "numeric_response", ["name", "trait"], "c")
    centred = grouped.attach(centred, ["question_text"], error_scale=F.stddev_samp("c"))
    weight = F.try_divide(F.lit(1.0), F.col("error_scale"))
    return centred.groupBy("uid2", "trait").agg(weighted_avg("c", weight).alias("simple_score"))


ATTRIBUTES = ["esl", "age", "gender", "school_type", "income_quintile", "paid_subscriptions"]


def question_means(likert: DataFrame, tracker: DataFrame, reference: DataFrame, people: DataFrame) -> DataFrame:
    """Strict means per (person, question, trait, group) with attributes; complete rows only."""
    rows = with_person(likert, tracker)
    rows = joins.left_on(rows, reference.select("person", "trait", "grp", "theta", "interview_score"),
                         ["person", "trait"])
    attributes = people.select(F.col("demographics_id").alias("person"), *ATTRIBUTES)
    rows = joins.left_on(rows, attributes, ["person"])
    means = rows.groupBy("uid2", "question_number", "trait", "grp").agg(
        strict_avg("scaled_numeric").alias("scaled_numeric"), strict_avg("interview_score").alias("interview_score"),
        strict_avg("theta").alias("theta"),
        *[grouped.first_value(a, ["pos"]).alias(a) for a in ATTRIBUTES])
    return means.dropna("any")


def question_predictors(means: DataFrame, questions: list[str]) -> DataFrame:
    """Question means side by side with missing flags, absent questions filled."""
    ids = [c for c in means.columns if c not in ("question_number", "scaled_numeric")]
    wide = reshape.to_wide(means, ids, "question_number", "scaled_numeric", questions)
    return fill_and_flag(wide, questions, -5.0)


def relevant_question(questions: dict[str, list[str]]) -> Column:
    hit = F.lit(False)
    for trait, numbers in questions.items():
        hit = hit | ((F.col("trait") == trait) & F.col("question_number").isin(*numbers))
    return F.coalesce(hit, F.lit(False))


def simple_peer_scores(means: DataFrame, relevant: Column, how: str = "mean") -> DataFrame:
    """Score from a subset of questions: range-trimmed mean, or median."""
    by = ["trait", "uid2", "grp"]
    if how == "mean":
        kept = grouped.keep_within_range(means.filter(relevant), "scaled_numeric", by)
        return kept.groupBy(*by).agg(strict_avg("theta").alias("theta"), strict_avg("scaled_numeric").alias("prediction"))
    means = cut_lineage(means)
    scores = ordered.group_median(means, by, "theta", "theta")
    chosen = ordered.group_median(means.filter(relevant), by, "scaled_numeric", "prediction")
    return joins.left_on(scores, chosen, by)


def trait_against_others(scores: DataFrame, trait: str, value: str) -> DataFrame:
    """Rows of all other traits with the same person's score of ``trait``."""
    first = grouped.first_rows(scores, ["person", "trait"], ["grp", value])
    out = grouped.value_where(first, value, F.col("trait") == trait, ["person"], "compared")
    return out.filter(F.col("trait") != trait)


def teacher_peer_panel(teacher: DataFrame, counts: DataFrame) -> DataFrame:
    """Teacher and peer scores of every trait in long form with each student's mean."""
    out = teacher_with_nominations(teacher, counts)
    out = grouped.zscore(out, {"n_nominations": "peer_score"}, ["trait", "grp"])
    out = out.select("trait", "name", "teacher_score", "peer_score")
    long = reshape.to_long(out, ["teacher_score", "peer_score"], "type", "score")
    return grouped.attach(long, ["trait", "name"], mean_score=strict_avg("score"))


def evidence_panel(interviews: DataFrame, teacher: DataFrame, counts: DataFrame) -> DataFrame:
    """Interviewer marks one by one beside one teacher and one peer score per student, which have no interviewer."""
    marks = grouped.zscore(teacher_with_nominations(teacher, counts), {"n_nominations": "peer_score"}, ["trait"])
    marks = marks.select(F.col("name").alias("student"), "student_id", "trait", "teacher_score", "peer_score", "grp")
    # Unpivoting and parsing the forms is the costly part, so it is done once.
    rows = cut_lineage(joins.left_on(interviews.drop("name"), marks, ["student_id", "trait"]))
    rows = grouped.zscore(rows, {"score": "interviewer_score"}, ["trait", "grp"]).filter("teacher_score IS NOT NULL")
    seen = rows.select("student_id", "trait").distinct()
    truth = joins.keep_known(marks.filter("teacher_score IS NOT NULL"), seen, ["student_id", "trait"])
    truth = truth.groupBy("trait", "student").agg(
        F.min("teacher_score").alias("teacher_score"), F.min("peer_score").alias("peer_score"))
    truth = reshape.to_long(truth, ["teacher_score", "peer_score"], "type", "value", ids=["trait", "student"])
    evidence = rows.select("trait", "interviewer", "student", F.lit("interviewer_score").alias("type"),
                           F.col("interviewer_score").alias("value"), F.lit("Interview").alias("evidence_type"))
    return evidence.unionByName(truth.withColumn("evidence_type", F.lit("Ground Truth")), allowMissingColumns=True)


def evidence_counts(interviews: DataFrame, teacher: DataFrame, counts: DataFrame) -> DataFrame:
    """``evidence_panel`` as (trait, student, type, evidence_type, value, n): equal marks of a student are one row.

    Marks are counted by (student, trait, score) before anything is joined to them, and scaled within
    (trait, group) by sums weighted with the counts, so no step after the count has a row for each mark.
    """
    marks = grouped.zscore(teacher_with_nominations(teacher, counts), {"n_nominations": "peer_score"}, ["trait"])
    marks = marks.select(F.col("name").alias("student"), "student_id", "trait", "teacher_score", "peer_score", "grp")
    equal = cut_lineage(interviews.groupBy("student_id", "trait", "score").agg(F.count(F.lit(1)).alias("n")))
    placed = cut_lineage(joins.left_on(equal, marks, ["student_id", "trait"]))
    n, score, by = F.col("n"), F.col("score").cast("double"), ["trait", "grp"]
    known = F.when(score.isNotNull(), n)
    rows = grouped.attach(placed, by, __n=F.sum(known), __mean=F.try_divide(F.sum(n * score), F.sum(known)),
                          __varies=F.min(score) < F.max(score))
    rows = grouped.attach(rows, by, __square=F.sum(n * (score - F.col("__mean")) ** 2))
    sd = F.when(F.col("__varies"), F.sqrt(F.try_divide(F.col("__square"), F.col("__n") - 1)))
    rows = rows.filter("teacher_score IS NOT NULL").withColumn("value", F.try_divide(score - F.col("__mean"), sd))
    truth = placed.filter("teacher_score IS NOT NULL").groupBy("trait", "student").agg(
        F.min("teacher_score").alias("teacher_score"), F.min("peer_score").alias("peer_score"))
    truth = reshape.to_long(truth, ["teacher_score", "peer_score"], "type", "value", ids=["trait", "student"])
    evidence = rows.select("trait", "student", F.lit("interviewer_score").alias("type"), F.lit("Interview").alias("evidence_type"), "value", "n")
    return evidence.unionByName(truth.select("trait", "student", "type", F.lit("Ground Truth").alias("evidence_type"), "value", F.lit(1).cast("bigint").alias("n")))


def candidate_summary(interviews: DataFrame, teacher: DataFrame, counts: DataFrame) -> DataFrame:
    """Mean interview mark per (candidate, trait) beside z(peer + teacher) per trait."""
    means = interviews.groupBy("student_id", "trait").agg(strict_avg("score").alias("interview_average"))
    marks = grouped.zscore(teacher_with_nominations(teacher, counts), {"n_nominations": "peer_score"}, ["trait"])
    out = joins.left_on(means, marks.select("student_id", "trait", "teacher_score", "peer_score"),
                        ["student_id", "trait"])
    out = out.withColumn("sum_score", F.col("peer_score") + F.col("teacher_score"))
    return grouped.zscore(out, {"sum_score": "ground_truth"}, ["trait"]).drop("sum_score")


def posterior_summary(draws: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sd, exact median and 90% interval of the draws of each parameter cell."""
    moments = draws.groupBy(*by).agg(F.avg(as_col(value)).alias("mean"), F.stddev_samp(as_col(value)).alias("sd"))
    points = ordered.group_quantiles(draws, by, value, {"median": 0.5, "q5": 0.05, "q95": 0.95})
    out = joins.left_on(moments, points, by)
    return out.withColumn("width", F.col("q95") - F.col("q5"))


def keyed_scores(cells: DataFrame, students: DataFrame, traits: DataFrame, academics: DataFrame) -> DataFrame:
    """Fitted cells with person, trait, group and one row of academic measures each."""
    keyed = cells.withColumns({
        "student_index": text.cell_index("variable", 1).cast("bigint"),
        "trait_index": text.cell_index("variable", 2).cast("bigint"),
    }).drop("variable")
    out = joins.natural_left(joins.natural_left(keyed, students), traits)
    one_each = grouped.first_rows(academics, ["student_id"], ["trait"]).drop("trait")
    return joins.left_on(out, one_each, ["student_id"])


def combined_score(scores: DataFrame, by: list[str]) -> DataFrame:
    """Ground truth from two sources: z of the sum of peer and teacher scores.

    Sums that differ only by rounding error count as equal.
    """
    total = F.round(F.col("student_theta") + F.col("teacher_theta"), 9)
    out = scores.withColumn("sum_score", total)
    return grouped.zscore(out, {"sum_score": "ground_truth"}, by).drop("sum_score")
