"""Score, agreement and analysis-table jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreframe.catalog import checks as ck
from scoreframe.catalog import query
from scoreframe.catalog.aggregates import CHOICE_SQL
from scoreframe.catalog.jobs import (address_lookup, interviews_long, likert, noms_count, people_clean, people_table,
                                     quiz_scores, reviews_clean, self_long, teacher_long)
from scoreframe.catalog.windows import z_sql
from scoreframe.functions.text import TRAITS
from scoreframe.operators import choice, grouped, joins, ordered, proximity, reshape
from scoreframe.plans import forms, scores
from scoreframe.session import cut_lineage

NOMINATION_ORDER = ["l_shipdate", "l_orderkey", "nominee"]
strict = ck.strict_avg_sql


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def sets(st):
    return choice.choice_sets(st.nominations, st.roster, NOMINATION_ORDER)


@query("c10_response_profile", """
SELECT name, count(*) AS n, count(DISTINCT numeric_response) + max(CASE WHEN numeric_response IS NULL THEN 1 ELSE 0 END) AS n_values
FROM likert GROUP BY name""")
def c10(st):
    return grouped.response_profile(likert(st), "name", "numeric_response")


@query("c10_distinct_groups", """
SELECT (SELECT count(*) FROM (SELECT uid2, trait FROM likert GROUP BY ALL)) AS n_cells,
  (SELECT count(*) FROM (SELECT uid2 FROM likert GROUP BY ALL)) AS n_people,
  (SELECT count(*) FROM (SELECT name FROM likert GROUP BY ALL)) AS n_raters""")
def c10_groups(st):
    marks = likert(st)
    return marks.agg(F.count_distinct(F.struct("uid2", "trait")).alias("n_cells"),
                     F.count_distinct(F.struct("uid2")).alias("n_people"),
                     F.count_distinct(F.struct("name")).alias("n_raters"))


@query("c11_naive_peer_scores", f"""
WITH j AS (SELECT l.uid2, l.trait, l.scaled_numeric, p.grp, p.theta, p.interview_score FROM likert_person l
  LEFT JOIN person_scores p ON p.person IS NOT DISTINCT FROM l.person AND p.trait = l.trait),
k AS (SELECT * FROM j WINDOW w AS (PARTITION BY uid2, trait)
  QUALIFY count(scaled_numeric) OVER w = count(*) OVER w AND scaled_numeric IS NOT NULL),
m AS (SELECT trait, uid2, grp, avg(scaled_numeric) AS peer_mean, avg(theta) AS theta, avg(interview_score) AS interview_score
  FROM k GROUP BY ALL)
SELECT trait, uid2, grp, round({z_sql('peer_mean', 'grp')}, 6) AS peer_mean, round({z_sql('theta', 'grp')}, 6) AS theta,
  round({z_sql('interview_score', 'grp')}, 6) AS interview_score FROM m""")
def c11(st):
    out = scores.naive_peer_scores(likert(st), st.tracker, st.person_scores)
    return rounded(out, "peer_mean", "theta", "interview_score")


RANKED_SQL = """ranked AS (
  SELECT r.*, v.uid AS uid_reviewee, 7 - row_number() OVER (PARTITION BY r.form, email ORDER BY pos) AS score
  FROM (SELECT * FROM reviews_clean QUALIFY submitted = max(submitted) OVER (PARTITION BY email)) r
  LEFT JOIN form_videos v ON v.form = r.form AND v.video_number = answer
  WHERE r.uid IS NULL AND NOT regexp_matches(question, 'Do you have any feedback for us'))"""


def ranked(st):
    reviews = reviews_clean(st)
    return scores.ranked_choice_scores(reviews, forms.videos_in_forms(reviews))


@query("c12_ranked_choice_scores", f"""
WITH {RANKED_SQL} SELECT uid_reviewee, trait, {strict('score')} AS score FROM ranked GROUP BY ALL""")
def c12(st):
    from scoreframe.functions.missing import strict_avg

    return ranked(st).groupBy("uid_reviewee", "trait").agg(strict_avg("score").alias("score"))


@query("c12_ranked_choice_wide", f"""
WITH {RANKED_SQL}, m AS (SELECT uid_reviewee, trait, avg(score) AS s FROM ranked GROUP BY ALL)
SELECT uid_reviewee, {", ".join(f'max(s) FILTER (WHERE trait = {chr(39)}{t}{chr(39)}) AS "{t}"' for t in TRAITS)} FROM m GROUP BY ALL""")
def c12_wide(st):
    means = ranked(st).groupBy("uid_reviewee", "trait").agg(F.avg("score").alias("s"))
    return reshape.to_wide(means, ["uid_reviewee"], "trait", "s", TRAITS)


FACT_SQL = """addresses AS (SELECT DISTINCT lower(email) AS email, demographics_id AS id FROM (
  SELECT demographics_id, student_id, alternate_email FROM people_clean) UNPIVOT (email FOR source IN (student_id, alternate_email))),
kept AS (SELECT * FROM quiz_form QUALIFY submitted = max(submitted) OVER (PARTITION BY name)),
q AS (SELECT min(lower(student_id)) AS student_id,
  CASE WHEN count(answer) = count(*) THEN CAST(sum(CASE WHEN answer = correct THEN 1 ELSE 0 END) AS BIGINT) END AS score
  FROM (SELECT * FROM kept UNPIVOT INCLUDE NULLS (answer FOR item IN ("Item 4", "Item 5", "Item 6", "Item 7")))
  LEFT JOIN quiz_key ON question_number = CAST(substr(item, 6, 1) AS INT) - 3 GROUP BY name),
quiz AS (SELECT id, score FROM q LEFT JOIN addresses ON email = student_id),
facts AS (SELECT l.pos, l.uid2, l.trait, l.numeric_response, r.id AS reviewer_id, c.id AS reviewee_id,
    a.school_type AS reviewee_school, b.school_type AS reviewer_school, s.grp, s.theta,
    qa.score AS reviewee_quiz, qb.score AS reviewer_quiz
  FROM likert_person l LEFT JOIN addresses r ON r.email = l.email
  LEFT JOIN tracker t ON t."User ID" = l.uid2 LEFT JOIN addresses c ON c.email = lower(t."Student ID")
  LEFT JOIN people_clean a ON a.demographics_id = c.id LEFT JOIN people_clean b ON b.demographics_id = r.id
  LEFT JOIN person_scores s ON s.person = l.person AND s.trait = l.trait
  LEFT JOIN quiz qa ON qa.id = c.id LEFT JOIN quiz qb ON qb.id = r.id
  WHERE l.numeric_response IS NOT NULL AND s.theta IS NOT NULL AND qa.score IS NOT NULL AND qb.score IS NOT NULL)"""


def review_facts(st):
    lookup = address_lookup(st)
    reviewers = scores.reviewer_identities(likert(st), lookup)
    candidates = scores.candidate_identities(st.tracker, lookup)
    people = people_table(st).select("demographics_id", "school_type", "gender", "age")
    reference = joins.left_on(st.person_scores, st.tracker, ["person"]).select(
        F.col("User ID").alias("uid2"), "trait", "grp", "theta")
    quiz = cut_lineage(joins.left_on(quiz_scores(st), lookup, [("student_id", "email")]).select("id", "score"))
    return scores.rating_facts(likert(st), reviewers, candidates, people, reference, quiz)


@query("c14_rating_facts", f"""
WITH {FACT_SQL} SELECT pos, uid2, trait, numeric_response, reviewer_id, reviewee_id, reviewee_school, reviewer_school,
  grp, theta, reviewee_quiz, reviewer_quiz FROM facts""")
def c14(st):
    return review_facts(st).select(
        "pos", "uid2", "trait", "numeric_response", "reviewer_id", "reviewee_id",
        F.col("reviewee_school_type").alias("reviewee_school"), F.col("reviewer_school_type").alias("reviewer_school"),
        "grp", "theta", "reviewee_quiz", "reviewer_quiz")


@query("c14_rating_facts_with_proximity")
def c14_proximity(st):
    facts = cut_lineage(review_facts(st).select(
        "pos", "uid2", "trait", "numeric_response", "reviewer_id", "reviewee_id"))
    leaves = proximity.leaf_vectors(people_table(st), "demographics_id", ["gender", "school_type", "esl"],
                                    ["age"], trees=20)
    pairs = facts.select("reviewer_id", "reviewee_id").distinct()
    close = proximity.pair_proximity(pairs, leaves, "reviewer_id", "reviewee_id", "demographics_id")
    return scores.with_proximity(facts, close)


@query("c15_indexed_facts", """
SELECT pos, CAST(numeric_response AS INT) AS y, dense_rank() OVER (ORDER BY question_text) AS item,
  dense_rank() OVER (ORDER BY lower(name)) AS reviewer, dense_rank() OVER (ORDER BY uid2) AS reviewee,
  dense_rank() OVER (ORDER BY trait) AS concept FROM likert WHERE numeric_response IS NOT NULL""")
def c15(st):
    facts = likert(st).filter("numeric_response IS NOT NULL").withColumn("rater", F.lower("name"))
    out = scores.indexed_facts(facts.select("pos", "numeric_response", "question_text", "rater", "uid2", "trait"), {
        "question_text": "item", "rater": "reviewer", "uid2": "reviewee", "trait": "concept"})
    return out.select("pos", F.col("numeric_response").cast("int").alias("y"), "item", "reviewer", "reviewee", "concept")


@query("c15_student_index", """
SELECT grp, person, name, row_number() OVER (ORDER BY name, grp, person) AS student_index FROM roster""")
def c15_students(st):
    return choice.index_roster(st.roster)


@query("c16_choice_sets", f"""
WITH {CHOICE_SQL} SELECT p.nominator, p.trait, p.rank, p.grp, p.nominee, count(m.person) AS set_size,
  coalesce(bool_or(m.person = p.nominee), false) AS winner_in_set
FROM picks p LEFT JOIN members m USING (nominator, trait, rank) GROUP BY ALL""")
def c16(st):
    return sets(st).select("nominator", "trait", "rank", "grp", "nominee",
                           F.col("set_size").cast("bigint").alias("set_size"), "winner_in_set")


@query("c17_nomination_shares", """
WITH c AS (SELECT name, trait, count(*) AS n FROM noms_long GROUP BY ALL)
SELECT t.name, t.trait, t.grp, n, round(n / sum(n) OVER (PARTITION BY t.grp, t.trait), 6) AS part
FROM teacher_long t LEFT JOIN c ON c.name = t.name AND c.trait = t.trait""")
def c17(st):
    from scoreframe.catalog.jobs import noms_long

    counts = choice.nomination_counts(noms_long(st), ["name", "trait"]).withColumnRenamed("n_nominations", "n")
    out = joins.left_on(teacher_long(st).select("name", "trait", "grp"), counts, ["name", "trait"])
    return rounded(grouped.share(out, "n", ["grp", "trait"], "part"), "part")


TEACHER_COUNTS_SQL = """tn AS (SELECT t.*, c.group_peer, coalesce(c.n_nominations, 0) AS n FROM teacher_long t
  LEFT JOIN noms_count c ON c.name = t.name AND c.student_id = t.student_id AND c.trait = t.trait)"""


@query("c18_ground_truth_table", f"""
WITH {TEACHER_COUNTS_SQL}, z AS (SELECT *, {z_sql('n', 'grp')} AS scaled_nominations FROM tn)
SELECT z.name, z.student_id, z.trait, z.grp, z.group_peer, round(z.teacher_score, 6) AS teacher_score,
  round(scaled_nominations, 6) AS scaled_nominations, round(s.scaled_score, 6) AS self_score
FROM z LEFT JOIN self_long s ON s.student_id = z.student_id AND s.trait = z.trait AND s.name = z.name
  AND s.group_peer IS NOT DISTINCT FROM z.group_peer""")
def c18(st):
    out = scores.ground_truth_table(teacher_long(st), noms_count(st), self_long(st))
    return rounded(out.select("name", "student_id", "trait", "grp", "group_peer", "teacher_score",
                              "scaled_nominations", "self_score"),
                   "teacher_score", "scaled_nominations", "self_score")


def normalised_sql(mean: str) -> str:
    return f"""
WITH z AS (SELECT ratee, trait, {z_sql('score', 'rater')} AS z FROM ratings),
m AS (SELECT ratee AS person, trait, {mean} AS interview FROM z GROUP BY ALL),
j AS (SELECT m.*, p.grp, p.theta FROM m LEFT JOIN person_scores p USING (person, trait)),
g AS (SELECT *, {z_sql('interview', 'grp')} AS interview_z FROM j)
SELECT person, trait, grp, theta, round(interview_z, 6) AS interview_z FROM g WHERE interview_z IS NOT NULL AND theta IS NOT NULL"""


@query("c19_normalised_interviews", normalised_sql("avg(z)"))
def c19(st):
    out = scores.normalised_interviews(st.ratings, st.person_scores.select("person", "trait", "grp", "theta"))
    return rounded(out.select("person", "trait", "grp", "theta", "interview_z"), "interview_z")


@query("c19_normalised_interviews_strict", normalised_sql(strict("z")))
def c19_strict(st):
    out = scores.normalised_interviews(st.ratings, st.person_scores.select("person", "trait", "grp", "theta"), True)
    return rounded(out.select("person", "trait", "grp", "theta", "interview_z"), "interview_z")


CELL_SQL = """cells AS (SELECT CAST(regexp_extract(variable, '\\[([0-9]+),([0-9]+)\\]', 1) AS BIGINT) AS student_index,
  CAST(regexp_extract(variable, '\\[([0-9]+),([0-9]+)\\]', 2) AS INT) AS trait_index, avg(value) AS teacher_theta,
  avg(value * (draw % 3)) AS student_theta FROM draws GROUP BY variable),
students AS (SELECT grp, person, name, row_number() OVER (ORDER BY name, grp, person) AS student_index FROM roster),
traits AS (SELECT trait, dense_rank() OVER (ORDER BY trait) AS trait_index FROM (SELECT DISTINCT trait FROM nominations))"""


def fitted_cells(st):
    return st.draws.groupBy("variable").agg(
        F.avg("value").alias("teacher_theta"), F.avg(F.col("value") * (F.col("draw") % 3)).alias("student_theta"))


@query("c20_peer_teacher_alignment", f"""
WITH {CELL_SQL}, j AS (SELECT * FROM cells LEFT JOIN students USING (student_index) LEFT JOIN traits USING (trait_index))
SELECT student_index, trait, grp, round({z_sql('teacher_theta', 'trait, grp')}, 6) AS teacher_theta,
  round({z_sql('student_theta', 'trait, grp')}, 6) AS student_theta FROM j""")
def c20(st):
    traits = ordered.dictionary(st.nominations, "trait", "trait_index")
    out = scores.peer_teacher_alignment(fitted_cells(st), choice.index_roster(st.roster), traits)
    return rounded(out.select("student_index", "trait", "grp", "teacher_theta", "student_theta"),
                   "teacher_theta", "student_theta")


@query("c21_scores_by_income", f"""
SELECT trait, income, count(*) AS n, {", ".join(f'round({strict(c)}, 6) AS {c}' for c in ('theta', 'student_theta', 'teacher_theta', 'interview_score'))},
  CASE WHEN {strict('theta')} > {strict('interview_score')} THEN '1' WHEN NOT {strict('theta')} > {strict('interview_score')} THEN '2' END AS help_hurt
FROM person_scores LEFT JOIN people_clean ON demographics_id = person WHERE income_quintile IS NOT NULL GROUP BY ALL""")
def c21(st):
    values = ["theta", "student_theta", "teacher_theta", "interview_score"]
    return rounded(scores.scores_by_income(st.person_scores, people_clean(st), values), *values)


@query("c21_scaled_scores_by_income", f"""
WITH z AS (SELECT trait, income, {z_sql('theta', 'trait')} AS theta, {z_sql('interview_score', 'trait')} AS interview
  FROM person_scores LEFT JOIN people_clean ON demographics_id = person WHERE income IS NOT NULL)
SELECT income, trait, count(*) AS n, round({strict('interview')}, 6) AS interviews, round({strict('theta')}, 6) AS ground_truth,
  CASE WHEN {strict('interview')} > {strict('theta')} THEN 'Help' WHEN NOT {strict('interview')} > {strict('theta')} THEN 'Hurt' END AS interview_overestimate
FROM z GROUP BY ALL""")
def c21_scaled(st):
    out = scores.scaled_scores_by_income(st.person_scores, people_clean(st))
    return rounded(out, "interviews", "ground_truth")


CHOSEN = ["Intelligence", "Perseverance", "Empathy", "Boost"]
ITEM_SQL = """items AS (SELECT person, trait, trait || question_number AS item, avg(numeric_response) AS peer_review
  FROM likert_person WHERE numeric_response IS NOT NULL AND person IS NOT NULL GROUP BY ALL),
item_scores AS (SELECT i.*, grp, dense_rank() OVER (ORDER BY item) AS item_index FROM items i LEFT JOIN roster USING (person))"""


def items(st):
    return scores.item_scores(likert(st), st.tracker, st.roster)


@query("c22_selection_scores", f"""
WITH {ITEM_SQL}, sel AS (SELECT person, {strict('theta')} AS true_selection, {strict('interview_score')} AS interview_selection
  FROM person_scores WHERE trait IN ('Intelligence', 'Perseverance', 'Empathy', 'Boost') GROUP BY person),
z AS (SELECT person, {z_sql('peer_review', 'grp, item_index')} AS peer_review, true_selection, interview_selection
  FROM item_scores LEFT JOIN sel USING (person) WHERE item_index IN (2, 4, 8, 10))
SELECT person, round({strict('peer_review')}, 6) AS peer_review, round({strict('true_selection')}, 6) AS true_selection,
  round({strict('interview_selection')}, 6) AS interview_selection FROM z GROUP BY person""")
def c22(st):
    from scoreframe.functions.missing import strict_avg

    selected = scores.selection_scores(st.person_scores, CHOSEN)
    kept = joins.left_on(items(st).filter(F.col("item_index").isin(2, 4, 8, 10)), selected, ["person"])
    kept = grouped.zscore(kept, ["peer_review"], ["grp", "item_index"])
    return kept.groupBy("person").agg(*[
        F.round(strict_avg(c), 6).alias(c) for c in ("peer_review", "true_selection", "interview_selection")])


@query("c23_items_beside_reference", f"""
WITH {ITEM_SQL}, z AS (SELECT i.person, i.trait, theta, interview_score, {z_sql('peer_review', 'i.grp, item_index')} AS peer_review
  FROM item_scores i LEFT JOIN person_scores p ON p.person = i.person AND p.trait = i.trait WHERE item_index IN (2, 4, 8, 10, 13))
SELECT person, trait, round({strict('peer_review')}, 6) AS peer_review, round({strict('theta')}, 6) AS theta,
  round({strict('interview_score')}, 6) AS interview FROM z GROUP BY ALL""")
def c23(st):
    out = scores.item_scores_beside_reference(items(st), st.person_scores, [2, 4, 8, 10, 13])
    return rounded(out, "peer_review", "theta", "interview")


@query("c24_weighted_peer_scores", """
WITH c AS (SELECT *, numeric_response - avg(numeric_response) OVER (PARTITION BY name, trait) AS c FROM likert),
e AS (SELECT *, 1 / nullif(stddev_samp(c) OVER (PARTITION BY question_text), 0) AS w FROM c)
SELECT uid2, trait, CASE WHEN count(c * w) = count(*) THEN round(sum(c * w) / sum(w), 6) END AS simple_score FROM e GROUP BY ALL""")
def c24(st):
    return rounded(scores.weighted_peer_scores(likert(st)), "simple_score")


MEANS_SQL = f"""means AS (SELECT uid2, question_number, l.trait, s.grp, {strict('scaled_numeric')} AS scaled_numeric,
    {strict('s.interview_score')} AS interview_score, {strict('s.theta')} AS theta,
    {", ".join(f"first({a} ORDER BY pos) AS {a}" for a in scores.ATTRIBUTES)}
  FROM likert_person l LEFT JOIN person_scores s ON s.person = l.person AND s.trait = l.trait
  LEFT JOIN people_clean p ON p.demographics_id = l.person GROUP BY uid2, question_number, l.trait, s.grp
  HAVING scaled_numeric IS NOT NULL AND interview_score IS NOT NULL AND theta IS NOT NULL AND s.grp IS NOT NULL
    AND {" AND ".join(f"{a} IS NOT NULL" for a in scores.ATTRIBUTES)})"""


def means_of_questions(st):
    return scores.question_means(likert(st), st.tracker, st.person_scores, people_clean(st))


@query("c25_question_predictors", f"""
WITH {MEANS_SQL}, w AS (SELECT uid2, trait, grp, theta, interview_score, {", ".join(scores.ATTRIBUTES)},
  {", ".join(f"max(scaled_numeric) FILTER (WHERE question_number = '{q}') AS {q}" for q in ("Q1", "Q2", "Q3", "Q4"))}
  FROM means GROUP BY ALL)
SELECT uid2, trait, grp, theta, interview_score, {", ".join(a for a in scores.ATTRIBUTES if a != 'age')}, round(age, 6) AS age,
  {", ".join(f"{q} IS NULL AS missing_{q.lower()}, round(coalesce({q}, -5), 6) AS {q}" for q in ("Q1", "Q2", "Q3", "Q4"))} FROM w""")
def c25(st):
    questions = ["Q1", "Q2", "Q3", "Q4"]
    return rounded(scores.question_predictors(means_of_questions(st), questions), "age", *questions)


@query("c26_boost_against_others", """
SELECT person, trait, grp, theta, max(CASE WHEN trait = 'Boost' THEN theta END) OVER (PARTITION BY person) AS compared
FROM person_scores QUALIFY trait <> 'Boost'""")
def c26(st):
    return scores.trait_against_others(st.person_scores.select("person", "trait", "grp", "theta"), "Boost", "theta")


@query("c26_boost_spike_wide", """
SELECT person, max(theta) FILTER (WHERE trait = 'Boost') AS "Boost", max(theta) FILTER (WHERE trait = 'Spike') AS "Spike"
FROM person_scores GROUP BY person""")
def c26_wide(st):
    first = grouped.first_rows(st.person_scores, ["person", "trait"], ["grp", "theta"])
    return reshape.to_wide(first, ["person"], "trait", "theta", ["Boost", "Spike"])


@query("c28_teacher_peer_panel", f"""
WITH {TEACHER_COUNTS_SQL}, z AS (SELECT trait, name, teacher_score, {z_sql('n', 'trait, grp')} AS peer_score FROM tn),
u AS (SELECT * FROM z UNPIVOT INCLUDE NULLS (score FOR type IN (teacher_score, peer_score)))
SELECT trait, name, type, round(score, 6) AS score, round(CASE WHEN count(score) OVER w = count(*) OVER w THEN avg(score) OVER w END, 6) AS mean_score
FROM u WINDOW w AS (PARTITION BY trait, name)""")
def c28(st):
    return rounded(scores.teacher_peer_panel(teacher_long(st), noms_count(st)), "score", "mean_score")


@query("c29_evidence_panel", f"""
WITH {TEACHER_COUNTS_SQL}, m AS (SELECT name AS student, student_id, trait, teacher_score, {z_sql('n', 'trait')} AS peer_score, grp FROM tn),
j AS (SELECT i.interviewer, i.trait, m.student, m.teacher_score, m.peer_score, {z_sql('score', 'i.trait, m.grp')} AS interviewer_score
  FROM interviews_long i LEFT JOIN m ON m.student_id = i.student_id AND m.trait = i.trait),
u AS (SELECT * FROM j UNPIVOT INCLUDE NULLS (value FOR type IN (interviewer_score, teacher_score, peer_score))),
f AS (SELECT u.* FROM (SELECT *, teacher_score IS NULL AS no_teacher FROM j) j2, LATERAL (
  SELECT j2.interviewer, j2.trait, j2.student, v.type, v.value FROM (VALUES ('interviewer_score', j2.interviewer_score),
    ('teacher_score', j2.teacher_score), ('peer_score', j2.peer_score)) v(type, value)) u WHERE NOT no_teacher),
k AS (SELECT * FROM f QUALIFY type = 'interviewer_score' OR
  row_number() OVER (PARTITION BY trait, type, student ORDER BY interviewer, value) = 1)
SELECT trait, student, type, CASE WHEN type = 'interviewer_score' THEN 'Interview' ELSE 'Ground Truth' END AS evidence_type,
  round(value, 6) AS value, count(*) AS n FROM k GROUP BY ALL""")
def c29(st):
    out = scores.evidence_counts(interviews_long(st), teacher_long(st), noms_count(st))
    return rounded(out, "value").groupBy("trait", "student", "type", "evidence_type", "value").agg(F.sum("n").alias("n"))


@query("c30_candidate_summary", f"""
WITH {TEACHER_COUNTS_SQL}, m AS (SELECT student_id, trait, teacher_score, {z_sql('n', 'trait')} AS peer_score FROM tn),
a AS (SELECT student_id, trait, {strict('score')} AS interview_average FROM interviews_long GROUP BY ALL),
j AS (SELECT a.*, m.teacher_score, m.peer_score FROM a LEFT JOIN m ON m.student_id = a.student_id AND m.trait = a.trait)
SELECT student_id, trait, round(interview_average, 6) AS interview_average, round(teacher_score, 6) AS teacher_score,
  round(peer_score, 6) AS peer_score, round({z_sql('peer_score + teacher_score', 'trait')}, 6) AS ground_truth FROM j""")
def c30(st):
    out = scores.candidate_summary(interviews_long(st), teacher_long(st), noms_count(st))
    return rounded(out, "interview_average", "teacher_score", "peer_score", "ground_truth")


@query("c31_interviewer_agreement", f"""
WITH z AS (SELECT student_id, trait, {z_sql('score', 'interviewer')} AS z FROM interviews_long WHERE score IS NOT NULL),
m AS (SELECT trait, z, CASE WHEN count(z) OVER w = count(*) OVER w THEN avg(z) OVER w END AS mean_z
  FROM z WINDOW w AS (PARTITION BY trait, student_id))
SELECT trait, round(stddev_samp(mean_z), 6) AS sd_people, round(stddev_samp(z - mean_z), 6) AS sd_noise,
  round(stddev_samp(mean_z) / nullif(stddev_samp(z - mean_z), 0), 6) AS signal_to_noise FROM m GROUP BY trait""")
def c31(st):
    out = grouped.signal_to_noise(interviews_long(st), "score", "interviewer", "student_id", "trait")
    return rounded(out, "sd_people", "sd_noise", "signal_to_noise")


@query("c32_posterior_summary", """
SELECT CAST(regexp_extract(variable, '\\[([0-9]+),([0-9]+)\\]', 1) AS INT) AS i,
  CAST(regexp_extract(variable, '\\[([0-9]+),([0-9]+)\\]', 2) AS INT) AS c,
  round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(median(value), 6) AS median,
  round(quantile_cont(value, 0.05), 6) AS q5, round(quantile_cont(value, 0.95), 6) AS q95,
  round(quantile_cont(value, 0.95) - quantile_cont(value, 0.05), 6) AS width FROM draws GROUP BY variable""")
def c32(st):
    from scoreframe.functions.text import cell_index

    cells = st.draws.select(cell_index("variable", 1).alias("i"), cell_index("variable", 2).alias("c"), "value")
    out = scores.posterior_summary(cells, ["i", "c"], "value")
    return rounded(out, "mean", "sd", "median", "q5", "q95", "width")


@query("c33_reviewee_coverage", "SELECT uid2, count(DISTINCT name) AS n FROM likert WHERE numeric_response IS NOT NULL GROUP BY uid2")
def c33(st):
    known = likert(st).filter("numeric_response IS NOT NULL")
    return known.groupBy("uid2").agg(F.count_distinct("name").alias("n"))


@query("c34_keyed_scores", f"""
WITH {CELL_SQL}, ids AS (SELECT s.*, lower(t."Student ID") AS student_id FROM students s LEFT JOIN tracker t USING (person)),
a AS (SELECT DISTINCT ON (student_id) student_id, interviewability, standardized_test FROM teacher_long ORDER BY student_id, trait)
SELECT student_index, trait, grp, student_id, round(teacher_theta, 6) AS theta, round(interviewability, 6) AS interviewability,
  round(standardized_test, 6) AS standardized_test
FROM cells LEFT JOIN ids USING (student_index) LEFT JOIN traits USING (trait_index) LEFT JOIN a USING (student_id)""")
def c34(st):
    ids = st.tracker.select("person", F.lower("Student ID").alias("student_id"))
    students = joins.left_on(choice.index_roster(st.roster), ids, ["person"])
    traits = ordered.dictionary(st.nominations, "trait", "trait_index")
    academics = teacher_long(st).select("student_id", "trait", "interviewability", "standardized_test")
    out = scores.keyed_scores(fitted_cells(st), students, traits, academics)
    out = out.select("student_index", "trait", "grp", "student_id", F.col("teacher_theta").alias("theta"),
                     "interviewability", "standardized_test")
    return rounded(out, "theta", "interviewability", "standardized_test")


def base_sql(condition: str) -> str:
    return f"""
SELECT person, s.grp, trait, theta, interview_score, gender, school_type, income_quintile, esl
FROM person_scores s LEFT JOIN people_clean ON demographics_id = person
WHERE person IN (SELECT nominee FROM nominations) AND {condition}"""


def analysis_base(st, complete: bool):
    seen = st.nominations.select(F.col("nominee").alias("person"))
    kept = joins.keep_known(st.person_scores, seen, ["person"])
    people = people_clean(st).select("demographics_id", "gender", "school_type", "income_quintile", "esl")
    out = joins.left_on(kept, people, [("person", "demographics_id")])
    out = out.select("person", "grp", "trait", "theta", "interview_score", "gender", "school_type",
                     "income_quintile", "esl")
    return out.dropna("any") if complete else out.dropna(subset=["theta", "interview_score"])


@query("c35_analysis_base_complete", base_sql(
    "theta IS NOT NULL AND interview_score IS NOT NULL AND gender IS NOT NULL AND income_quintile IS NOT NULL"))
def c35(st):
    return analysis_base(st, True)


@query("c35_analysis_base_lenient", base_sql("theta IS NOT NULL AND interview_score IS NOT NULL"))
def c35_lenient(st):
    return analysis_base(st, False)


QUESTIONS = {"Spike": ["Q1", "Q2"], "Integrity": ["Q2", "Q4"], "Intelligence": ["Q2"]}
RELEVANT_SQL = """((trait = 'Spike' AND question_number IN ('Q1', 'Q2')) OR (trait = 'Integrity' AND question_number IN ('Q2', 'Q4'))
  OR (trait = 'Intelligence' AND question_number = 'Q2'))"""


@query("c36_simple_peer_scores_mean", f"""
WITH {MEANS_SQL} SELECT trait, uid2, grp, round(avg(theta), 6) AS theta, round(avg(scaled_numeric), 6) AS prediction
FROM means WHERE {RELEVANT_SQL} GROUP BY ALL""")
def c36(st):
    out = scores.simple_peer_scores(means_of_questions(st), scores.relevant_question(QUESTIONS))
    return rounded(out, "theta", "prediction")


@query("c36_simple_peer_scores_median", f"""
WITH {MEANS_SQL} SELECT trait, uid2, grp, round(median(theta), 6) AS theta,
  round(median(CASE WHEN {RELEVANT_SQL} THEN scaled_numeric END), 6) AS prediction FROM means GROUP BY ALL""")
def c36_median(st):
    out = scores.simple_peer_scores(means_of_questions(st), scores.relevant_question(QUESTIONS), "median")
    return rounded(out, "theta", "prediction")
