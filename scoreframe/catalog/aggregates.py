"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreframe.catalog import query
from scoreframe.catalog.rows import RELEVANT_SQL, relevant_pair
from scoreframe.functions import missing
from scoreframe.functions.text import TRAITS
from scoreframe.operators import grouped, ordered, reshape
from scoreframe.operators.choice import choice_sets, slice_bounds
from scoreframe.operators.covariance import pair_statistics

ROW_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "rater", "qty"]


@query("a1_count_per_group", "SELECT grp, trait, count(*) AS n FROM ratings GROUP BY ALL")
def a1(st):
    return st.ratings.groupBy("grp", "trait").agg(F.count(F.lit(1)).alias("n"))


@query("a2_strict_aggregates", """
SELECT ratee, trait, l_linenumber, CASE WHEN count(score) = count(*) THEN round(avg(score), 6) END AS avg_score,
  CASE WHEN count(score) = count(*) THEN max(score) END AS max_score,
  CASE WHEN count(score) = count(*) THEN min(score) END AS min_score,
  CASE WHEN count(score) = count(*) THEN sum(score) END AS sum_score
FROM ratings GROUP BY ALL""")
def a2(st):
    return st.ratings.groupBy("ratee", "trait", "l_linenumber").agg(
        F.round(missing.strict_avg("score"), 6).alias("avg_score"), missing.strict_max("score").alias("max_score"),
        missing.strict_min("score").alias("min_score"), missing.strict_sum("score").alias("sum_score"))


@query("a3_lenient_mean", "SELECT rater, round(avg(score), 6) AS avg_score FROM ratings GROUP BY rater")
def a3(st):
    return st.ratings.groupBy("rater").agg(F.round(F.avg("score"), 6).alias("avg_score"))


@query("a4_first_value", """
SELECT ratee, first(trait ORDER BY l_shipdate, l_orderkey, l_linenumber, rater, qty) AS trait,
  first(score ORDER BY l_shipdate, l_orderkey, l_linenumber, rater, qty) AS score FROM ratings GROUP BY ratee""")
def a4(st):
    return st.ratings.groupBy("ratee").agg(
        grouped.first_value("trait", ROW_ORDER).alias("trait"),
        grouped.first_value("score", ROW_ORDER).alias("score"))


@query("a5_first_present", """
SELECT rater, first(score ORDER BY l_shipdate, l_orderkey, l_linenumber, rater, qty)
  FILTER (WHERE score IS NOT NULL) AS score FROM ratings GROUP BY rater""")
def a5(st):
    return st.ratings.groupBy("rater").agg(grouped.first_present("score", ROW_ORDER).alias("score"))


@query("a6_strict_median", """
SELECT rater, CASE WHEN count(score) = count(*) THEN median(score) END AS mid FROM ratings GROUP BY rater""")
def a6(st):
    return ordered.group_median(st.ratings, ["rater"], "score", "mid")


@query("a7_filtered_aggregate", f"""
SELECT ratee, round(avg(score) FILTER (WHERE {RELEVANT_SQL}), 6) AS avg_relevant, count(*) AS n
FROM ratings GROUP BY ratee""")
def a7(st):
    return st.ratings.groupBy("ratee").agg(
        F.round(F.avg(F.when(relevant_pair(), F.col("score"))), 6).alias("avg_relevant"),
        F.count(F.lit(1)).alias("n"))


@query("a8_distinct_with_missing", """
SELECT rater, count(DISTINCT score) + max(CASE WHEN score IS NULL THEN 1 ELSE 0 END) AS n_values
FROM ratings GROUP BY rater""")
def a8(st):
    return st.ratings.groupBy("rater").agg(missing.distinct_with_missing("score").alias("n_values"))


@query("a9_count_matches", """
SELECT event_id, CASE WHEN count(answer) = count(*) THEN CAST(sum(CASE WHEN answer = correct THEN 1 ELSE 0 END) AS BIGINT) END AS score
FROM (SELECT event_id, item, answer FROM quiz_form UNPIVOT INCLUDE NULLS (answer FOR item IN ("Item 4", "Item 5", "Item 6", "Item 7")))
JOIN quiz_key ON question_number = CAST(substr(item, 6, 1) AS INT) - 3 GROUP BY event_id""")
def a9(st):
    long = reshape.to_long(st.quiz_form.select("event_id", "Item 4", "Item 5", "Item 6", "Item 7"),
                           ["Item 4", "Item 5", "Item 6", "Item 7"], "item", "answer", "pos")
    marked = long.join(st.quiz_key, F.col("pos") == F.col("question_number"))
    return marked.groupBy("event_id").agg(
        missing.count_matches(F.col("answer") == F.col("correct")).alias("score"))


@query("a10_sample_sd", "SELECT grp, trait, round(stddev_samp(score), 6) AS sd FROM ratings GROUP BY ALL")
def a10(st):
    return st.ratings.groupBy("grp", "trait").agg(F.round(F.stddev_samp("score"), 6).alias("sd"))


@query("a11_weighted_mean", """
SELECT grp, trait, round(sum(score * (1 + tax)) / sum(1 + tax), 6) AS w_avg FROM ratings WHERE score IS NOT NULL GROUP BY ALL""")
def a11(st):
    known = st.ratings.filter("score IS NOT NULL")
    return known.groupBy("grp", "trait").agg(
        F.round(missing.weighted_avg("score", 1 + F.col("tax")), 6).alias("w_avg"))


@query("a12_range_in_group", """
SELECT rater, trait, score, CASE WHEN count(score) OVER w = count(*) OVER w THEN max(score) OVER w - min(score) OVER w END AS range
FROM ratings WINDOW w AS (PARTITION BY rater, trait)""")
def a12(st):
    return grouped.spread_within(st.ratings.select("rater", "trait", "score"), "score", ["rater", "trait"], "range")


@query("a13_row_sums", """
SELECT "Student ID", "Boost" + "Empathy" + "Integrity" + "Intelligence" + "Perseverance" + "Spike" AS total FROM teacher_form""")
def a13(st):
    return st.teacher_form.select("Student ID", missing.add_all(TRAITS).alias("total"))


@query("a14_null_fractions", """
SELECT round(avg(CASE WHEN school IS NULL THEN 1.0 ELSE 0 END), 6) AS school,
  round(avg(CASE WHEN gender IS NULL THEN 1.0 ELSE 0 END), 6) AS gender,
  round(avg(CASE WHEN quintile IS NULL THEN 1.0 ELSE 0 END), 6) AS quintile,
  round(avg(CASE WHEN balance IS NULL THEN 1.0 ELSE 0 END), 6) AS balance FROM demographic_form""")
def a14(st):
    shares = grouped.null_fractions(st.demographic_form.select("school", "gender", "quintile", "balance"))
    return shares.select(*[F.round(c, 6).alias(c) for c in shares.columns])


@query("a15_dimension_sizes", """
SELECT count(*) AS n, count(DISTINCT rater) AS n_raters, count(DISTINCT ratee) AS n_ratees,
  count(DISTINCT trait) AS n_traits, CAST(max(score) AS BIGINT) AS top_mark FROM ratings WHERE score IS NOT NULL""")
def a15(st):
    known = ordered.encode(st.ratings.filter("score IS NOT NULL"), "rater", "reviewer")
    known = ordered.encode(ordered.encode(known, "ratee", "reviewee"), "trait", "concept")
    return known.agg(
        F.count(F.lit(1)).alias("n"), F.max("reviewer").alias("n_raters"), F.max("reviewee").alias("n_ratees"),
        F.max("concept").alias("n_traits"), F.max("score").cast("bigint").alias("top_mark"))


CHOICE_SQL = """picks AS (SELECT * FROM nominations
  QUALIFY row_number() OVER (PARTITION BY nominator, trait, rank ORDER BY l_shipdate, l_orderkey, nominee) = 1),
firsts AS (SELECT nominator, trait, max(nominee) FILTER (WHERE rank = 1) AS p1, max(nominee) FILTER (WHERE rank = 2) AS p2
  FROM picks GROUP BY ALL),
members AS (SELECT p.nominator, p.trait, p.rank, p.grp, p.nominee, r.person FROM picks p
  JOIN firsts USING (nominator, trait) JOIN roster r ON r.grp = p.grp
  WHERE rank = 1 OR (rank = 2 AND (p1 IS NULL OR person <> p1))
     OR (rank = 3 AND (p1 IS NULL OR person <> p1) AND (p2 IS NULL OR person <> p2)))"""


@query("a16_slice_bounds", f"""
WITH {CHOICE_SQL}, flat AS (SELECT *, row_number() OVER (ORDER BY nominator, trait, rank, person) AS row FROM members)
SELECT nominator, trait, rank, min(row) AS possibles_lower, max(row) AS possibles_upper FROM flat GROUP BY ALL""")
def a16(st):
    sets = choice_sets(st.nominations, st.roster, ["l_shipdate", "l_orderkey", "nominee"])
    return slice_bounds(sets).select("nominator", "trait", "rank", "possibles_lower", "possibles_upper")


@query("a17_share_of_total", """
SELECT nominee, trait, grp, round(n / sum(n) OVER (PARTITION BY grp, trait), 6) AS part FROM (
  SELECT nominee, trait, grp, count(*) AS n FROM nominations GROUP BY ALL)""")
def a17(st):
    counts = st.nominations.groupBy("nominee", "trait", "grp").agg(F.count(F.lit(1)).alias("n"))
    out = grouped.share(counts, "n", ["grp", "trait"], "part")
    return out.select("nominee", "trait", "grp", F.round("part", 6).alias("part"))


@query("a18_covariance", """
SELECT a.grp, a.trait AS trait_i, b.trait AS trait_j, round(covar_samp(a.theta, b.theta), 6) AS value
FROM person_scores a JOIN person_scores b ON a.person = b.person AND a.trait <= b.trait GROUP BY ALL""")
def a18(st):
    wide = reshape.to_wide(st.person_scores, ["person", "grp"], "trait", "theta", TRAITS)
    cells = pair_statistics(wide, TRAITS, ["grp"])
    return cells.withColumn("value", F.round("value", 6))


@query("a19_distinct_keys", "SELECT DISTINCT trait FROM nominations")
def a19(st):
    return st.nominations.select("trait").distinct()
