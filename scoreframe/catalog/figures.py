"""The table behind each figure."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreframe.catalog import checks as ck
from scoreframe.catalog import query
from scoreframe.catalog.fits import (FACTORS, INTERACTION_SQL, interaction_fit, mixed_fit, mixed_sql,
                                     score_matrix)
from scoreframe.catalog.jobs import people_clean
from scoreframe.catalog.jobs_scores import rounded
from scoreframe.functions.missing import correlation
from scoreframe.functions.text import TRAITS, cell_index
from scoreframe.operators import covariance, grouped, joins, mixed, ordered
from scoreframe.operators.lines import fit_lines
from scoreframe.plans import forms, scores
from scoreframe.plans.study import STEPS as FUNNEL_STEPS

strict = ck.strict_avg_sql


@query("v1_points_and_line", """
SELECT p.person, p.trait, p.interview_score AS x, p.theta AS y, round(l.a + l.b * p.interview_score, 6) AS on_line
FROM person_scores p LEFT JOIN (SELECT trait, regr_slope(theta, interview_score) AS b, regr_intercept(theta, interview_score) AS a
  FROM person_scores GROUP BY trait) l USING (trait)""")
def v1(st):
    lines = fit_lines(st.person_scores, "interview_score", "theta", ["trait"])
    points = joins.left_on(st.person_scores, lines, ["trait"])
    on_line = F.col("intercept") + F.col("slope") * F.col("interview_score")
    return points.select("person", "trait", F.col("interview_score").alias("x"), F.col("theta").alias("y"),
                         F.round(on_line, 6).alias("on_line"))


@query("v2_five_numbers", """
SELECT grp, trait, min(qty)::DOUBLE AS p0, quantile_cont(qty, 0.25) AS p25, quantile_cont(qty, 0.5) AS p50,
  quantile_cont(qty, 0.75) AS p75, max(qty)::DOUBLE AS p100 FROM ratings GROUP BY ALL""")
def v2(st):
    return ordered.group_quantiles(st.ratings.withColumn("qty", F.col("qty").cast("double")), ["grp", "trait"], "qty",
                                   {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0})


@query("v3_histogram", """
SELECT grp, trait, CAST(CASE WHEN qty < 1 THEN 0 WHEN qty >= 51 THEN 11 ELSE floor((qty - 1) / 5.0) + 1 END AS BIGINT) AS bin, count(*) AS n
FROM ratings GROUP BY ALL""")
def v3(st):
    bin_of = F.width_bucket(F.col("qty").cast("double"), F.lit(1.0), F.lit(51.0), F.lit(10))
    return st.ratings.groupBy("grp", "trait", bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("v4_pairs_plot", """
SELECT a.trait AS trait_i, b.trait AS trait_j, round(corr(a.theta, b.theta), 6) AS r
FROM person_scores a JOIN person_scores b ON a.person = b.person AND a.trait <= b.trait GROUP BY ALL""")
def v4(st):
    return rounded(covariance.pair_statistics(score_matrix(st), TRAITS, [], correlation, "r"), "r")


@query("v5_variance_curve")
def v5(st):
    """Cumulative share of variance per anonymous class, in percent."""
    pairs = covariance.pair_statistics(score_matrix(st), TRAITS, ["grp"])
    curve = covariance.variance_explained(pairs, TRAITS, ["grp"])
    coded = joins.left_on(curve, ordered.dictionary(st.roster, "grp", "number"), ["grp"])
    label = F.concat(F.lit("Class "), F.col("number").cast("string"))
    return coded.select(label.alias("school"), "component", (F.col("cum_share") * 100).alias("percent"))


@query("v6_quintile_gaps", f"""
SELECT trait, income, count(*) AS n, round({strict('theta')}, 6) AS y, round({strict('interview_score')}, 6) AS y_end
FROM person_scores LEFT JOIN people_clean ON demographics_id = person WHERE income_quintile IS NOT NULL GROUP BY ALL
HAVING {strict('theta')} BETWEEN 2 AND 15 AND {strict('interview_score')} BETWEEN 2 AND 15""")
def v6(st):
    means = scores.scores_by_income(st.person_scores, people_clean(st), ["theta", "interview_score"])
    inside = means.filter("theta BETWEEN 2 AND 15 AND interview_score BETWEEN 2 AND 15")
    return inside.select("trait", "income", "n", F.round("theta", 6).alias("y"),
                         F.round("interview_score", 6).alias("y_end"))


@query("v7_step_bars", f"""
SELECT step, coalesce(CASE WHEN count(done) = count(*) THEN CAST(sum(CAST(done AS INT)) AS BIGINT) END, 0) AS bar
FROM progress UNPIVOT INCLUDE NULLS (done FOR step IN ({ck.quoted(FUNNEL_STEPS)})) GROUP BY step""")
def v7(st):
    funnel = forms.completion_funnel(st.progress, FUNNEL_STEPS)
    return funnel.select("step", F.coalesce("n_completed", F.lit(0)).alias("bar")).orderBy("step")


@query("v8_uncertainty", """
SELECT grp, CAST(regexp_extract(variable, ',([0-9]+)', 1) AS INT) AS concept, round(median(value), 6) AS median,
  round(quantile_cont(value, 0.95) - quantile_cont(value, 0.05), 6) AS width
FROM draws JOIN roster ON person = CAST(regexp_extract(variable, '\\[([0-9]+),', 1) AS INT) - 1 GROUP BY grp, person, variable""")
def v8(st):
    cells = st.draws.select(cell_index("variable", 1).alias("i"), cell_index("variable", 2).alias("c"), "value")
    summary = scores.posterior_summary(cells, ["i", "c"], "value")
    named = joins.left_on(summary.withColumn("person", (F.col("i") - 1).cast("bigint")), st.roster, ["person"])
    return rounded(named.select("grp", F.col("c").alias("concept"), "median", "width"), "median", "width")


@query("v9_effects_in_order", mixed_sql("""
SELECT rater, n, round(effect, 5) AS effect, round(1.96 * sqrt(noise / (n + noise / var_rater)), 5) AS half_width FROM effects
JOIN (SELECT DISTINCT rater, k0 AS id FROM cells) USING (id) CROSS JOIN spread"""))
def v9(st):
    _, fit = mixed_fit(st)
    return mixed.effect_table(fit, "rater").withColumns({c: F.round(c, 5) for c in ("effect", "half_width")})


@query("v10_observed_and_fitted", mixed_sql("""
SELECT rater, ratee, trait, score, round(a + b * tax + x.effect + y.effect + z.effect, 4) AS fitted
FROM cells CROSS JOIN beta JOIN effects x ON x.id = k0 JOIN effects y ON y.id = k1 JOIN effects z ON z.id = k2"""))
def v10(st):
    rows, fit = mixed_fit(st)
    out = mixed.fitted_values(rows, fit, "score", FACTORS)
    return out.select("rater", "ratee", "trait", "score", F.round("fitted", 4).alias("fitted"))


@query("v11_coefficients_in_order", f"""
WITH {INTERACTION_SQL} SELECT term, round(estimate, 6) AS estimate FROM terms WHERE term LIKE '%tax%' ORDER BY estimate DESC""")
def v11(st):
    return rounded(interaction_fit(st).filter(F.col("term").contains("tax")), "estimate").orderBy(F.desc("estimate"))
