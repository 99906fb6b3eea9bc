"""Scaling within groups, runs, buckets, cumulative shares, codes, sorting, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreframe.catalog import query
from scoreframe.operators import grouped, ordered
from scoreframe.sources.scan import unite


def z_sql(value: str, by: str) -> str:
    """Checking SQL for a z-score within groups."""
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    return f"(({value}) - avg({value}) {over}) / nullif(stddev_samp({value}) {over}, 0)"


@query("x1_zscore_by_rater", f"""
SELECT rater, ratee, trait, score, round({z_sql('score', 'rater')}, 6) AS z FROM ratings""")
def x1(st):
    out = grouped.zscore(st.ratings.select("rater", "ratee", "trait", "score"), {"score": "z"}, ["rater"])
    return out.withColumn("z", F.round("z", 6))


@query("x1_zscore_by_group_trait", f"""
SELECT person, grp, trait, round({z_sql('theta', 'grp, trait')}, 6) AS theta,
  round({z_sql('interview_score', 'grp, trait')}, 6) AS interview_score FROM person_scores""")
def x1_pair(st):
    out = grouped.zscore(st.person_scores.select("person", "grp", "trait", "theta", "interview_score"),
                         ["theta", "interview_score"], ["grp", "trait"])
    return out.withColumns({c: F.round(c, 6) for c in ("theta", "interview_score")})


@query("x2_centre", """
SELECT rater, trait, score, round(score - avg(score) OVER (PARTITION BY rater, trait), 6) AS centred FROM ratings""")
def x2(st):
    out = grouped.centre(st.ratings.select("rater", "trait", "score"), "score", ["rater", "trait"], "centred")
    return out.withColumn("centred", F.round("centred", 6))


@query("x3_group_value_on_rows", """
SELECT rater, ratee, count(*) OVER (PARTITION BY ratee, trait) AS n,
  round(avg(score) OVER (PARTITION BY ratee, trait), 6) AS mean_score FROM ratings""")
def x3(st):
    out = grouped.attach(st.ratings, ["ratee", "trait"], n=F.count(F.lit(1)), mean_score=F.round(F.avg("score"), 6))
    return out.select("rater", "ratee", "n", "mean_score")


@query("x4_value_of_one_trait", """
SELECT person, trait, theta, max(CASE WHEN trait = 'Boost' THEN theta END) OVER (PARTITION BY person) AS boost
FROM person_scores""")
def x4(st):
    out = grouped.value_where(st.person_scores.select("person", "trait", "theta"), "theta",
                              F.col("trait") == "Boost", ["person"], "boost")
    return out


@query("x4_not_exactly_one", """
SELECT nominator, trait, CAST(sum(CASE WHEN rank = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_matches
FROM nominations GROUP BY ALL HAVING sum(CASE WHEN rank = 1 THEN 1 ELSE 0 END) <> 1""")
def x4_check(st):
    return grouped.violations_of_one_match(st.nominations, F.col("rank") == 1, ["nominator", "trait"])


@query("x5_run_id", """
WITH r AS (SELECT name, form, pos, nullif(regexp_extract(question, 'UID: [0-9]{4}'), '') AS uid FROM review_rows),
f AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND uid IS DISTINCT FROM lag(uid) OVER w THEN 1 ELSE 0 END AS changed
  FROM r WINDOW w AS (PARTITION BY name, form ORDER BY pos))
SELECT name, form, pos, CAST(sum(changed) OVER (PARTITION BY name, form ORDER BY pos) AS BIGINT) AS run FROM f""")
def x5(st):
    from scoreframe.functions.text import extract

    rows = st.review_rows.select("name", "form", "pos", extract("question", "UID: [0-9]{4}").alias("uid"))
    return ordered.run_id(rows, ["name", "form"], ["pos"], "uid", "run").drop("uid")


@query("x6_percentile_bucket", """
WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE floor(c_acctbal / 500) END AS score FROM customer)
SELECT c_custkey, CAST(ntile(100) OVER (ORDER BY score, c_custkey) AS INT) AS percentile FROM s WHERE score IS NOT NULL
UNION ALL SELECT c_custkey, NULL FROM s WHERE score IS NULL""")
def x6(st):
    scored = st.table("customer").select(
        "c_custkey", F.expr("CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE floor(c_acctbal / 500) END").alias("score"))
    return ordered.bucket(scored, "score", 100, ["c_custkey"], "percentile").drop("score")


@query("x7_cumulative_share", """
SELECT nominee, grp, n, round(sum(n) OVER (PARTITION BY grp ORDER BY n DESC, nominee) / sum(n) OVER (PARTITION BY grp), 6) AS cum_share
FROM (SELECT nominee, grp, count(*) AS n FROM nominations GROUP BY ALL)""")
def x7(st):
    counts = st.nominations.groupBy("nominee", "grp").agg(F.count(F.lit(1)).alias("n"))
    out = ordered.running_share(counts, ["grp"], [F.desc("n"), "nominee"], "n", "cum_share")
    return out.withColumn("cum_share", F.round("cum_share", 6))


RANKED_SQL = "SELECT name, form, pos FROM review_rows WHERE question = 'Rank the videos'"


@query("x8_positional_score", f"""
SELECT name, form, pos, 7 - row_number() OVER (PARTITION BY form, name ORDER BY pos) AS score FROM ({RANKED_SQL})""")
def x8(st):
    ranked = st.review_rows.filter("question = 'Rank the videos'").select("name", "form", "pos")
    return ordered.positional_score(ranked, ["form", "name"], ["pos"], 6, "score")


@query("x8_groups_of_wrong_size", f"""
SELECT form, name, count(*) AS n FROM ({RANKED_SQL}) GROUP BY ALL HAVING count(*) <> 6""")
def x8_check(st):
    ranked = st.review_rows.filter("question = 'Rank the videos'")
    return ordered.groups_not_of_size(ranked, ["form", "name"], 6)


@query("x9_order_by_group_mean", """
WITH m AS (SELECT rater, trait, avg(score) AS m FROM ratings GROUP BY ALL)
SELECT rater, trait, round(m, 6) AS mean_value, row_number() OVER (ORDER BY m NULLS LAST, rater, trait) AS place FROM m""")
def x9(st):
    out = ordered.order_by_group_mean(st.ratings, ["rater", "trait"], "score", "place")
    return out.withColumn("mean_value", F.round("mean_value", 6))


@query("x10_dense_code", """
SELECT id, school, CASE WHEN school IS NOT NULL THEN dense_rank() OVER (ORDER BY school NULLS LAST) END AS code
FROM demographic_form""")
def x10(st):
    return ordered.encode(st.demographic_form.select("id", "school"), "school", "code")


@query("x11_sort", """
SELECT name, form, pos FROM review_rows ORDER BY name, form, pos""")
def x11(st):
    keys = [F.col(c).asc_nulls_last() for c in ("name", "form", "pos")]
    return st.review_rows.select("name", "form", "pos").orderBy(*keys)


@query("x12_signal_to_noise", f"""
WITH z AS (SELECT ratee, trait, {z_sql('score', 'rater')} AS z FROM ratings WHERE score IS NOT NULL),
m AS (SELECT trait, z, CASE WHEN count(z) OVER w = count(*) OVER w THEN avg(z) OVER w END AS mean_z
  FROM z WINDOW w AS (PARTITION BY trait, ratee))
SELECT trait, round(stddev_samp(mean_z), 6) AS sd_people, round(stddev_samp(z - mean_z), 6) AS sd_noise,
  round(stddev_samp(mean_z) / nullif(stddev_samp(z - mean_z), 0), 6) AS signal_to_noise FROM m GROUP BY trait""")
def x12(st):
    out = grouped.signal_to_noise(st.ratings, "score", "rater", "ratee", "trait")
    return out.select("trait", *[F.round(c, 6).alias(c) for c in ("sd_people", "sd_noise", "signal_to_noise")])


@query("x13_union_by_name", """
SELECT 'R' AS tag, l_orderkey AS key, NULL AS price FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'order', o_orderkey, o_totalprice FROM orders
UNION ALL SELECT 'A', l_orderkey, NULL FROM lineitem WHERE l_returnflag = 'A'
UNION ALL SELECT 'N', l_orderkey, NULL FROM lineitem WHERE l_returnflag = 'N'""")
def x13(st):
    lines = st.table("lineitem")
    parts = [
        lines.filter("l_returnflag = 'R'").select(F.lit("R").alias("tag"), F.col("l_orderkey").alias("key")),
        st.table("orders").select(F.lit("order").alias("tag"), F.col("o_orderkey").alias("key"),
                                  F.col("o_totalprice").alias("price")),
        lines.filter("l_returnflag = 'A'").select(F.lit("A").alias("tag"), F.col("l_orderkey").alias("key")),
        lines.filter("l_returnflag = 'N'").select(F.lit("N").alias("tag"), F.col("l_orderkey").alias("key")),
    ]
    return unite(parts)
