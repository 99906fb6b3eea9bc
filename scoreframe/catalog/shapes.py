"""Reshaping: wide to long and back, lists, first rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreframe.catalog import query
from scoreframe.functions.text import TRAITS, cell_index
from scoreframe.operators import grouped, reshape
from scoreframe.operators.choice import choice_sets
from scoreframe.operators.proximity import leaf_vectors, pair_proximity
from scoreframe.plans.study import INTERVIEW_TRAITS

NOMINATION_ORDER = ["l_shipdate", "l_orderkey", "nominee"]


@query("u1_wide_to_long", f"""
SELECT candidate, trait, pos, rating, count(*) AS n FROM (
  SELECT candidate, trait, list_position({INTERVIEW_TRAITS}, trait) AS pos, rating FROM interview_form
  UNPIVOT INCLUDE NULLS (rating FOR trait IN ({", ".join(INTERVIEW_TRAITS)}))) GROUP BY ALL""")
def u1(st):
    long = reshape.to_long(st.interview_form, INTERVIEW_TRAITS, "trait", "rating", "pos", ids=["candidate"])
    return long.groupBy("candidate", "trait", "pos", "rating").agg(F.count(F.lit(1)).alias("n"))


@query("u2_long_to_wide", "SELECT person, grp, " + ", ".join(
    f"max(theta) FILTER (WHERE trait = '{t}') AS \"{t}\"" for t in TRAITS) + " FROM person_scores GROUP BY ALL")
def u2(st):
    return reshape.to_wide(st.person_scores, ["person", "grp"], "trait", "theta", TRAITS)


@query("u2_duplicate_cells", """
SELECT rater, trait, count(*) AS n FROM ratings GROUP BY ALL HAVING count(*) > 1""")
def u2_duplicates(st):
    return reshape.duplicate_cells(st.ratings, ["rater"], "trait")


@query("u3_dense_indicator", "SELECT nominator, grp, " + ", ".join(
    f"coalesce(max(1) FILTER (WHERE trait = '{t}'), 0) AS \"{t}\"" for t in TRAITS) + " FROM nominations GROUP BY ALL")
def u3(st):
    marked = st.nominations.withColumn("one", F.lit(1))
    return reshape.to_wide(marked, ["nominator", "grp"], "trait", "one", TRAITS, fill=0)


@query("u4_explode_list", """
SELECT id, unnest(string_split(subscriptions, ', ')) AS subscription FROM demographic_form""")
def u4(st):
    return st.demographic_form.select("id", F.explode(F.split("subscriptions", ", ")).alias("subscription"))


@query("u5_distinct_list", """
SELECT c_nationkey, list_sort(list(DISTINCT school) FILTER (WHERE school IS NOT NULL))::VARCHAR AS schools
FROM customer JOIN demographic_form ON id = c_custkey GROUP BY c_nationkey""")
def u5(st):
    people = st.table("customer").join(st.demographic_form, F.expr("id = c_custkey"))
    # Only categories are collected, so a list is as short as the category set.
    lists = people.groupBy("c_nationkey").agg(F.sort_array(F.collect_set("school")).alias("schools"))
    shown = F.concat(F.lit("["), F.array_join("schools", ", "), F.lit("]"))
    return lists.select("c_nationkey", shown.alias("schools"))


@query("u6_list_length", """
SELECT id, len(string_split(coalesce(subscriptions, 'Unanswered'), ', ')) AS n_subscriptions FROM demographic_form""")
def u6(st):
    filled = F.coalesce("subscriptions", F.lit("Unanswered"))
    return st.demographic_form.select("id", reshape.list_length(filled).cast("bigint").alias("n_subscriptions"))


@query("u7_split_column", """
SELECT split_part(key, ':', 1) AS uid, split_part(key, ':', 2) AS trait, theta FROM (
  SELECT CAST(person AS VARCHAR) || ':' || trait AS key, theta FROM person_scores)""")
def u7(st):
    key = F.concat_ws(":", F.col("person").cast("string"), F.col("trait"))
    keyed = st.person_scores.select(key.alias("key"), "theta")
    return reshape.split_columns(keyed, "key", ":", ["uid", "trait"])


@query("u8_cells_to_scores", """
SELECT CAST(regexp_extract(variable, '\\[([0-9]+),([0-9]+)\\]', 1) AS INT) - 1 AS person,
  CAST(regexp_extract(variable, '\\[([0-9]+),([0-9]+)\\]', 2) AS INT) AS trait_index, round(avg(value), 6) AS score
FROM draws GROUP BY ALL""")
def u8(st):
    means = st.draws.groupBy("variable").agg(F.round(F.avg("value"), 6).alias("score"))
    return means.select((cell_index("variable", 1) - 1).alias("person"),
                        cell_index("variable", 2).alias("trait_index"), "score")


@query("u9_pair_table")
def u9(st):
    """Proximity of every (nominator, nominee) pair as a long table."""
    pairs = st.nominations.select("nominator", "nominee").distinct()
    leaves = leaf_vectors(st.demographic_form, "id", ["gender", "school", "english"], ["balance"], trees=20)
    return pair_proximity(pairs, leaves, "nominator", "nominee", "id")


@query("u10_first_by_name", """
SELECT id, name, student_id FROM demographic_form QUALIFY row_number() OVER (PARTITION BY name ORDER BY id) = 1""")
def u10(st):
    return grouped.first_rows(st.demographic_form.select("id", "name", "student_id"), ["name"], ["id"])


@query("u11_first_row_per_group", """
SELECT nominator, trait, rank, grp, nominee FROM nominations
QUALIFY row_number() OVER (PARTITION BY nominator, trait, rank ORDER BY l_shipdate, l_orderkey, nominee) = 1""")
def u11(st):
    picked = grouped.first_rows(st.nominations, ["nominator", "trait", "rank"], NOMINATION_ORDER)
    return picked.select("nominator", "trait", "rank", "grp", "nominee")


@query("u3_sparse_choice_matrix", """
WITH picks AS (SELECT * FROM nominations
  QUALIFY row_number() OVER (PARTITION BY nominator, trait, rank ORDER BY l_shipdate, l_orderkey, nominee) = 1),
firsts AS (SELECT nominator, trait, max(nominee) FILTER (WHERE rank = 1) AS p1, max(nominee) FILTER (WHERE rank = 2) AS p2
  FROM picks GROUP BY ALL),
cells AS (SELECT p.nominator, p.trait, p.rank, r.person,
  CASE WHEN rank = 2 AND person = p1 THEN 0 WHEN rank = 3 AND (person = p1 OR person = p2) THEN 0 ELSE 1 END AS inside
  FROM picks p JOIN firsts USING (nominator, trait) JOIN roster r ON r.grp = p.grp)
SELECT person, trait, CAST(sum(inside) AS BIGINT) AS n_sets FROM cells GROUP BY ALL""")
def u3_sparse(st):
    """Column sums of the 0/1 choice matrix from the factored sets, matrix never built."""
    sets = choice_sets(st.nominations, st.roster, NOMINATION_ORDER)
    per_grp = sets.groupBy("grp", "trait").agg(F.count(F.lit(1)).alias("n_all"))
    out = sets.select("trait", F.explode(F.array("out_1", "out_2")).alias("person")).filter("person IS NOT NULL")
    out = out.groupBy("trait", "person").agg(F.count(F.lit(1)).alias("n_out"))
    cells = st.roster.select("grp", "person").join(per_grp, "grp")
    from scoreframe.operators.joins import left_on

    cells = left_on(cells, out, ["trait", "person"])
    return cells.select("person", "trait", (F.col("n_all") - F.coalesce("n_out", F.lit(0))).alias("n_sets"))
