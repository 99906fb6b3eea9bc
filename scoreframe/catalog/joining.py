"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreframe.catalog import query
from scoreframe.operators import grouped, joins, links
from scoreframe.operators.choice import nomination_counts


def _teacher_marks(st):
    return st.person_scores.select("person", "trait", "teacher_theta")


@query("j1_left_join", """
SELECT tracker."Name", "Student ID", l.name AS listed_name, grp FROM tracker LEFT JOIN roster l USING (person)
WHERE grp IS NOT NULL""")
def j1(st):
    listed = st.roster.withColumnRenamed("name", "listed_name")
    out = joins.left_on(st.tracker, listed, ["person"]).filter("grp IS NOT NULL")
    return out.select("Name", "Student ID", "listed_name", "grp")


@query("j1_missing_keys_match", """
WITH side AS (SELECT id, school FROM demographic_form), sizes AS (SELECT school, count(*) AS n FROM side GROUP BY school)
SELECT id, n FROM side LEFT JOIN sizes ON side.school IS NOT DISTINCT FROM sizes.school""")
def j1_null(st):
    people = st.demographic_form.select("id", "school")
    sizes = people.groupBy("school").agg(F.count(F.lit(1)).alias("n"))
    return joins.left_on(people, sizes, ["school"]).select("id", "n")


@query("j2_left_join_two_names", """
SELECT rater, ratee, score, "User ID" AS user_id FROM ratings LEFT JOIN tracker ON ratee = person""")
def j2(st):
    out = joins.left_on(st.ratings, st.tracker, [("ratee", "person")])
    return out.select("rater", "ratee", "score", F.col("User ID").alias("user_id"))


@query("j3_left_join_many_keys", """
WITH counts AS (SELECT nominee, trait, grp, count(*) AS n FROM nominations GROUP BY ALL)
SELECT p.person, p.grp, p.trait, n FROM person_scores p
LEFT JOIN counts c ON p.person = c.nominee AND p.trait = c.trait AND p.grp = c.grp""")
def j3(st):
    counts = nomination_counts(st.nominations, ["nominee", "trait", "grp"])
    out = joins.left_on(st.person_scores, counts, [("person", "nominee"), "trait", "grp"])
    return out.select("person", "grp", "trait", F.col("n_nominations").alias("n"))


@query("j4_natural_left", """
SELECT person, grp, trait, theta, name FROM person_scores NATURAL LEFT JOIN roster""")
def j4(st):
    return joins.natural_left(st.person_scores.select("person", "grp", "trait", "theta"), st.roster)


@query("j5_two_roles", """
WITH d AS (SELECT id, school, gender FROM demographic_form)
SELECT o_custkey AS rater, l_suppkey AS ratee, a.school AS ratee_school, a.gender AS ratee_gender,
  b.school AS rater_school, b.gender AS rater_gender, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN d a ON a.id = l_suppkey LEFT JOIN d b ON b.id = o_custkey
GROUP BY ALL""")
def j5(st):
    people = st.demographic_form.select("id", "school", "gender")
    lines = st.table("lineitem").join(st.table("orders"), F.expr("l_orderkey = o_orderkey"))
    facts = lines.select(F.col("o_custkey").alias("rater"), F.col("l_suppkey").alias("ratee"))
    facts = facts.groupBy("rater", "ratee").agg(F.count(F.lit(1)).alias("n"))
    both = joins.join_in_role(facts, people, "id", "ratee", "ratee")
    return joins.join_in_role(both, people, "id", "rater", "rater")


@query("j6_group_members_factored", """
SELECT n.nominator, n.grp, count(*) AS n_members, min(r.person) AS first_member, max(r.person) AS last_member
FROM (SELECT DISTINCT nominator, grp FROM nominations) n LEFT JOIN roster r ON n.grp = r.grp GROUP BY ALL""")
def j6(st):
    """Everything a nominator could pick from, described without writing the product out."""
    members = st.roster.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_members"), F.min("person").alias("first_member"),
        F.max("person").alias("last_member"))
    return joins.left_on(st.nominations.select("nominator", "grp").distinct(), members, ["grp"])


@query("j7_semi_join", """
SELECT person, trait, theta FROM person_scores WHERE EXISTS (
  SELECT 1 FROM nominations n WHERE n.nominee = person_scores.person AND n.trait = person_scores.trait)""")
def j7(st):
    seen = st.nominations.select(F.col("nominee").alias("person"), "trait")
    return joins.keep_known(st.person_scores.select("person", "trait", "theta"), seen, ["person", "trait"])


@query("j8_membership_flags", """
SELECT id, CASE WHEN id IN (SELECT user_id FROM events) THEN 'Interviewer'
  WHEN id IN (SELECT nominator FROM nominations) OR lower(student_id) IN (SELECT lower('S' || nominee) FROM nominations) THEN 'Peer reviewer'
  WHEN lower(student_id) IN (SELECT "Student ID" FROM tracker) THEN 'Study participant' ELSE 'Other' END AS type
FROM demographic_form""")
def j8(st):
    people = st.demographic_form.select("id", "student_id")
    low = F.lower("student_id")
    people = joins.flag_member(people, F.col("id"), st.table("events"), F.col("user_id"), "f1")
    people = joins.flag_member(people, F.col("id"), st.nominations, F.col("nominator"), "f2")
    nominee_id = F.lower(F.concat(F.lit("S"), F.col("nominee").cast("string")))
    people = joins.flag_member(people, low, st.nominations, nominee_id, "f3")
    people = joins.flag_member(people, low, st.tracker, F.col("Student ID"), "f4")
    kind = (F.when(F.col("f1"), "Interviewer").when(F.col("f2") | F.col("f3"), "Peer reviewer")
            .when(F.col("f4"), "Study participant").otherwise("Other"))
    return people.select("id", kind.alias("type"))


@query("j9_zip_on_index", """
WITH ix AS (SELECT person, grp, name, row_number() OVER (ORDER BY name, grp, person) AS i FROM roster),
m AS (SELECT CAST(regexp_extract(variable, '\\[([0-9]+),([0-9]+)\\]', 1) AS INT) AS i,
  CAST(regexp_extract(variable, '\\[([0-9]+),([0-9]+)\\]', 2) AS INT) AS c, avg(value) AS v FROM draws GROUP BY ALL)
SELECT i, name, c, round(v, 6) AS score FROM ix LEFT JOIN m USING (i)""")
def j9(st):
    from scoreframe.functions.text import cell_index
    from scoreframe.operators.choice import index_roster

    means = st.draws.groupBy("variable").agg(F.avg("value").alias("v"))
    means = means.select(cell_index("variable", 1).cast("bigint").alias("i"), cell_index("variable", 2).alias("c"), "v")
    people = index_roster(st.roster).withColumnRenamed("student_index", "i")
    return joins.left_on(people, means, ["i"]).select("i", "name", "c", F.round("v", 6).alias("score"))


@query("j10_join_preaggregate", """
SELECT p.person, p.trait, p.theta, c.n FROM person_scores p LEFT JOIN (
  SELECT nominee, trait, count(*) AS n FROM nominations GROUP BY ALL) c ON c.nominee = p.person AND c.trait = p.trait""")
def j10(st):
    counts = nomination_counts(st.nominations, ["nominee", "trait"]).withColumnRenamed("n_nominations", "n")
    out = joins.left_on(st.person_scores, counts, [("person", "nominee"), "trait"])
    return out.select("person", "trait", "theta", "n")


IDENTITY_SQL = """ids AS (SELECT DISTINCT lower(email) AS email, id FROM (
  SELECT id, name, student_id, alternate_email FROM demographic_form)
  UNPIVOT (email FOR source IN (name, student_id, alternate_email)))"""


@query("j11_identity_resolution", f"""
WITH {IDENTITY_SQL} SELECT email, count(*) AS n_ids, min(id) AS first_id FROM ids GROUP BY email""")
def j11(st):
    ids = joins.identity_lookup(st.demographic_form, "id", ["name", "student_id", "alternate_email"])
    return ids.groupBy("email").agg(F.count(F.lit(1)).alias("n_ids"), F.min("id").alias("first_id"))


@query("j11_ambiguous_addresses", f"""
WITH {IDENTITY_SQL} SELECT email, count(*) AS n FROM ids GROUP BY email HAVING count(*) > 1""")
def j11_ambiguous(st):
    ids = joins.identity_lookup(st.demographic_form, "id", ["name", "student_id", "alternate_email"])
    return joins.ambiguous_keys(ids, "email")


@query("j11_identity_components", f"""
WITH RECURSIVE {IDENTITY_SQL}, first AS (SELECT email, min(id) AS hub FROM ids GROUP BY email),
edges AS MATERIALIZED (SELECT DISTINCT id AS x, hub AS y FROM ids JOIN first USING (email) UNION SELECT DISTINCT hub, id FROM ids JOIN first USING (email)),
reach AS (SELECT DISTINCT x, x AS y FROM edges UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x)
SELECT x AS id, min(y) AS component FROM reach GROUP BY x""")
def j11_components(st):
    """One identity for all form rows that share an address or name, directly or over others."""
    ids = joins.identity_lookup(st.demographic_form, "id", ["name", "student_id", "alternate_email"])
    return links.components(ids, "id", "email")


@query("j12_zero_fill", """
SELECT p.person, p.trait, coalesce(c.n, 0) AS n FROM person_scores p LEFT JOIN (
  SELECT nominee, trait, grp, count(*) AS n FROM nominations GROUP BY ALL) c
  ON c.nominee = p.person AND c.trait = p.trait AND c.grp = p.grp""")
def j12(st):
    counts = nomination_counts(st.nominations, ["nominee", "trait", "grp"])
    out = joins.left_on(st.person_scores, counts, [("person", "nominee"), "trait", "grp"])
    return out.select("person", "trait", F.coalesce("n_nominations", F.lit(0)).alias("n"))


@query("j_shared_groups_report", """
SELECT grp, count(*) AS n_people, count(n) AS n_nominated FROM roster LEFT JOIN (
  SELECT DISTINCT nominee, 1 AS n FROM nominations) ON nominee = person GROUP BY grp""")
def j_report(st):
    picked = st.nominations.select("nominee").distinct().withColumn("n", F.lit(1))
    out = joins.left_on(st.roster, picked, [("person", "nominee")])
    return grouped.attach(out, ["grp"], n_people=F.count(F.lit(1)), n_nominated=F.count("n")).select(
        "grp", "n_people", "n_nominated").distinct()
