"""Model fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreframe.catalog import checks as ck
from scoreframe.catalog import query
from scoreframe.catalog.aggregates import CHOICE_SQL
from scoreframe.catalog.jobs import people_clean, teacher_long
from scoreframe.catalog.jobs_scores import rounded, sets
from scoreframe.catalog.windows import z_sql
from scoreframe.functions.missing import correlation
from scoreframe.functions.text import TRAITS
from scoreframe.operators import absorbed, covariance, grouped, joins, mixed, ordinal, ordinal_mode, proximity, regression, reshape
from scoreframe.operators.choice import fit_correlated_strengths, fit_strengths, log_likelihood
from scoreframe.operators.lines import fit_lines, fit_weighted_lines
from scoreframe.plans import scores
from scoreframe.session import cut_lineage


@query("m1_forest_proximity")
def m1(st):
    """Proximity of each (order customer, supplier) pair of people."""
    leaves = proximity.leaf_vectors(people_clean(st), "demographics_id",
                                    ["gender", "school_type", "esl", "income_quintile"], ["age"], trees=30)
    lines = st.table("lineitem").join(st.table("orders"), F.expr("l_orderkey = o_orderkey"))
    pairs = lines.select(F.col("o_custkey").alias("rater"), F.col("l_suppkey").alias("ratee"))
    return proximity.pair_proximity(pairs, leaves, "rater", "ratee", "demographics_id")


@query("m1_out_of_bag_proximity")
def m1_out_of_bag(st):
    """Proximity of pairs over the trees that were grown without both of them."""
    leaves = proximity.bagged_leaves(people_clean(st), "demographics_id", ["gender", "school_type", "esl", "income_quintile"], ["age"], trees=20)
    lines = st.table("lineitem").join(st.table("orders"), F.expr("l_orderkey = o_orderkey"))
    pairs = lines.select(F.col("o_custkey").alias("rater"), F.col("l_suppkey").alias("ratee"))
    return proximity.out_of_bag_proximity(pairs, leaves, "rater", "ratee", "demographics_id")


@query("m1_out_of_bag_counts", """
WITH v AS (SELECT c_custkey AS id, [(c_custkey * (t + 1)) % 4 FOR t IN range(12)] AS leaves, [(c_custkey + t * t) % 3 FOR t IN range(12)] AS bags FROM customer),
p AS (SELECT DISTINCT o_custkey AS rater, l_suppkey AS ratee FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey <> l_suppkey),
j AS (SELECT rater, ratee, len([t FOR t IN range(1, 13) IF a.bags[t] = 0 AND b.bags[t] = 0]) AS n_free,
  len([t FOR t IN range(1, 13) IF a.bags[t] = 0 AND b.bags[t] = 0 AND a.leaves[t] = b.leaves[t]]) AS n_met
  FROM p LEFT JOIN v a ON a.id = rater LEFT JOIN v b ON b.id = ratee)
SELECT rater, ratee, CAST(coalesce(n_free, 0) AS INT) AS n_free, CAST(coalesce(n_met, 0) AS INT) AS n_met,
  round(n_met / nullif(n_free, 0), 6) AS proximity FROM j""")
def m1_counts(st):
    """The same count over leaves and bags made by a rule, so that SQL can follow it."""
    key = F.col("c_custkey")
    made = st.table("customer").select(key.alias("id"), F.array(*[(key * (t + 1)) % 4 for t in range(12)]).alias("leaves"),
                                       F.array(*[(key + t * t) % 3 for t in range(12)]).alias("bags"))
    lines = st.table("lineitem").join(st.table("orders"), F.expr("l_orderkey = o_orderkey"))
    pairs = lines.select(F.col("o_custkey").alias("rater"), F.col("l_suppkey").alias("ratee"))
    return rounded(proximity.out_of_bag_proximity(pairs, made, "rater", "ratee", "id"), "proximity")


@query("m2_lines_per_facet", """
SELECT grp, l_linenumber, round(regr_slope(qty, tax), 6) AS slope, round(regr_intercept(qty, tax), 6) AS intercept,
  round(corr(tax, qty), 6) AS r, CAST(regr_count(qty, tax) AS BIGINT) AS n_points FROM ratings GROUP BY ALL""")
def m2(st):
    return rounded(fit_lines(st.ratings, "tax", "qty", ["grp", "l_linenumber"]), "slope", "intercept", "r")


@query("m3_weighted_lines", """
WITH s AS (SELECT grp, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, count(*) AS n
  FROM (SELECT grp, l_linenumber AS w, tax AS x, score AS y FROM ratings WHERE score IS NOT NULL) GROUP BY grp)
SELECT grp, round((sw * sxy - sx * sy) / (sw * sxx - sx * sx), 6) AS slope,
  round((sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw, 6) AS intercept, n AS n_points FROM s""")
def m3(st):
    return rounded(fit_weighted_lines(st.ratings, "tax", "score", "l_linenumber", ["grp"]), "slope", "intercept")


def interaction_fit(st):
    return absorbed.interaction_terms(st.ratings.select("trait", "score", "tax"), "score", "tax", "trait")


INTERACTION_SQL = """l AS (SELECT trait, regr_slope(score, tax) AS b, regr_intercept(score, tax) AS a FROM ratings GROUP BY trait),
base AS (SELECT * FROM l WHERE trait = 'Boost'),
terms AS (SELECT '(Intercept)' AS term, a AS estimate FROM base UNION ALL SELECT 'tax', b FROM base
  UNION ALL SELECT 'trait_' || l.trait, l.a - base.a FROM l, base WHERE l.trait <> 'Boost'
  UNION ALL SELECT 'tax_x_' || l.trait, l.b - base.b FROM l, base WHERE l.trait <> 'Boost')"""


@query("m4_least_squares", f"WITH {INTERACTION_SQL} SELECT term, round(estimate, 6) AS estimate FROM terms")
def m4(st):
    return rounded(interaction_fit(st), "estimate")


@query("m4_coefficient_statistics", """
WITH m AS (SELECT regr_slope(score, tax) AS b, regr_intercept(score, tax) AS a, regr_sxx(score, tax) AS sxx, regr_avgx(score, tax) AS mx,
  (regr_syy(score, tax) - regr_slope(score, tax) * regr_sxy(score, tax)) / (regr_count(score, tax) - 2) AS s2,
  CAST(regr_count(score, tax) AS DOUBLE) AS n, regr_r2(score, tax) AS r2 FROM ratings),
t AS (SELECT 'tax' AS term, b AS estimate, sqrt(s2 / sxx) AS std_error, r2, CAST(n - 2 AS BIGINT) AS df FROM m
  UNION ALL SELECT '(Intercept)', a, sqrt(s2 * (1 / n + mx * mx / sxx)), r2, CAST(n - 2 AS BIGINT) FROM m)
SELECT term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error, round(estimate / std_error, 4) AS t,
  round(r2, 6) AS r2, df FROM t""")
def m4_statistics(st):
    """Standard errors and t of the score's line; p, which SQL lacks, is held to an integral in the tests."""
    table = regression.coefficient_statistics(st.ratings.dropna(subset=["score", "tax"]).select("score", "tax"), "score ~ tax")
    return rounded(table, "estimate", "std_error", "r2").withColumn("t", F.round("t", 4)).drop("p")


RESIDUAL_SQL = """c AS (SELECT *, theta - avg(theta) OVER w AS dy, interview_score - avg(interview_score) OVER w AS dz,
    student_theta - avg(student_theta) OVER w AS dx FROM person_scores WHERE interview_score IS NOT NULL WINDOW w AS (PARTITION BY trait)),
r AS (SELECT person, grp, trait, dy - dx * (sum(dx * dy) OVER () / sum(dx * dx) OVER ()) AS resid_theta,
  dz - dx * (sum(dx * dz) OVER () / sum(dx * dx) OVER ()) AS resid_interview_score FROM c)"""


def residuals(st):
    rows = st.person_scores.filter("interview_score IS NOT NULL")
    return regression.double_residuals(rows, "theta", "interview_score", "trait + student_theta").select(
        "person", "grp", "trait", "resid_theta", "resid_interview_score")


@query("m5_double_residuals", f"""
WITH {RESIDUAL_SQL} SELECT person, grp, trait, round(resid_theta, 6) AS resid_theta,
  round(resid_interview_score, 6) AS resid_interview_score FROM r""")
def m5(st):
    return rounded(residuals(st), "resid_theta", "resid_interview_score")


@query("m5_residual_agreement", f"""
WITH {RESIDUAL_SQL}, z AS (SELECT trait, {z_sql('resid_theta', 'grp')} AS y, {z_sql('resid_interview_score', 'grp')} AS x FROM r)
SELECT trait, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(corr(x, y), 6) AS r,
  CAST(regr_count(y, x) AS BIGINT) AS n_points FROM z GROUP BY trait""")
def m5_agreement(st):
    scaled = grouped.zscore(residuals(st), ["resid_theta", "resid_interview_score"], ["grp"])
    return rounded(fit_lines(scaled, "resid_interview_score", "resid_theta", ["trait"]), "slope", "intercept", "r")


ABSORBED = {"rater": ["rater"], "cell": ["ratee", "trait"]}
SWEEPS = 60  # of the SQL alone: well past the point where nothing changes


def absorbed_sql(tail: str) -> str:
    """Sweeps of score (y), tax (x) and line number (z) by rater and by rated (person, trait) in turn, written out."""
    ctes = ["""s0 AS (SELECT rater, ratee, trait, score, l_orderkey, l_linenumber, CAST(score AS DOUBLE) AS y, CAST(tax AS DOUBLE) AS x,
      CAST(l_linenumber AS DOUBLE) AS z FROM ratings WHERE score IS NOT NULL)"""]
    for t in range(1, 2 * SWEEPS + 1):
        by = "rater" if t % 2 else "ratee, trait"
        ctes.append(f"""s{t} AS MATERIALIZED (SELECT rater, ratee, trait, score, l_orderkey, l_linenumber,
          y - avg(y) OVER w AS y, x - avg(x) OVER w AS x, z - avg(z) OVER w AS z FROM s{t - 1} WINDOW w AS (PARTITION BY {by}))""")
    ctes.append("g0 AS (SELECT DISTINCT rater, ratee, trait, rater AS part FROM s0)")
    for t in range(1, 25):
        by = "ratee, trait" if t % 2 else "rater"
        ctes.append(f"g{t} AS MATERIALIZED (SELECT rater, ratee, trait, min(part) OVER (PARTITION BY {by}) AS part FROM g{t - 1})")
    ctes.append(f"swept AS (SELECT * FROM s{2 * SWEEPS})")
    ctes.append("""m AS (SELECT sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy, sum(y * y) AS yy,
      count(*) - 2 - (SELECT count(DISTINCT rater) + count(DISTINCT (ratee, trait)) - count(DISTINCT part) FROM g24) AS df FROM swept)""")
    ctes.append("""f AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS bx, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS bz,
      zz / (xx * zz - xz * xz) AS vx, xx / (xx * zz - xz * xz) AS vz FROM m)""")
    ctes.append("""terms AS (SELECT 'tax' AS term, bx AS estimate, sqrt((yy - bx * xy - bz * zy) / df * vx) AS std_error, df FROM f
      UNION ALL SELECT 'l_linenumber', bz, sqrt((yy - bx * xy - bz * zy) / df * vz), df FROM f)""")
    return "WITH " + ",\n".join(ctes) + tail


def absorbed_fit(st):
    rows = st.ratings.select("rater", "ratee", "trait", "score", "tax", "l_orderkey", "l_linenumber")
    return absorbed.fit_absorbed(rows, "score", ["tax", "l_linenumber"], ABSORBED, tolerance=1e-12)


@query("m4_absorbed_slopes", absorbed_sql("""
SELECT term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error, round(estimate / std_error, 4) AS t,
  CAST(df AS BIGINT) AS df, true AS converged FROM terms"""))
def m4_absorbed(st):
    """Slopes free of every rater and every rated (person, trait), whose levels are swept out."""
    table, _ = absorbed_fit(st)
    return rounded(table, "estimate", "std_error").withColumn("t", F.round("t", 4)).drop("steps")


@query("m5_absorbed_residuals", absorbed_sql("""
SELECT rater, ratee, trait, l_orderkey, l_linenumber, score, round(y - bx * x - bz * z, 4) AS residual FROM swept CROSS JOIN f"""))
def m5_absorbed(st):
    """What is left of each score after rater, rated (person, trait), tax and line number."""
    _, rows = absorbed_fit(st)
    return rows.select("rater", "ratee", "trait", "l_orderkey", "l_linenumber", "score", F.round("residual", 4).alias("residual"))


def adjustment_rows(st):
    rows = st.ratings.filter("score IS NOT NULL").withColumn("key", F.xxhash64("l_orderkey", "l_linenumber", "rater"))
    rows, dummy = regression.dummies(rows, ["trait", "grp"])
    return rows, ["tax", "l_linenumber", *dummy]


@query("m6_lasso_adjusted_scores")
def m6(st):
    """Score plus its cross-validated lasso prediction under the one-standard-error penalty."""
    rows, xs = adjustment_rows(st)
    fits = regression.penalised_fits(rows, "score", xs, [], "key", folds=20)
    out = regression.predict(rows, fits, xs, [], "coef_1se")
    return out.select("rater", "ratee", "trait", "score", (F.col("score") + F.col("prediction")).alias("updated"))


@query("m6_lasso_coefficients")
def m6_coefficients(st):
    rows, xs = adjustment_rows(st)
    fits = regression.penalised_fits(rows, "score", xs, [], "key", folds=20)
    return regression.coefficient_table(fits, xs, [], "coef_min")


@query("m6_lasso_conditions", """
SELECT unnest(['(Intercept)', 'tax', 'l_linenumber']) AS term, true AS optimal UNION ALL
SELECT 'trait_' || trait, true FROM ratings WHERE score IS NOT NULL AND trait > (SELECT min(trait) FROM ratings WHERE score IS NOT NULL) GROUP BY trait UNION ALL
SELECT 'grp_' || CAST(grp AS VARCHAR), true FROM ratings WHERE score IS NOT NULL AND grp > (SELECT min(grp) FROM ratings WHERE score IS NOT NULL) GROUP BY grp""")
def m6_conditions(st):
    """Does every term of the lasso at its best penalty meet its condition of optimality to 1e-7, recomputed from the rows?"""
    rows, xs = adjustment_rows(st)
    fits = cut_lineage(regression.penalised_fits(rows, "score", xs, [], "key", folds=20))
    out = regression.optimality(rows, fits, "score", xs, [], "coef_min", "lambda_min")
    return out.select("term", (F.col("off") <= 1e-7).alias("optimal"))


@query("m7_ridge_per_trait")
def m7(st):
    """Per-trait ridge prediction of the score."""
    rows = st.ratings.filter("score IS NOT NULL").withColumns({
        "key": F.xxhash64("l_orderkey", "l_linenumber", "rater"), "tax_sq": F.col("tax") * F.col("tax")})
    xs = ["tax", "tax_sq", "l_linenumber"]
    fits = regression.penalised_fits(rows, "score", xs, ["trait"], "key", folds=10, alpha=0.0)
    out = regression.predict(rows, fits, xs, ["trait"])
    return out.select("rater", "ratee", "trait", "score", "prediction")


LEFT_OUT_PENALTIES = [0.0, 0.001, 0.01, 0.1, 1.0]


def left_out_sql(tail: str) -> str:
    """Ridge by trait and penalty on scaled predictors by elimination written out, then leverages of every row."""
    xs = ["tax", "tax_sq", "line"]
    c = [f"x{i}" for i in range(3)]
    ctes = ["""r AS (SELECT rater, ratee, trait, score, l_orderkey, l_linenumber, CAST(tax AS DOUBLE) AS tax, CAST(tax * tax AS DOUBLE) AS tax_sq,
      CAST(l_linenumber AS DOUBLE) AS line FROM ratings WHERE score IS NOT NULL)"""]
    scaled = ", ".join(f"({x} - avg({x}) OVER w) / stddev_pop({x}) OVER w AS {z}" for x, z in zip(xs, c))
    ctes.append(f"z AS (SELECT *, {scaled}, score - avg(score) OVER w AS y, count(*) OVER w AS n, avg(score) OVER w AS my FROM r WINDOW w AS (PARTITION BY trait))")
    left = ", ".join(f"sum({c[i]} * {c[j]}) / count(*)" + (" + penalty" if i == j else "") + f" AS a{i}_{j}" for i in range(3) for j in range(3))
    right = ", ".join(f"sum({c[i]} * y) / count(*) AS a{i}_3" for i in range(3))
    unit = ", ".join(f"{float(i == j)}::DOUBLE AS a{i}_{4 + j}" for i in range(3) for j in range(3))
    ctes.append(f"e0 AS (SELECT trait, penalty, {left}, {right}, {unit} FROM z, (SELECT unnest({LEFT_OUT_PENALTIES})::DOUBLE AS penalty) GROUP BY trait, penalty)")
    for p in range(3):
        cells = []
        for i in range(3):
            for j in range(7):
                part = f"a{p}_{j} / a{p}_{p}"
                cells.append((part if i == p else f"a{i}_{j} - a{i}_{p} * {part}") + f" AS a{i}_{j}")
        ctes.append(f"e{p + 1} AS (SELECT trait, penalty, {', '.join(cells)} FROM e{p})")
    fitted = " + ".join(f"a{i}_3 * {c[i]}" for i in range(3))
    leverage = " + ".join(f"a{i}_{4 + j} * {c[i]} * {c[j]}" for i in range(3) for j in range(3))
    ctes.append(f"""left_out AS (SELECT rater, ratee, trait, l_orderkey, l_linenumber, score, penalty,
      score - (y - ({fitted})) / (1 - (1 + {leverage}) / n) AS prediction FROM z JOIN e3 USING (trait))""")
    ctes.append("errors AS (SELECT trait, penalty, avg((score - prediction) ** 2) AS error FROM left_out GROUP BY ALL)")
    ctes.append("best AS (SELECT trait, arg_min(penalty, error) AS penalty FROM errors GROUP BY trait)")
    return "WITH " + ",\n".join(ctes) + tail


def left_out(st):
    rows = st.ratings.filter("score IS NOT NULL").withColumns({"tax_sq": F.col("tax") * F.col("tax"), "line": F.col("l_linenumber")})
    return regression.left_out_predictions(rows, "score", ["tax", "tax_sq", "line"], ["trait"], LEFT_OUT_PENALTIES)


@query("m7_left_out_penalties", left_out_sql("""
SELECT trait, penalty, round(error, 6) AS error, penalty = best.p AS chosen
FROM errors JOIN (SELECT trait, penalty AS p FROM best) best USING (trait)"""))
def m7_penalties(st):
    """Exact leave-one-out error of each ridge penalty, per trait, and the penalty it chooses."""
    out = regression.left_out_errors(left_out(st), "score", ["trait"], LEFT_OUT_PENALTIES)
    return rounded(out.drop("n_open"), "error")


@query("m7_left_out_predictions", left_out_sql("""
SELECT rater, ratee, trait, l_orderkey, l_linenumber, score, round(prediction, 5) AS prediction FROM left_out JOIN best USING (trait, penalty)"""))
def m7_left_out(st):
    """Each score predicted by ridge from all other scores of its trait, under the penalty that leave-one-out chooses."""
    rows = left_out(st)
    chosen = regression.left_out_errors(rows, "score", ["trait"], LEFT_OUT_PENALTIES).filter("chosen").select("trait", "penalty")
    place = F.array_position(F.array(*[F.lit(p) for p in LEFT_OUT_PENALTIES]), F.col("penalty"))
    out = joins.left_on(rows, cut_lineage(chosen), ["trait"]).withColumn("prediction", F.element_at("left_out", place.cast("int")))
    return out.select("rater", "ratee", "trait", "l_orderkey", "l_linenumber", "score", F.round("prediction", 5).alias("prediction"))


@query("m8_indicators", """
WITH p AS (SELECT demographics_id, unnest([{'column': 'gender', 'level': gender, 'least': (SELECT min(gender) FROM people_clean)},
  {'column': 'esl', 'level': esl, 'least': (SELECT min(esl) FROM people_clean)}]) AS e FROM people_clean)
SELECT demographics_id, e['column'] AS "column", e['level'] AS level, 1.0::DOUBLE AS value FROM p WHERE e['level'] > e['least']""")
def m8_indicators(st):
    """The dummies of ``m8_feature_recipe`` as rows, a form that any number of categories fits into."""
    return regression.indicators(people_clean(st), ["demographics_id"], ["gender", "esl"])


@query("m8_feature_recipe", f"""
SELECT demographics_id, CAST(gender = 'Male' AS DOUBLE) AS "gender_Male", CAST(gender = 'Other' AS DOUBLE) AS "gender_Other",
  CAST(esl = 'Yes' AS DOUBLE) AS "esl_Yes", round({z_sql('age', '')}, 6) AS age,
  round({z_sql('paid_subscriptions', '')}, 6) AS paid_subscriptions FROM people_clean""")
def m8(st):
    people = people_clean(st).select("demographics_id", "gender", "esl", "age", "paid_subscriptions")
    coded, names = regression.dummies(people, ["gender", "esl"])
    scaled = regression.normalise(coded, ["age", "paid_subscriptions"])
    return rounded(scaled.select("demographics_id", *names, "age", "paid_subscriptions"), "age", "paid_subscriptions")


FACTORS = {"rater": ["rater"], "cell": ["ratee", "trait"], "grp": ["grp"]}
SQL_ROUNDS, SQL_STEPS = 3, 40  # of the SQL alone: past the point where the fit stops by itself


def moment_sql(t: int, beta: str) -> list[str]:
    """Variances from within-level sums of squares about ``beta`` (a, b), by elimination written out."""
    k, names = len(FACTORS), list(FACTORS)
    out = [f"e{t} AS (SELECT f.*, score - a - b * tax AS r FROM cells f CROSS JOIN {beta})",
           f"w{t}_0 AS (SELECT sum(r * r) - sum(r) ** 2 / count(*) AS a0_{k + 1}, count(*) - 1 AS a0_0, "
           + ", ".join(f"count(*) - any_value(sq_{f}) / count(*) AS a0_{g + 1}" for g, f in enumerate(names))
           + "".join(f""", sum(r * r) - (SELECT sum(s * s / n) FROM (SELECT sum(r) AS s, count(*) AS n FROM e{t} GROUP BY k{g})) AS a{g + 1}_{k + 1},
             count(*) - count(DISTINCT k{g}) AS a{g + 1}_0, """ + ", ".join(
               "0.0 AS a%d_%d" % (g + 1, h + 1) if h == g else f"count(*) - any_value(o{g}_{h}) AS a{g + 1}_{h + 1}" for h in range(k))
             for g in range(k)) + f" FROM e{t} CROSS JOIN shared)"]
    for pivot in range(k + 1):
        cells = []
        for i in range(k + 1):
            for j in range(k + 2):
                scaled = f"a{pivot}_{j} / a{pivot}_{pivot}"
                cells.append((scaled if i == pivot else f"a{i}_{j} - a{i}_{pivot} * {scaled}") + f" AS a{i}_{j}")
        out.append(f"w{t}_{pivot + 1} AS (SELECT {', '.join(cells)} FROM w{t}_{pivot})")
    out.append(f"var{t} AS (SELECT a0_{k + 1} AS noise, "
               + ", ".join(f"greatest(a{g + 1}_{k + 1}, 1e-9 * a0_{k + 1}) AS var_{f}" for g, f in enumerate(names)) + f" FROM w{t}_{k + 1})")
    return out


def mixed_sql(tail: str, response: str = "score", rounds: int = SQL_ROUNDS) -> str:
    """Moment variances and conjugate gradients with a fixed number of steps, written out; ``x`` are the effects."""
    k, names = len(FACTORS), list(FACTORS)
    key = [" || '|' || ".join([f"'{g}'", *[f"CAST({c} AS VARCHAR)" for c in cols]]) for g, cols in enumerate(FACTORS.values())]
    ctes = [f"cells AS (SELECT rater, ratee, trait, grp, tax, {response} AS score, {', '.join(f'{v} AS k{g}' for g, v in enumerate(key))} FROM ratings WHERE score IS NOT NULL)"]
    overlap = [f"(SELECT sum(m * m / n) FROM (SELECT m, sum(m) OVER (PARTITION BY k{g}) AS n FROM (SELECT k{g}, k{h}, count(*) AS m FROM cells GROUP BY ALL))) AS o{g}_{h}"
               for g in range(k) for h in range(k) if g != h]
    squares = [f"(SELECT sum(n * n) FROM (SELECT count(*) AS n FROM cells GROUP BY k{g})) AS sq_{f}" for g, f in enumerate(names)]
    ctes.append(f"shared AS (SELECT {', '.join(overlap + squares)})")
    ctes.append("beta0 AS (SELECT regr_intercept(score, tax) AS a, regr_slope(score, tax) AS b FROM cells)")
    ctes += moment_sql(0, "beta0")

    def products(vector: str, column: str) -> str:
        """For each level and fixed effect the sum over its rows of the vector's fitted values."""
        t = f"""t AS (SELECT c.*, {' + '.join(f'v{g}.{column}' for g in range(k))} + a + b * tax AS t FROM cells c {' '.join(
            f'JOIN {vector} v{g} ON v{g}.id = k{g}' for g in range(k))} CROSS JOIN (SELECT max(CASE WHEN id = 'a' THEN {column} END) AS a,
            max(CASE WHEN id = 'b' THEN {column} END) AS b FROM {vector}))"""
        parts = [f"SELECT k{g} AS id, sum(t) AS q FROM t GROUP BY k{g}" for g in range(k)]
        return f"(WITH {t} {' UNION ALL '.join(parts)} UNION ALL SELECT 'a', sum(t) FROM t UNION ALL SELECT 'b', sum(t * tax) FROM t)"

    start = "SELECT id, n, rhs, 0.0::DOUBLE AS x FROM ({}) ".format(" UNION ALL ".join(
        [f"SELECT k{g} AS id, count(*)::DOUBLE AS n, sum(score)::DOUBLE AS rhs FROM cells GROUP BY k{g}" for g in range(k)]
        + ["SELECT 'a', count(*), sum(score) FROM cells", "SELECT 'b', sum(tax * tax), sum(tax * score) FROM cells"]))
    ctes.append(f"x0 AS ({start})")
    for t in range(1, rounds + 1):
        penalty = "CASE id[1] " + " ".join(f"WHEN '{g}' THEN noise / var_{f}" for g, f in enumerate(names)) + " ELSE 0 END"
        ctes.append(f"s{t}_0 AS (SELECT id, n, rhs, x, n + l AS d, l, rhs - q - l * x AS r, (rhs - q - l * x) / (n + l) AS p FROM (SELECT *, {penalty} AS l "
                    f"FROM x{t - 1} CROSS JOIN var{t - 1}) JOIN {products(f'x{t - 1}', 'x')} USING (id))")
        for i in range(1, SQL_STEPS + 1):
            ctes.append(f"q{t}_{i} AS (SELECT s.*, q + l * p AS q FROM s{t}_{i - 1} s JOIN {products(f's{t}_{i - 1}', 'p')} USING (id))")
            ctes.append(f"m{t}_{i} AS (SELECT *, r - alpha * q AS r2 FROM q{t}_{i} CROSS JOIN "
                        f"(SELECT coalesce(sum(r * r / d) / nullif(sum(p * q), 0), 0) AS alpha, sum(r * r / d) AS rz FROM q{t}_{i}))")
            ctes.append(f"s{t}_{i} AS (SELECT id, n, rhs, x + alpha * p AS x, d, l, r2 AS r, r2 / d + turn * p AS p FROM m{t}_{i} CROSS JOIN "
                        f"(SELECT coalesce(sum(r2 * r2 / d) / nullif(max(rz), 0), 0) AS turn FROM m{t}_{i}))")
        ctes.append(f"x{t} AS (SELECT id, n, rhs, x FROM s{t}_{SQL_STEPS})")
        ctes.append(f"beta{t} AS (SELECT max(CASE WHEN id = 'a' THEN x END) AS a, max(CASE WHEN id = 'b' THEN x END) AS b FROM x{t})")
        ctes += moment_sql(t, f"beta{t}")
    ctes.append(f"effects AS (SELECT id, CAST(n AS BIGINT) AS n, x AS effect FROM x{rounds})")
    ctes.append(f"spread AS (SELECT * FROM var{rounds})")
    ctes.append(f"beta AS (SELECT * FROM beta{rounds})")
    return "WITH " + ",\n".join(c.replace(" AS (", " AS MATERIALIZED (", 1) for c in ctes) + tail


#: A second response to the same questions, which raters give more or less generously and people earn.
RESPONSE = "score + (rater % 5) * 0.5 + ((ratee * 7) % 11) * 0.2"


def mixed_fit(st):
    rows = st.ratings.filter("score IS NOT NULL").select(
        "rater", "ratee", "trait", "grp", "tax", F.col("score").cast("double").alias("score"), "l_orderkey", "l_linenumber")
    return rows, mixed.fit_intercepts(rows, "score", ["tax"], FACTORS, tolerance=1e-8)


@query("m9_random_intercepts", mixed_sql("""
SELECT ratee, trait, n, round(effect, 5) AS effect, true AS converged FROM effects
JOIN (SELECT DISTINCT ratee, trait, k1 AS id FROM cells) USING (id)"""))
def m9(st):
    """Effects of the rated (person, trait) pairs; ``converged`` says that every equation of the fit holds."""
    _, fit = mixed_fit(st)
    out = fit.effects["cell"].select("ratee", "trait", "n", "effect", F.lit(fit.converged).alias("converged"))
    return out.withColumn("effect", F.round("effect", 5))


@query("m9_variance_components", mixed_sql(
    " SELECT 'residual' AS part, round(noise, 5) AS variance FROM spread UNION ALL "
    + " UNION ALL ".join(f"SELECT '{f}', round(var_{f}, 5) FROM spread" for f in FACTORS)))
def m9_variances(st):
    _, fit = mixed_fit(st)
    rows = [("residual", float(fit.residual_var)), *[(f, float(v)) for f, v in fit.effect_vars.items()]]
    return st.spark.createDataFrame(rows, "part string, variance double").withColumn("variance", F.round("variance", 5))


CELLS_SQL = """ SELECT ratee, trait, effect FROM effects JOIN (SELECT DISTINCT ratee, trait, k1 AS id FROM cells) USING (id)"""


@query("m9_two_responses", f"""
SELECT ratee, trait, round(x.effect, 5) AS effect_score, round(y.effect, 4) AS effect_response
FROM ({mixed_sql(CELLS_SQL)}) x JOIN ({mixed_sql(CELLS_SQL, RESPONSE, 4)}) y USING (ratee, trait)""")
def m9_two(st):
    """What each (person, trait) adds to two responses, each free of its raters, classes and covariates."""
    rows = st.ratings.filter("score IS NOT NULL").select(
        "rater", "ratee", "trait", "grp", "tax", F.col("score").cast("double").alias("score"), F.expr(RESPONSE).cast("double").alias("response"))
    first, second = (fit.effects["cell"] for fit in mixed.fit_responses(rows, ["score", "response"], ["tax"], FACTORS, tolerance=1e-8))
    second = second.select("ratee", "trait", F.round("effect", 4).alias("effect_response"))
    return joins.left_on(first.select("ratee", "trait", F.round("effect", 5).alias("effect_score")), second, ["ratee", "trait"])


def strengths_in(st):
    return st.person_scores.select("grp", "person", "trait", (F.col("theta") / 10).alias("theta"))


@query("m10_choice_log_likelihood", f"""
WITH {CHOICE_SQL}, s AS (SELECT m.nominator, m.trait, m.rank, m.nominee, bool_or(m.person = m.nominee) AS known,
    max(CASE WHEN m.person = m.nominee THEN p.theta / 10 END) - ln(sum(exp(p.theta / 10))) AS ll
  FROM members m JOIN person_scores p ON p.person = m.person AND p.trait = m.trait AND p.grp = m.grp GROUP BY ALL)
SELECT p.nominator, p.trait, p.rank, round(ll, 6) AS log_lik FROM picks p
LEFT JOIN s ON s.nominator = p.nominator AND s.trait = p.trait AND s.rank = p.rank AND known""")
def m10(st):
    out = log_likelihood(sets(st), strengths_in(st))
    return rounded(out.select("nominator", "trait", "rank", "log_lik"), "log_lik")


MM_STEPS = 60  # of the SQL alone: well past the point where the fit stops by itself


def strength_sql() -> str:
    ctes = [CHOICE_SQL, """live AS (SELECT * FROM members WHERE (nominator, trait, rank) IN (
        SELECT (nominator, trait, rank) FROM members WHERE person = nominee))""",
            "cells AS (SELECT r.grp, r.person, t.trait FROM roster r JOIN (SELECT DISTINCT grp, trait FROM picks) t ON t.grp = r.grp)",
            """w0 AS (SELECT c.*, coalesce(n, 0) AS wins, 1.0::DOUBLE AS w FROM cells c LEFT JOIN (
        SELECT grp, trait, person, count(*) AS n FROM live WHERE person = nominee GROUP BY ALL) USING (grp, trait, person))"""]
    for t in range(1, MM_STEPS + 1):
        ctes.append(f"""i{t} AS MATERIALIZED (SELECT l.grp, l.trait, l.person,
          1 / sum(w) OVER (PARTITION BY nominator, l.trait, rank) AS inv
          FROM live l JOIN (SELECT grp, trait, person, w / avg(w) OVER (PARTITION BY grp, trait) AS w FROM w{t - 1}) v ON v.grp = l.grp AND v.trait = l.trait AND v.person = l.person)""")
        ctes.append(f"""w{t} AS MATERIALIZED (SELECT grp, person, trait, wins, (wins + 1) / (coalesce(faced, 0) + 1) AS w FROM w{t - 1}
          LEFT JOIN (SELECT grp, trait, person, sum(inv) AS faced FROM i{t} GROUP BY ALL) USING (grp, trait, person))""")
    return ",\n".join(ctes)


@query("m11_choice_strengths", f"""
WITH {strength_sql()} SELECT grp, person, trait, CAST(wins AS DOUBLE) AS wins, round(ln(w), 4) AS theta, true AS converged
FROM w{MM_STEPS}""")
def m11(st):
    return fit_strengths(sets(st), st.roster).withColumn("theta", F.round("theta", 4)).drop("steps")


@query("m11_correlated_strengths")
def m11_correlated(st):
    """Strengths under a prior in which traits go together as the people's scores do."""
    prior = covariance.trait_correlations(score_matrix(st), TRAITS)
    return fit_correlated_strengths(sets(st), st.roster, TRAITS, prior)


def rating_facts(st):
    return st.ratings.filter("score IS NOT NULL").select("rater", "ratee", "trait", F.col("score").cast("int").alias("y"))


@query("m12_ordinal_log_likelihood", """
WITH f AS (SELECT rater, CAST(score AS INT) AS y, theta / 10 AS theta,
    [-1.5 + (rater % 5) / 10, -0.5, 0.5 + (rater % 3) / 10, 1.5] AS cuts
  FROM ratings r LEFT JOIN person_scores p ON p.person = r.ratee AND p.trait = r.trait WHERE score IS NOT NULL)
SELECT rater, round(sum(ln(CASE WHEN y = 5 THEN 1 ELSE 1 / (1 + exp(theta - cuts[y])) END
  - CASE WHEN y = 1 THEN 0 ELSE 1 / (1 + exp(theta - cuts[y - 1])) END)), 6) AS log_lik FROM f GROUP BY rater""")
def m12(st):
    facts = rating_facts(st)
    known = st.person_scores.select(F.col("person").alias("ratee"), "trait", (F.col("theta") / 10).alias("theta"))
    cuts = facts.select("rater").distinct().withColumn("cuts", F.array(
        F.lit(-1.5) + (F.col("rater") % 5) / 10, F.lit(-0.5), F.lit(0.5) + (F.col("rater") % 3) / 10, F.lit(1.5)))
    out = ordinal.log_likelihood(facts, known, cuts, ["ratee", "trait"], ["rater"])
    return out.groupBy("rater").agg(F.round(F.sum("log_lik"), 6).alias("log_lik"))


NEWTON_STEPS = 3


def ordinal_sql(facts: str, score_key: list[str], cut_key: list[str], levels: int, steps: int, tag: str = "") -> str:
    """The alternating Newton steps written out one by one; ``facts`` yields keys and y."""
    sk, ckey = ", ".join(score_key), ", ".join(cut_key)
    keys = ", ".join(dict.fromkeys([*score_key, *cut_key]))
    ctes = [f"f{tag} AS (SELECT {keys}, y, count(*) AS n FROM ({facts}) GROUP BY ALL)"]
    shares = ", ".join(f"(sum(CASE WHEN y <= {k} THEN n ELSE 0 END) + 0.5) / (sum(n) + 1.0) AS s{k}" for k in range(1, levels))
    ctes.append(f"s{tag} AS (SELECT {shares} FROM f{tag})")
    prev = "ln(s1 / (1 - s1))"
    starts = [f"{prev} AS c1"]
    for k in range(2, levels):
        starts.append(f"greatest(ln(s{k} / (1 - s{k})), c{k - 1} + 0.001) AS c{k}")
    ctes.append(f"g{tag} AS (SELECT {', '.join(starts)} FROM s{tag})")
    ctes.append(f"th{tag}_0 AS (SELECT DISTINCT {sk}, 0.0::DOUBLE AS theta FROM f{tag})")
    ctes.append(f"cut{tag}_0 AS (SELECT k.*, [{', '.join(f'g{tag}.c{k}' for k in range(1, levels))}] AS cuts "
                f"FROM (SELECT DISTINCT {ckey} FROM f{tag}) k CROSS JOIN g{tag})")

    def cell(theta, cuts):
        return f"""(SELECT *, CASE WHEN y = {levels} THEN 1 ELSE 1 / (1 + exp(theta - cuts[y])) END AS up,
          CASE WHEN y = 1 THEN 0 ELSE 1 / (1 + exp(theta - cuts[y - 1])) END AS lo
          FROM f{tag} JOIN {theta} USING ({sk}) JOIN {cuts} USING ({ckey}))"""

    for i in range(1, steps + 1):
        ctes.append(f"""th{tag}_{i} AS (SELECT {sk}, theta + (grad - theta) / (info + 1) AS theta FROM th{tag}_{i - 1} JOIN (
          SELECT {sk}, sum(n * (up + lo - 1)) AS grad, sum(n * (up * (1 - up) + lo * (1 - lo))) AS info
          FROM {cell(f'th{tag}_{i - 1}', f'cut{tag}_{i - 1}')} GROUP BY ALL) USING ({sk}))""")
        sums = []
        for k in range(1, levels):
            sums.append(f"sum(CASE WHEN y = {k} THEN n * fu WHEN y = {k + 1} THEN -n * fl ELSE 0 END) AS g{k}")
            sums.append(f"sum(CASE WHEN y = {k} THEN n * (fu * fu - fu * (1 - 2 * up)) WHEN y = {k + 1} "
                        f"THEN n * (fl * fl + fl * (1 - 2 * lo)) ELSE 0 END) AS h{k}")
        ctes.append(f"""m{tag}{i} AS (SELECT {ckey}, {', '.join(sums)} FROM (
          SELECT *, up * (1 - up) / (up - lo) AS fu, lo * (1 - lo) / (up - lo) AS fl
          FROM {cell(f'th{tag}_{i}', f'cut{tag}_{i - 1}')}) GROUP BY {ckey})""")
        news = []
        for k in range(1, levels):
            new = f"cuts[{k}] + 0.5 * (g{k} - cuts[{k}] / 4) / (h{k} + 0.25)"
            news.append(f"{new} AS c1" if k == 1 else f"greatest({new}, c{k - 1} + 0.001) AS c{k}")
        ctes.append(f"""cut{tag}_{i} AS (SELECT {ckey}, [{', '.join(f'c{k}' for k in range(1, levels))}] AS cuts FROM (
          SELECT {ckey}, {', '.join(news)} FROM cut{tag}_{i - 1} JOIN m{tag}{i} USING ({ckey})))""")
    return ",\n".join(c.replace(" AS (", " AS MATERIALIZED (", 1) for c in ctes)


RATING_FACTS_SQL = "SELECT rater, ratee, trait, CAST(score AS INT) AS y FROM ratings WHERE score IS NOT NULL"


@query("m13_rater_adjusted_scores", "WITH " + ordinal_sql(
    RATING_FACTS_SQL, ["ratee", "trait"], ["rater"], 5, NEWTON_STEPS)
    + f" SELECT ratee, trait, round(theta, 6) AS theta FROM th_{NEWTON_STEPS}")
def m13(st):
    found, _ = ordinal.fit_scores(rating_facts(st), 5, ["ratee", "trait"], ["rater"], NEWTON_STEPS)
    return rounded(found, "theta")


@query("m13_cut_points", "WITH " + ordinal_sql(
    RATING_FACTS_SQL, ["ratee", "trait"], ["rater"], 5, NEWTON_STEPS)
    + f" SELECT rater, {', '.join(f'round(cuts[{k}], 6) AS c{k}' for k in range(1, 5))} FROM cut_{NEWTON_STEPS}")
def m13_cuts(st):
    _, cuts = ordinal.fit_scores(rating_facts(st), 5, ["ratee", "trait"], ["rater"], NEWTON_STEPS)
    return cuts.select("rater", *[F.round(F.get("cuts", F.lit(k - 1)), 6).alias(f"c{k}") for k in range(1, 5)])


@query("m13_posterior_scores")
def m13_mode(st):
    """Scores at the posterior mode with standard errors; ``converged`` says that the gradient is 0 everywhere."""
    fit = ordinal_mode.fit_mode(rating_facts(st), 5, ["ratee", "trait"], ["rater"])
    return fit.scores.withColumns({"steps": F.lit(fit.steps), "converged": F.lit(fit.converged)})


@query("m13_posterior_cut_points")
def m13_mode_cuts(st):
    """Cut points of the classes' teachers at the posterior mode, beside the number of their marks."""
    marks = teacher_long(st).filter("teacher_raw > 0").select("name", "trait", "grp", F.col("teacher_raw").cast("int").alias("y"))
    fit = ordinal_mode.fit_mode(marks, 5, ["name", "trait"], ["grp"])
    cuts = [F.get("cuts", F.lit(k - 1)).alias(f"c{k}") for k in range(1, 5)]
    return fit.cuts.select("grp", *cuts, "n", F.lit(fit.converged).alias("converged"))


@query("m13_correlated_scores")
def m13_correlated(st):
    """Scores of all traits of every rated person at the mode; traits inform each other through the prior."""
    prior = (TRAITS, covariance.trait_correlations(score_matrix(st), TRAITS))
    fit = ordinal_mode.fit_mode(rating_facts(st), 5, ["ratee", "trait"], ["rater"], trait="trait", covariance=prior)
    return fit.scores.withColumns({"steps": F.lit(fit.steps), "converged": F.lit(fit.converged)})


def score_matrix(st):
    return reshape.to_wide(st.person_scores, ["person", "grp"], "trait", "theta", TRAITS)


@query("m14_covariance_composition", """
WITH pairs AS (SELECT a.grp, a.person, a.trait AS trait_i, b.trait AS trait_j, a.theta AS x, b.theta AS y
  FROM person_scores a JOIN person_scores b ON a.person = b.person AND a.trait <= b.trait),
om AS (SELECT trait_i, trait_j, corr(x, y) AS omega FROM pairs GROUP BY ALL),
og AS (SELECT grp, trait_i, trait_j, corr(x, y) AS omega_g FROM pairs GROUP BY ALL),
tau AS (SELECT grp, trait, stddev_samp(theta) AS tau FROM person_scores GROUP BY ALL),
s AS (SELECT og.grp, og.trait_i, og.trait_j, a.tau * b.tau * (0.6 * omega + 0.4 * omega_g) AS sigma FROM og
  JOIN om USING (trait_i, trait_j) JOIN tau a ON a.grp = og.grp AND a.trait = trait_i JOIN tau b ON b.grp = og.grp AND b.trait = trait_j)
SELECT grp, trait_i, trait_j, CASE WHEN NOT isnan(sigma) THEN round(sigma, 6) END AS sigma FROM s""")
def m14(st):
    wide = score_matrix(st)
    specific = covariance.pair_statistics(wide, TRAITS, ["grp"], correlation, "omega_g")
    common = covariance.pair_statistics(wide, TRAITS, [], correlation, "omega")
    taus = st.person_scores.groupBy("grp", "trait").agg(F.stddev_samp("theta").alias("tau"))
    return rounded(covariance.compose(common, specific, taus, 0.6), "sigma")


@query("m15_variance_explained")
def m15(st):
    pairs = covariance.pair_statistics(score_matrix(st), TRAITS, ["grp"])
    return covariance.variance_explained(pairs, TRAITS, ["grp"])


@query("m16_combined_ground_truth", f"""
SELECT person, grp, trait, round({z_sql('student_theta + teacher_theta', 'trait, grp')}, 6) AS ground_truth FROM person_scores""")
def m16(st):
    out = scores.combined_score(st.person_scores, ["trait", "grp"])
    return rounded(out.select("person", "grp", "trait", "ground_truth"), "ground_truth")


TEACHER_FACTS_SQL = """SELECT name, trait, grp, CAST(teacher_raw AS INT) AS y FROM teacher_long
  WHERE teacher_raw > 0 AND trait IN (SELECT trait FROM nominations)"""


@query("m17_joint_scores", f"""
WITH {strength_sql()}, {ordinal_sql(TEACHER_FACTS_SQL, ['name', 'trait'], ['grp'], 5, NEWTON_STEPS, 'q')},
joined_scores AS (SELECT w.person, w.grp, w.trait, ln(w.w) AS student_theta, q.theta AS teacher_theta FROM w{MM_STEPS} w
  JOIN roster r ON r.person = w.person LEFT JOIN thq_{NEWTON_STEPS} q ON q.name = r.name AND q.trait = w.trait),
z AS (SELECT *, {z_sql('student_theta', 'trait, grp')} AS zs, {z_sql('teacher_theta', 'trait, grp')} AS zt FROM joined_scores)
SELECT person, grp, trait, round(zs, 5) AS student_theta, round(zt, 5) AS teacher_theta,
  round({z_sql('round(zs + zt, 9)', 'trait, grp')}, 5) AS ground_truth FROM z""")
def m17(st):
    """Choice strengths and teacher scores, each scaled in its class, then combined."""
    strengths = fit_strengths(sets(st), st.roster).select(
        "person", "grp", "trait", F.col("theta").alias("student_theta"))
    marks = teacher_long(st).filter("teacher_raw > 0").select(
        "name", "trait", "grp", F.col("teacher_raw").cast("int").alias("y"))
    marks = joins.keep_known(marks, st.nominations.select("trait"), ["trait"])
    found, _ = ordinal.fit_scores(marks, 5, ["name", "trait"], ["grp"], NEWTON_STEPS)
    people = joins.left_on(strengths, st.roster.select("person", "name"), ["person"])
    both = joins.left_on(people, found.withColumnRenamed("theta", "teacher_theta"), ["name", "trait"])
    scaled = grouped.zscore(both, ["student_theta", "teacher_theta"], ["trait", "grp"])
    out = scores.combined_score(scaled, ["trait", "grp"]).select(
        "person", "grp", "trait", "student_theta", "teacher_theta", "ground_truth")
    return out.withColumns({c: F.round(c, 5) for c in ("student_theta", "teacher_theta", "ground_truth")})
