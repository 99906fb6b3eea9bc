"""Choice sets for ranked nominations, kept in factored form.

A nominator picks from everyone in the group, minus the earlier picks. Writing the
set out takes (choices x group size) rows, which no cluster can hold when a group
has a third of all people. A set is therefore stored as its group and the one or
two people taken out, and every sum over a set is the group's sum minus theirs:
exact, and linear in choices plus people. Sums of exponentials keep the group's two
strongest members apart, so that taking one out never cancels the rest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.operators.grouped import attach, first_rows
from scoreframe.operators.joins import left_on
from scoreframe.operators.ordered import number_rows, running_sum
from scoreframe.session import cut_lineage

CHOICE = ["nominator", "trait", "rank"]
GROUP = ["grp", "trait"]
SPREAD = 1024


def index_roster(roster: DataFrame) -> DataFrame:
    """(grp, person, name) with a 1-based index by sorted name."""
    return number_rows(roster, ["name", "grp", "person"], "student_index")


def choice_sets(nominations: DataFrame, roster: DataFrame, order: list[str],
                apply_exclusions: bool = True) -> DataFrame:
    """One row per choice: winner, people taken out of the group, size of the set.

    ``nominations``: (nominator, trait, rank, grp, nominee, *order*); the first row
    per (nominator, trait, rank) counts. ``out_1``/``out_2`` hold the earlier picks
    that are members of the group, so the set is the roster of ``grp`` without them.
    """
    picks = first_rows(nominations, CHOICE, order).select(*CHOICE, "grp", "nominee")
    rank = F.col("rank")
    picks = attach(picks, ["nominator", "trait"],
                   first_pick=F.max(F.when(rank == 1, F.col("nominee"))),
                   second_pick=F.max(F.when(rank == 2, F.col("nominee"))))
    if apply_exclusions:
        picks = picks.withColumns({
            "out_1": F.when(rank.isin(2, 3), F.col("first_pick")),
            "out_2": F.when(rank == 3, F.col("second_pick")),
        })
        same = F.col("out_1") == F.col("out_2")
        picks = picks.withColumn("out_2", F.when(same, F.lit(None)).otherwise(F.col("out_2")))
    else:
        none = F.lit(None).cast(dict(picks.dtypes)["nominee"])
        picks = picks.withColumns({"out_1": none, "out_2": none})
    members = cut_lineage(roster.select("grp", "person", F.lit(True).alias("in_grp")))
    picks = _look_up(picks, members, ["grp"], "nominee", "in_grp", "winner_known")
    for c in ("out_1", "out_2"):
        picks = _look_up(picks, members, ["grp"], c, "in_grp", f"{c}_known")
        picks = picks.withColumn(c, F.when(F.col(f"{c}_known"), F.col(c)))
    sizes = cut_lineage(members.groupBy("grp").agg(F.count(F.lit(1)).alias("grp_size")))
    picks = left_on(picks, sizes, ["grp"])
    taken = F.col("out_1").isNotNull().cast("int") + F.col("out_2").isNotNull().cast("int")
    inside = (
        F.coalesce("winner_known", F.lit(False))
        & ~F.coalesce(F.col("nominee") == F.col("out_1"), F.lit(False))
        & ~F.coalesce(F.col("nominee") == F.col("out_2"), F.lit(False))
    )
    return picks.select(
        *CHOICE, "grp", "nominee", "out_1", "out_2",
        (F.coalesce("grp_size", F.lit(0)) - taken).alias("set_size"),
        inside.alias("winner_in_set"),
    )


def slice_bounds(sets: DataFrame) -> DataFrame:
    """First and last row of each set in the flattened list of all sets; empty sets have none."""
    flat = running_sum(sets.filter("set_size > 0"), [], CHOICE, "set_size", "possibles_upper")
    return flat.withColumn("possibles_lower", F.col("possibles_upper") - F.col("set_size") + 1)


def _look_up(df: DataFrame, table: DataFrame, keys: list[str], person: str, value: str, out: str) -> DataFrame:
    """``value`` of ``person`` as ``out``. Rows without a person meet nothing, so they are spread out."""
    other = F.when(F.col(person).isNull(), 1 + F.pmod(F.xxhash64(*df.columns), F.lit(SPREAD))).otherwise(F.lit(0))
    known = table.select(*keys, F.col("person").alias("__person"), F.col(value).alias(out), F.lit(0).cast("bigint").alias("__none"))
    found = left_on(df.withColumn("__spread", other.cast("bigint")), known, [*keys, (person, "__person"), ("__spread", "__none")])
    return found.drop("__spread")


def _parts(strengths: DataFrame) -> DataFrame:
    """Per group: the two strongest members, and the largest strength and scaled sum of the others."""
    best = F.max(F.struct("theta", "person"))
    first = cut_lineage(strengths.groupBy(*GROUP).agg(best.alias("top_1"), F.count(F.lit(1)).alias("members")))
    below = left_on(strengths, first, GROUP).filter("person <> top_1.person")
    second = cut_lineage(below.groupBy(*GROUP).agg(best.alias("top_2")))
    others = left_on(below, second, GROUP).filter("person <> top_2.person")
    shift = others.groupBy(*GROUP).agg(F.max("theta").alias("shift"))
    rest = left_on(others, shift, GROUP).groupBy(*GROUP, "shift").agg(F.sum(F.exp(F.col("theta") - F.col("shift"))).alias("rest"))
    return cut_lineage(left_on(left_on(first, second, GROUP), rest, GROUP))


def _log_sum(in_1: Column, in_2: Column, rest: Column) -> Column:
    """Log of the summed exponentials of the two strongest members, where in, and of ``rest``."""
    terms = [F.when(in_1, F.col("top_1.theta")), F.when(in_2, F.col("top_2.theta")), F.when(rest > 0, F.col("shift") + F.log(rest))]
    top = F.greatest(*terms)
    total = F.lit(0.0)
    for term in terms:
        total = total + F.coalesce(F.exp(term - top), F.lit(0.0))
    return top + F.log(total)


def _with_set_sum(sets: DataFrame, strengths: DataFrame, parts: DataFrame) -> DataFrame:
    """Adds ``in_1``, ``in_2`` (are the strongest members in the set?) and ``log_sum`` over the set.

    Someone taken out of the others leaves a stronger member in the set, so the
    subtraction costs no precision; if both strongest are out, nothing is subtracted.
    """
    out = left_on(sets, parts, GROUP)
    for c in ("out_1", "out_2"):
        out = _look_up(out, strengths, GROUP, c, "theta", f"{c}_theta")

    def stays(top: str) -> Column:
        person = F.col(f"{top}.person")
        gone = F.coalesce(F.col("out_1") == person, F.lit(False)) | F.coalesce(F.col("out_2") == person, F.lit(False))
        return person.isNotNull() & ~gone

    def removed(c: str) -> Column:
        top = (F.col(c) == F.col("top_1.person")) | F.coalesce(F.col(c) == F.col("top_2.person"), F.lit(False))
        return F.coalesce(F.when(~top, F.exp(F.col(f"{c}_theta") - F.col("shift"))), F.lit(0.0))

    out = out.withColumns({"in_1": stays("top_1"), "in_2": stays("top_2")})
    rest = F.coalesce(F.col("rest"), F.lit(0.0)) - removed("out_1") - removed("out_2")
    return out.withColumn("log_sum", _log_sum(F.col("in_1"), F.col("in_2"), rest)).drop("out_1_theta", "out_2_theta", "rest", "members")


def log_likelihood(sets: DataFrame, strengths: DataFrame) -> DataFrame:
    """Per choice: strength of the winner minus logsumexp over the set.

    ``strengths``: (grp, person, trait, theta). A winner outside the set, or without a
    strength, scores NULL.
    """
    known = cut_lineage(strengths.filter("theta IS NOT NULL").select(*GROUP, "person", F.col("theta").cast("double").alias("theta")))
    out = _with_set_sum(sets, known, _parts(known))
    out = _look_up(out, known, GROUP, "nominee", "theta", "theta")
    value = F.when(F.col("winner_in_set"), F.col("theta") - F.col("log_sum"))
    return out.select(*sets.columns, value.alias("log_lik"))


def fit_strengths(sets: DataFrame, roster: DataFrame, max_steps: int = 500, shape: float = 2.0,
                  rate: float = 1.0, tolerance: float = 1e-9) -> DataFrame:
    """Choice-model strengths by minorise-maximise steps with a gamma prior (``shape`` above 1).

    Steps go on until no strength moves by more than ``tolerance``; ``steps`` and
    ``converged`` report how that ended. Equal (group, trait, people taken out) are
    collapsed to counts once, so a step costs that many rows and not one per choice.
    """
    sets = cut_lineage(sets)
    valid = sets.filter("winner_in_set")
    wins = valid.groupBy("grp", "trait", F.col("nominee").alias("person")).agg(
        F.count(F.lit(1)).cast("double").alias("wins")
    )
    patterns = cut_lineage(
        valid.groupBy("grp", "trait", "out_1", "out_2").agg(F.count(F.lit(1)).alias("n"))
    )
    traits = sets.select("grp", "trait").distinct()
    people = roster.select("grp", "person").join(traits, "grp")
    people = left_on(people, wins, ["grp", "trait", "person"])
    state = cut_lineage(people.select(
        "grp", "trait", "person", F.coalesce("wins", F.lit(0.0)).alias("wins"), F.lit(0.0).alias("theta")
    ))
    steps, converged = 0, False
    while steps < max_steps and not converged:
        state = cut_lineage(_strength_step(state, patterns, shape, rate))
        move = state.agg(F.max("move")).first()[0]
        steps, converged = steps + 1, move is None or move <= tolerance
    return state.select("grp", "trait", "person", "wins", "theta",
                        F.lit(steps).alias("steps"), F.lit(converged).alias("converged"))


def _faced(state: DataFrame, patterns: DataFrame, parts: DataFrame) -> DataFrame:
    """Adds ``scale`` and ``faced``: the inverse set sums, over exp(scale), of the sets a member is in."""
    p = _with_set_sum(patterns, state, parts)
    p = p.withColumn("inv", F.col("n") * F.exp(-F.col("log_sum") - F.col("scale")))
    faced_by = p.groupBy(*GROUP).agg(
        F.sum("inv").alias("inv_all"), F.sum(F.when(F.col("in_1"), F.col("inv"))).alias("inv_1"),
        F.sum(F.when(F.col("in_2"), F.col("inv"))).alias("inv_2"))
    absent = p.select("grp", "trait", F.explode(F.array("out_1", "out_2")).alias("person"), "inv")
    absent = absent.filter("person IS NOT NULL").groupBy("grp", "trait", "person").agg(
        F.sum("inv").alias("inv_out")
    )
    s = left_on(left_on(state, parts.select(*GROUP, "top_1", "top_2", "scale"), GROUP), faced_by, GROUP)
    s = left_on(s, absent, ["grp", "trait", "person"])
    none = F.lit(0.0)
    faced = (F.when(F.col("person") == F.col("top_1.person"), F.coalesce("inv_1", none))
             .when(F.col("person") == F.col("top_2.person"), F.coalesce("inv_2", none))
             .otherwise(F.greatest(F.coalesce("inv_all", none) - F.coalesce("inv_out", none), none)))
    return s.select(*state.columns, "scale", faced.alias("faced"))


def _strength_step(state: DataFrame, patterns: DataFrame, shape: float, rate: float) -> DataFrame:
    """One step: the best common scale of a group under the prior, then each member's strength."""
    parts = _parts(state)
    everyone = _log_sum(F.lit(True), F.col("top_2").isNotNull(), F.coalesce("rest", F.lit(0.0)))
    parts = parts.withColumn("scale", F.log(F.col("members") * ((shape - 1.0) / rate)) - everyone)
    s = _faced(state, patterns, parts)
    new = F.log((F.col("wins") + (shape - 1.0)) / (F.col("faced") + F.lit(float(rate))))
    return s.select("grp", "trait", "person", "wins", new.alias("theta"),
                    F.abs(new - F.col("theta") - F.col("scale")).alias("move"))


def _person_modes(precision: np.ndarray):
    """Batch function: each person's best scores of all traits while the sets' sums stay as they are.

    The height w theta - f exp(theta) - theta' P theta / 2 is concave; Newton steps on the
    traits together are halved where they would lead down.
    """
    def height(theta, wins, faced):
        with np.errstate(over="ignore"):
            return (wins * theta - faced * np.exp(theta)).sum(1) - 0.5 * np.einsum("bi,ij,bj->b", theta, precision, theta)

    def solve(batches):
        for pdf in batches:
            theta, wins, faced = (np.array(pdf[c].tolist(), dtype=float).reshape(-1, len(precision)) for c in ("theta", "wins", "faced"))
            slope = wins - faced * np.exp(theta) - theta @ precision
            pdf["gradient"] = list(slope)
            best = height(theta, wins, faced)
            for _ in range(100):
                pull = faced * np.exp(theta)
                curve = precision + pull[:, :, None] * np.eye(len(precision))
                step = np.linalg.solve(curve, (wins - pull - theta @ precision)[:, :, None])[:, :, 0]
                t = np.ones(len(theta))
                new = height(theta + step, wins, faced)
                while (worse := ~(new >= best - 1e-12 * np.abs(best))).any() and t.min() > 1e-9:
                    t[worse] /= 2
                    new = height(theta + t[:, None] * step, wins, faced)
                theta, best = theta + t[:, None] * step, np.maximum(new, best)
                if not len(step) or np.abs(step).max() < 1e-12:
                    break
            pdf["moved"] = list(theta)
            yield pdf[["grp", "person", "wins", "theta", "moved", "gradient"]]

    return solve


def fit_correlated_strengths(sets: DataFrame, roster: DataFrame, traits: list[str], covariance: np.ndarray,
                             max_steps: int = 500, tolerance: float = 1e-6) -> DataFrame:
    """Choice-model strengths under a normal prior in which a person's traits vary together.

    ``covariance`` is that of ``traits`` and must be positive definite. Each step bounds the
    log sums from below at the present strengths, as ``fit_strengths`` does, which leaves one
    small problem for each person: all traits at once, coupled by the prior; then each group's
    mean is set to 0, the best common shift. A trait without
    choices in a person's group is told from the person's other traits. Steps go on until no
    entry of the posterior's gradient is larger than ``tolerance``; ``gradient``, ``steps``
    and ``converged`` report it.
    """
    covariance = np.asarray(covariance, dtype=float)
    if covariance.shape != (len(traits), len(traits)) or not np.allclose(covariance, covariance.T) or np.linalg.eigvalsh(covariance)[0] <= 0:
        raise ValueError("needs a symmetric positive definite matrix with a row for each trait")
    solve = _person_modes(np.linalg.inv(covariance))
    valid = cut_lineage(sets.filter("winner_in_set").filter(F.col("trait").isin(list(traits))))
    wins = valid.groupBy(*GROUP, F.col("nominee").alias("person")).agg(F.count(F.lit(1)).cast("double").alias("wins"))
    patterns = cut_lineage(valid.groupBy(*GROUP, "out_1", "out_2").agg(F.count(F.lit(1)).alias("n")))
    people = roster.select("grp", "person").withColumn("trait", F.explode(F.array(*[F.lit(t) for t in traits])))
    people = left_on(people, wins, [*GROUP, "person"])
    state = cut_lineage(people.select(*GROUP, "person", F.coalesce("wins", F.lit(0.0)).alias("wins"), F.lit(0.0).alias("theta")))
    kinds = dict(state.dtypes)
    schema = (f"grp {kinds['grp']}, person {kinds['person']}, wins array<double>, theta array<double>, "
              "moved array<double>, gradient array<double>")

    def vector(c: str) -> Column:
        return F.array(*[F.max(F.when(F.col("trait") == t, F.col(c))) for t in traits]).alias(c)

    names, steps = F.array(*[F.lit(t) for t in traits]), 0
    while True:
        met = _faced(state, patterns, _parts(state).withColumn("scale", F.lit(0.0)))
        wide = met.groupBy("grp", "person").agg(*[vector(c) for c in ("wins", "theta", "faced")])
        table = cut_lineage(wide.mapInPandas(solve, schema))
        gradient = table.agg(F.max(F.array_max(F.transform("gradient", lambda g: F.abs(g))))).first()[0] or 0.0
        converged = gradient <= tolerance
        long = table.select("grp", "person", F.explode(F.arrays_zip(names.alias("trait"), "wins", "theta", "moved")).alias("v"))
        if converged or steps >= max_steps:
            return long.select("grp", "v.trait", "person", "v.wins", "v.theta", F.lit(float(gradient)).alias("gradient"),
                               F.lit(steps).alias("steps"), F.lit(converged).alias("converged"))
        # a common shift of a group changes no choice, so the prior alone sets it: to mean 0
        moved = long.select("grp", "v.trait", "person", "v.wins", F.col("v.moved").alias("theta"))
        state = cut_lineage(attach(moved, GROUP, __mean=F.avg("theta")).withColumn("theta", F.col("theta") - F.col("__mean")).drop("__mean"))
        steps += 1


def nomination_counts(nominations: DataFrame, by: list[str]) -> DataFrame:
    return nominations.groupBy(*by).agg(F.count(F.lit(1)).alias("n_nominations"))
