"""Ordinal ratings with rater-specific cut points: likelihood and MAP scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.operators.joins import left_on
from scoreframe.session import cut_lineage

MIN_GAP = 0.001


def _logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _cell_columns(df: DataFrame) -> DataFrame:
    """Upper and lower cumulative probabilities of the mark ``y`` given ``cuts``."""
    theta = F.col("theta")
    upper = F.get("cuts", F.col("y") - 1)
    lower = F.get("cuts", F.col("y") - 2)
    return df.withColumns({
        "up": F.when(upper.isNull(), F.lit(1.0)).otherwise(_logistic(upper - theta)),
        "lo": F.when(lower.isNull(), F.lit(0.0)).otherwise(_logistic(lower - theta)),
    })


def _log_logistic(x: Column) -> Column:
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def _log_cell() -> Column:
    """Log probability of the mark ``y``: finite for any finite score and increasing cuts.

    logistic(a) - logistic(b) = logistic(a) * logistic(-b) * (1 - exp(b - a)).
    """
    upper = F.get("cuts", F.col("y") - 1) - F.col("theta")
    lower = F.get("cuts", F.col("y") - 2) - F.col("theta")
    none = F.lit(0.0)
    known = F.col("theta").isNotNull() & F.col("cuts").isNotNull() & F.col("y").isNotNull()
    return F.when(known, F.coalesce(_log_logistic(upper), none) + F.coalesce(_log_logistic(-lower), none)
                  + F.coalesce(F.log(-F.expm1(lower - upper)), none))


def log_likelihood(facts: DataFrame, scores: DataFrame, cuts: DataFrame,
                   score_key: list[str], cut_key: list[str]) -> DataFrame:
    """Adds ``log_lik`` of each mark ``y`` in 1..K.

    ``scores`` holds ``theta`` by ``score_key``; ``cuts`` an increasing array of
    K - 1 cut points by ``cut_key`` (a rater, or a group).
    """
    joined = left_on(left_on(facts, scores, score_key), cuts, cut_key)
    return joined.withColumn("log_lik", _log_cell()).drop("theta", "cuts")


def starting_values(facts: DataFrame, levels: int) -> list[float]:
    """Pooled cumulative logits, kept apart (``levels`` - 1 numbers)."""
    sums = [F.sum((F.col("y") <= k).cast("double") * F.col("n")).alias(f"c{k}") for k in range(1, levels)]
    row = facts.agg(F.sum("n").alias("n"), *sums).first()
    import math

    shares = [(row[f"c{k}"] + 0.5) / (row["n"] + 1.0) for k in range(1, levels)]
    start = [math.log(s / (1.0 - s)) for s in shares]
    for k in range(1, len(start)):
        start[k] = max(start[k], start[k - 1] + MIN_GAP)
    return start


def starting_cuts(facts: DataFrame, levels: int) -> Column:
    """The starting values as one array literal."""
    return F.array(*[F.lit(c) for c in starting_values(facts, levels)])


def fit_scores(facts: DataFrame, levels: int, score_key: list[str], cut_key: list[str],
               iterations: int = 10) -> tuple[DataFrame, DataFrame]:
    """MAP scores (prior N(0,1)) and cut points (prior N(0,2)), alternating Newton steps.

    Equal marks are counted once up front; each half step is two joins and one
    partially aggregated sum. Cut points take a half-length step, because each pulls
    on its neighbours, and are then kept increasing.
    """
    keys = list(dict.fromkeys([*score_key, *cut_key]))
    counts = cut_lineage(facts.filter("y IS NOT NULL").groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("n")))
    scores = cut_lineage(counts.select(*score_key).distinct().withColumn("theta", F.lit(0.0)))
    cuts = cut_lineage(counts.select(*cut_key).distinct().withColumn("cuts", starting_cuts(counts, levels)))
    for _ in range(iterations):
        scores = cut_lineage(_score_step(counts, scores, cuts, score_key, cut_key))
        cuts = cut_lineage(_cut_step(counts, scores, cuts, score_key, cut_key, levels))
    return scores, cuts


def _cells(counts, scores, cuts, score_key, cut_key):
    return _cell_columns(left_on(left_on(counts, scores, score_key), cuts, cut_key))


def _score_step(counts, scores, cuts, score_key, cut_key) -> DataFrame:
    up, lo, n = F.col("up"), F.col("lo"), F.col("n")
    moves = _cells(counts, scores, cuts, score_key, cut_key).groupBy(*score_key).agg(
        F.sum(n * (up + lo - 1)).alias("grad"),
        F.sum(n * (up * (1 - up) + lo * (1 - lo))).alias("info"),
    )
    step = (F.col("grad") - F.col("theta")) / (F.col("info") + 1)
    return left_on(scores, moves, score_key).select(*score_key, (F.col("theta") + step).alias("theta"))


def _cut_step(counts, scores, cuts, score_key, cut_key, levels) -> DataFrame:
    up, lo, n, y = F.col("up"), F.col("lo"), F.col("n"), F.col("y")
    upper = F.get("cuts", F.col("y") - 1) - F.col("theta")
    lower = F.get("cuts", F.col("y") - 2) - F.col("theta")
    # Slopes of a bound over the mark's probability, from logs: no difference that could become 0.
    between = F.coalesce(F.log(-F.expm1(lower - upper)), F.lit(0.0))
    fu = F.exp(_log_logistic(-upper) - F.coalesce(_log_logistic(-lower), F.lit(0.0)) - between)
    fl = F.exp(_log_logistic(lower) - F.coalesce(_log_logistic(upper), F.lit(0.0)) - between)
    sums = []
    for k in range(1, levels):
        grad = F.when(y == k, n * fu).when(y == k + 1, -n * fl).otherwise(0.0)
        info = (
            F.when(y == k, n * (fu * fu - fu * (1 - 2 * up)))
            .when(y == k + 1, n * (fl * fl + fl * (1 - 2 * lo)))
            .otherwise(0.0)
        )
        sums += [F.sum(grad).alias(f"g{k}"), F.sum(info).alias(f"h{k}")]
    moves = _cells(counts, scores, cuts, score_key, cut_key).groupBy(*cut_key).agg(*sums)
    out = left_on(cuts, moves, cut_key)
    for k in range(1, levels):
        old = F.get("cuts", F.lit(k - 1))
        new = old + F.lit(0.5) * (F.col(f"g{k}") - old / 4) / (F.col(f"h{k}") + F.lit(0.25))
        if k > 1:
            new = F.greatest(new, F.col(f"c{k - 1}") + F.lit(MIN_GAP))
        out = out.withColumn(f"c{k}", new)
    return out.select(*cut_key, F.array(*[F.col(f"c{k}") for k in range(1, levels)]).alias("cuts"))


def log_posterior(counts: DataFrame, scores: DataFrame, cuts: DataFrame,
                  score_key: list[str], cut_key: list[str]) -> float:
    """Objective that ``fit_scores`` climbs (constants left out)."""
    cells = _cells(counts, scores, cuts, score_key, cut_key)
    fit = cells.agg(F.sum(F.col("n") * _log_cell())).first()[0]
    prior = scores.agg(F.sum(F.col("theta") * F.col("theta"))).first()[0]
    flat = cuts.select(F.explode("cuts").alias("c")).agg(F.sum(F.col("c") * F.col("c"))).first()[0]
    return fit - prior / 2 - flat / 8
