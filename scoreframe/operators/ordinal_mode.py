"""Posterior mode of ordinal scores and rater cut points, with standard errors of the scores.

The objective is the log likelihood of the marks with a N(0, 1) prior on scores, a N(0, 2)
prior on cut points and the logarithms of the gaps between a rater's cut points: the mode on
the scale where gaps are free, so a mark a rater never gave leaves a gap open. It is concave
in scores and cut points together, so Newton steps with halving reach its only maximum.

The second derivatives form an arrow: a number for each score, a small band matrix for each
rater, and links where a rater marked someone. A step removes the raters' blocks (each is
factored in its own row), and conjugate gradients solve what is left for the scores: a
product is two joins of the links by key with two partially aggregated sums. Nothing but
sums over the whole table reaches the driver.

A given covariance of traits replaces the N(0, 1) prior: a person's scores then share one
normal prior, a trait without marks is told from the others, and a product also reads a
row for each pair of traits of a person.

The standard error of a score comes from its own entry after the raters are removed: cut
points count as unknown, the other scores as known.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.operators import blocks
from scoreframe.operators.joins import left_on
from scoreframe.operators.ordered import number_rows
from scoreframe.operators.ordinal_blocks import PackedFit
from scoreframe.operators.ordinal import _log_cell, _log_logistic, _logistic, starting_cuts
from scoreframe.session import cut_lineage

SHORTEST = 2.0 ** -30


class ModeFit:
    """``scores`` (key, theta, sd, n), ``cuts`` (key, cuts, n), and how the fit ended."""

    def __init__(self, scores: DataFrame, cuts: DataFrame, steps: int, products: int, gradient: float, objective: float, converged: bool):
        self.scores, self.cuts, self.steps, self.products = scores, cuts, steps, products
        self.gradient, self.objective, self.converged = gradient, objective, converged


def _names(prefix: str, k: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(1, k + 1)]


def _sum(columns: list[Column]) -> Column:
    total = F.lit(0.0)
    for c in columns:
        total = total + c
    return total


def _banded(right: list[Column], lower: list[Column], pivots: list[Column]) -> list[Column]:
    """The solution of a factored symmetric matrix with one band beside the diagonal."""
    ahead = [right[0]]
    for k in range(1, len(right)):
        ahead.append(right[k] - lower[k - 1] * ahead[k - 1])
    out = [ahead[-1] / pivots[-1]]
    for k in range(len(right) - 2, -1, -1):
        out.insert(0, ahead[k] / pivots[k] - lower[k] * out[0])
    return out


def _marks(facts: DataFrame, levels: int, score_key: list[str], cut_key: list[str]) -> tuple[dict[str, str], DataFrame]:
    """The inner name of each key column, and the marks within the levels under these names."""
    inner = {c: f"__part_{i}" for i, c in enumerate(dict.fromkeys([*score_key, *cut_key]))}
    kinds = dict(facts.dtypes)
    keys = [blocks.plain(c, kinds[c]).alias(v) for c, v in inner.items()]
    return inner, facts.where(F.col("y").between(1, levels)).select(*keys, F.col("y").cast("int").alias("y"))


class _Fit:
    def __init__(self, rows: DataFrame, inner: dict[str, str], levels: int, score_key: list[str], cut_key: list[str], trait: str | None = None,
                 prior: dict | None = None):
        self.k = levels - 1
        rows = cut_lineage(rows.groupBy(*inner.values(), "y").agg(F.count(F.lit(1)).cast("double").alias("n")))
        self.keys, ids = {}, {}
        for name, own in (("s", score_key), ("r", cut_key)):
            names = [inner[c] for c in own]
            found = rows.groupBy(*names).agg(F.sum("n").alias("n"))
            if name == "s" and prior:
                found = self._completed(found, names, inner[trait], list(prior))
            table = cut_lineage(number_rows(found, names, name))
            if name == "s":
                self.pairs = self._pairs(table, names, inner[trait], prior) if prior else None
            rows = left_on(rows, table.select(*names, name), names)
            ids[name] = table.select(name)
            self.keys[name] = table.select(F.col(name).alias("__id"), *[F.col(inner[c]).alias(c) for c in own], F.col("n").cast("bigint").alias("__n"))
        self.cells = cut_lineage(rows.select("s", "r", "y", "n"))
        self.theta = ids["s"].select("s", F.lit(0.0).alias("theta"))
        self.cuts = ids["r"].select("r", starting_cuts(self.cells, levels).alias("cuts"))

    @staticmethod
    def _completed(found: DataFrame, names: list[str], trait: str, traits: list[str]) -> DataFrame:
        """Every trait of every person, with 0 marks where there are none."""
        person = [c for c in names if c != trait]
        every = found.select(*person).distinct().withColumn(trait, F.explode(F.array(*[F.lit(t) for t in traits])))
        return left_on(every, found, names).select(*names, F.coalesce("n", F.lit(0.0)).alias("n"))

    @staticmethod
    def _pairs(table: DataFrame, names: list[str], trait: str, prior: dict) -> DataFrame:
        """(s, o, w): the prior's precision between two scores of one person, their own included."""
        person = [c for c in names if c != trait]
        slots = table.groupBy(*person).agg(F.array(*[F.max(F.when(F.col(trait) == t, F.col("s"))) for t in prior]).alias("slots"))
        traits = list(prior)
        entries = [F.struct(F.get("slots", F.lit(i)).alias("s"), F.get("slots", F.lit(j)).alias("o"), F.lit(float(prior[a][b])).alias("w"))
                   for i, a in enumerate(traits) for j, b in enumerate(traits)]
        return cut_lineage(slots.select(F.explode(F.array(*entries)).alias("e")).select("e.*"))

    def _prior_product(self, vector: DataFrame) -> DataFrame:
        """(s, u): the prior's precision times a vector (s, p) of the scores."""
        if self.pairs is None:
            return vector.select("s", F.col("p").alias("u"))
        other = vector.select(F.col("s").alias("o"), "p")
        return self.pairs.join(other, "o").groupBy("s").agg(F.sum(F.col("w") * F.col("p")).alias("u"))

    def _cell(self, theta: DataFrame, cuts: DataFrame) -> DataFrame:
        return self.cells.join(theta, "s").join(cuts, "r")

    def objective(self, theta: DataFrame, cuts: DataFrame) -> float:
        """The height of the posterior, minus infinity where cut points are not increasing."""
        fit = self._cell(theta, cuts).agg(F.sum(F.col("n") * _log_cell())).first()[0]
        met = theta.join(self._prior_product(theta.select("s", F.col("theta").alias("p"))), "s")
        own = met.agg(F.sum(F.col("theta") * F.col("u"))).first()[0]
        c = [F.get("cuts", F.lit(i)) for i in range(self.k)]
        gaps = [b - a for a, b in zip(c, c[1:])]
        height = _sum([F.when(g > 0, F.log(F.when(g > 0, g))).otherwise(F.lit(-math.inf)) for g in gaps]) - _sum([x * x for x in c]) / 8
        rest = cuts.agg(F.sum(height)).first()[0]
        value = fit - own / 2 + rest
        return value if math.isfinite(value) else -math.inf

    def derivatives(self) -> tuple[DataFrame, DataFrame, DataFrame, float]:
        """Scores (s, theta, g, a), raters (r, cuts, g_i, l_i, q_i: gradient and factors), links (s, r, b_i), largest gradient."""
        up_x, lo_x = F.get("cuts", F.col("y") - 1) - F.col("theta"), F.get("cuts", F.col("y") - 2) - F.col("theta")
        up = F.coalesce(_logistic(up_x), F.lit(1.0))
        lo = F.coalesce(_logistic(lo_x), F.lit(0.0))
        between = F.coalesce(F.log(-F.expm1(lo_x - up_x)), F.lit(0.0))
        # slopes of a bound over the mark's probability, from logs: no difference that could become 0
        fu = F.coalesce(F.exp(_log_logistic(-up_x) - F.coalesce(_log_logistic(-lo_x), F.lit(0.0)) - between), F.lit(0.0))
        fl = F.coalesce(F.exp(_log_logistic(lo_x) - F.coalesce(_log_logistic(up_x), F.lit(0.0)) - between), F.lit(0.0))
        rows = self._cell(self.theta, self.cuts).select("s", "r", "y", "n", up.alias("up"), lo.alias("lo"), fu.alias("fu"), fl.alias("fl"))
        n, up, lo, fu, fl = (F.col(c) for c in ("n", "up", "lo", "fu", "fl"))
        rows = cut_lineage(rows.select(
            "s", "r", "y", (n * (up + lo - 1)).alias("g"), (n * fu).alias("gu"), (-n * fl).alias("gl"), (-n * fu * fl).alias("hm"),
            (n * fu * (fu - 1 + 2 * up)).alias("hu"), (n * fl * (fl + 1 - 2 * lo)).alias("hl"),
            (n * (up * (1 - up) + lo * (1 - lo))).alias("a")))
        scores = self.theta.join(rows.groupBy("s").agg(F.sum("g").alias("g"), F.sum("a").alias("a")), "s", "left")
        scores = scores.join(self._prior_product(self.theta.select("s", F.col("theta").alias("p"))), "s")
        own = F.lit(1.0)
        if self.pairs is not None:
            scores = scores.join(self.pairs.where("s = o").select("s", "w"), "s")
            own = F.col("w")
        none = F.lit(0.0)
        scores = cut_lineage(scores.select("s", "theta", (F.coalesce("g", none) - F.col("u")).alias("g"),
                                           (F.coalesce("a", none) + own).alias("a"), own.alias("own")))
        k, y = self.k, F.col("y")
        parts = [F.sum(F.when(y == i, F.col("gu")).when(y == i + 1, F.col("gl")).otherwise(none)).alias(f"g{i}") for i in range(1, k + 1)]
        parts += [F.sum(F.when(y == i, F.col("hu")).when(y == i + 1, F.col("hl")).otherwise(none)).alias(f"d{i}") for i in range(1, k + 1)]
        parts += [F.sum(F.when(y == i + 1, F.col("hm")).otherwise(none)).alias(f"o{i}") for i in range(1, k)]
        raters = cut_lineage(self.cuts.join(rows.groupBy("r").agg(*parts), "r"))
        c = [F.get("cuts", F.lit(i)) for i in range(k)]
        turn = [1 / (b - a) for a, b in zip(c, c[1:])]  # the gaps' logarithms
        g = [F.col(f"g{i + 1}") - c[i] / 4 + (turn[i - 1] if i else none) - (turn[i] if i < k - 1 else none) for i in range(k)]
        d = [F.col(f"d{i + 1}") + 0.25 + (turn[i - 1] ** 2 if i else none) + (turn[i] ** 2 if i < k - 1 else none) for i in range(k)]
        o = [F.col(f"o{i + 1}") - turn[i] ** 2 for i in range(k - 1)]
        raters = raters.select("r", "cuts", *[x.alias(f"g{i + 1}") for i, x in enumerate(g)],
                               *[x.alias(f"d{i + 1}") for i, x in enumerate(d)], *[x.alias(f"o{i + 1}") for i, x in enumerate(o)])
        raters = raters.withColumn("q1", F.col("d1"))
        for i in range(1, k):
            raters = raters.withColumn(f"l{i}", F.col(f"o{i}") / F.col(f"q{i}"))
            raters = raters.withColumn(f"q{i + 1}", F.col(f"d{i + 1}") - F.col(f"o{i}") * F.col(f"l{i}"))
        raters = cut_lineage(raters.select("r", "cuts", *_names("g", k), *_names("l", k - 1), *_names("q", k)))
        links = rows.groupBy("s", "r").agg(*[
            F.sum(F.when(y == i, -F.col("hu") - F.col("hm")).when(y == i + 1, -F.col("hl") - F.col("hm")).otherwise(none)).alias(f"b{i}")
            for i in range(1, k + 1)])
        worst = [scores.agg(F.max(F.abs("g"))).first()[0], raters.agg(F.max(F.greatest(*[F.abs(x) for x in _names("g", k)], none))).first()[0]]
        return scores, raters, cut_lineage(links), max(worst)

    def _solved(self, raters: DataFrame, right: list[Column]) -> list[Column]:
        return _banded(right, [F.col(c) for c in _names("l", self.k - 1)], [F.col(c) for c in _names("q", self.k)])

    def _back(self, links: DataFrame, vectors: DataFrame) -> DataFrame:
        """(s, v): links times a vector of the raters, z1.., summed up by score."""
        return links.join(vectors, "r").groupBy("s").agg(F.sum(_sum([F.col(f"b{i}") * F.col(f"z{i}") for i in range(1, self.k + 1)])).alias("v"))

    def _ahead(self, links: DataFrame, vector: DataFrame) -> DataFrame:
        """(r, w1..): links times a vector (s, p) of the scores, summed up by rater."""
        return links.join(vector, "s").groupBy("r").agg(*[F.sum(F.col(f"b{i}") * F.col("p")).alias(f"w{i}") for i in range(1, self.k + 1)])

    def without_raters(self, links: DataFrame, scores: DataFrame, raters: DataFrame) -> DataFrame:
        """``scores`` with ``m``, a score's own entry after the raters are removed."""
        factors = raters.select("r", *_names("l", self.k - 1), *_names("q", self.k))
        b = [F.col(c) for c in _names("b", self.k)]
        own = _sum([x * z for x, z in zip(b, self._solved(factors, b), strict=True)])
        taken = links.join(factors, "r").groupBy("s").agg(F.sum(own).alias("taken"))
        return cut_lineage(scores.join(taken, "s", "left").withColumn("m", F.col("a") - F.coalesce("taken", F.lit(0.0))).drop("taken"))

    def direction(self, scores: DataFrame, raters: DataFrame, links: DataFrame, share: float, most: int) -> tuple[DataFrame, DataFrame, int]:
        """Newton's step (s, step) and (r, steps) by conjugate gradients until the rest is ``share`` of what it was."""
        names, factors = _names("z", self.k), raters.select("r", *_names("l", self.k - 1), *_names("q", self.k))

        def rater_part(right: DataFrame, prefix: str) -> DataFrame:
            solved = self._solved(right, [F.col(c) for c in _names(prefix, self.k)])
            return right.select("r", *[x.alias(c) for x, c in zip(solved, names, strict=True)])

        scores = self.without_raters(links, scores, raters)
        first = self._back(links, rater_part(raters, "g"))
        r, p, q, m = (F.col(c) for c in ("rest", "p", "q", "m"))
        zero = F.lit(0.0)
        state = scores.join(first, "s", "left").select("s", (F.col("a") - F.col("own")).alias("a"), "m", zero.alias("x"),
                                                       (F.col("g") - F.coalesce("v", zero)).alias("rest"))
        state = cut_lineage(state.withColumn("p", r / m))
        begin = rz = state.agg(F.sum(r * r / m)).first()[0]
        count = 0
        while rz > share * share * begin and count < most:
            mid = rater_part(self._ahead(links, state.select("s", "p")).join(factors, "r"), "w")
            table = state.join(self._back(links, mid), "s", "left").join(self._prior_product(state.select("s", "p")), "s")
            table = cut_lineage(table.withColumn("q", F.col("a") * p + F.col("u") - F.coalesce("v", zero)).drop("v", "u"))
            row = table.agg(F.sum(p * q).alias("pq"), F.sum(r * q / m).alias("rq"), F.sum(q * q / m).alias("qq"), F.sum(r * r / m).alias("rr")).first()
            step = row.rr / row.pq
            new = max(row.rr - 2 * step * row.rq + step * step * row.qq, 0.0)
            left, turn = r - F.lit(float(step)) * q, F.lit(float(new / row.rr))
            state = table.select("s", "a", "m", (F.col("x") + F.lit(float(step)) * p).alias("x"), left.alias("rest"), (left / m + turn * p).alias("p"))
            rz, count = new, count + 1
        steps = cut_lineage(state.select("s", F.col("x").alias("step")))
        seen = raters.join(self._ahead(links, steps.select("s", F.col("step").alias("p"))), "r")
        seen = seen.select("r", *_names("l", self.k - 1), *_names("q", self.k), *[(F.col(f"g{i}") - F.col(f"w{i}")).alias(f"w{i}") for i in range(1, self.k + 1)])
        moves = rater_part(seen, "w").select("r", F.array(*names).alias("steps"))
        return steps, cut_lineage(moves), count

    def moved(self, steps: DataFrame, moves: DataFrame, t: float) -> tuple[DataFrame, DataFrame]:
        theta = self.theta.join(steps, "s").select("s", (F.col("theta") + F.lit(t) * F.col("step")).alias("theta"))
        cuts = self.cuts.join(moves, "r").select("r", F.zip_with("cuts", "steps", lambda a, b: a + F.lit(t) * b).alias("cuts"))
        return cut_lineage(theta), cut_lineage(cuts)


def _precision(traits: list[str], covariance) -> dict:
    matrix = np.asarray(covariance, dtype=float)
    if matrix.shape != (len(traits), len(traits)) or not np.allclose(matrix, matrix.T) or np.linalg.eigvalsh(matrix)[0] <= 0:
        raise ValueError("needs a symmetric positive definite matrix with a row for each trait")
    inverse = np.linalg.inv(matrix)
    return {a: {b: inverse[i, j] for j, b in enumerate(traits)} for i, a in enumerate(traits)}


def fit_mode(facts: DataFrame, levels: int, score_key: list[str], cut_key: list[str], tolerance: float = 1e-6, max_steps: int = 50,
             trait: str | None = None, covariance: tuple[list[str], np.ndarray] | None = None) -> ModeFit:
    """Scores by ``score_key`` and ``levels`` - 1 cut points by ``cut_key`` from marks ``y`` in 1..``levels``.

    Marks that are missing or outside the levels are left out; a missing key is a key of its own. ``converged``
    says that no entry of the gradient is larger than ``tolerance``. Needs one mark and three levels at least.

    ``covariance`` (traits, matrix) is the prior's over the column ``trait`` of the score key; marks of other
    traits are left out, and all the traits of a person with a mark get a score.
    """
    prior = None
    if covariance is not None:
        prior = _precision(*covariance)
        facts = facts.where(F.col(f"`{trait}`").isin(list(prior)))
    inner, rows = _marks(facts, levels, score_key, cut_key)
    rows = cut_lineage(rows)
    found, size, n_rows = blocks.counted(rows, [inner[c] for c in score_key])
    if not n_rows or levels < 3:
        raise ValueError("needs a mark and three levels")
    if size * (len(prior) if prior else 1) <= blocks.HELD:
        packed = PackedFit(rows, levels, inner, score_key, cut_key, found, n_rows, trait, prior)
        steps, height = packed.solve(tolerance, max_steps, SHORTEST)
        return ModeFit(packed.score_table(), packed.cut_table(), steps, packed.products, packed.gradient, height, packed.gradient <= tolerance)
    return _joined_mode(_Fit(rows, inner, levels, score_key, cut_key, trait, prior), score_key, cut_key, tolerance, max_steps)


def _joined_mode(fit: _Fit, score_key: list[str], cut_key: list[str], tolerance: float, max_steps: int) -> ModeFit:
    """The same with every vector as a table: for more scores than the driver holds."""
    height, steps, products = fit.objective(fit.theta, fit.cuts), 0, 0
    while True:
        scores, raters, links, gradient = fit.derivatives()
        if gradient <= tolerance or steps >= max_steps:
            break
        ahead, moves, count = fit.direction(scores, raters, links, min(0.1, max(gradient, 1e-3 * tolerance)), 200)
        products, t = products + count, 1.0
        while True:
            theta, cuts = fit.moved(ahead, moves, t)
            new = fit.objective(theta, cuts)
            if new >= height - 1e-9 * abs(height) or t < SHORTEST:
                break
            t /= 2
        fit.theta, fit.cuts, height, steps = theta, cuts, new, steps + 1
    final = fit.without_raters(links, scores, raters)

    def keyed(name: str, own: list[str], table: DataFrame, values: list[str]) -> DataFrame:
        """The values by the given keys instead of ids; a key may have any name."""
        joined = fit.keys[name].join(table.select(F.col(name).alias("__id"), *[F.col(c).alias(f"__{c}") for c in values]), "__id")
        return joined.select(*[F.col(f"`{c}`") for c in own], *[F.col(f"__{c}").alias(c) for c in (*values, "n")])

    return ModeFit(keyed("s", score_key, final.withColumn("sd", 1 / F.sqrt("m")), ["theta", "sd"]), keyed("r", cut_key, fit.cuts, ["cuts"]),
                   steps, products, float(gradient), float(height), gradient <= tolerance)
