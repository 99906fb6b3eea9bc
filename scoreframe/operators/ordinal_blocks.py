"""The posterior mode of ordinal scores and cut points over packed rows.

The raters are the inner levels: their cut points lie in the blocks, and each pass works out
the marks' derivatives from the scores and cut points at hand, solves the raters' small band
matrices and sums up by score. The scores, and the cut points of raters with too many marks
for one block, are the outer unknowns of the conjugate gradients. See ``ordinal_mode``.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.operators import blocks as bl
from scoreframe.operators.blocks import Block, scatter
from scoreframe.operators.joins import left_on
from scoreframe.operators.ordinal import starting_values
from scoreframe.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # so that the workers need no copy of it

MARKS = {"g": "int32", "y": "int16"}
#: Stands for an infinite bound, whose share is 0 up to rounding; infinite numbers are slow.
OPEN = 600.0
STATE = MARKS | {"cuts": "float64", "moves": "float64"}


def _factors(d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lower, pivots = np.empty_like(o), d.copy()
    for i in range(o.shape[1]):
        lower[:, i] = o[:, i] / pivots[:, i]
        pivots[:, i + 1] -= o[:, i] * lower[:, i]
    return lower, pivots


def _solved(right: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    lower, pivots = factors
    out = right.copy()
    for i in range(1, out.shape[1]):
        out[:, i] -= lower[:, i - 1] * out[:, i - 1]
    out /= pivots
    for i in range(out.shape[1] - 2, -1, -1):
        out[:, i] -= lower[:, i] * out[:, i + 1]
    return out


def _prior_terms(cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """What the prior and the gaps' logarithms add to gradient, diagonal and band, and their height."""
    gaps = np.diff(cuts, axis=1)
    if (gaps <= 0).any():
        return np.zeros_like(cuts), np.ones_like(cuts), np.zeros_like(gaps), -np.inf
    turn = 1 / gaps
    g, d = -cuts / 4, np.full_like(cuts, 0.25)
    g[:, 1:] += turn
    g[:, :-1] -= turn
    d[:, 1:] += turn**2
    d[:, :-1] += turn**2
    return g, d, -turn**2, float(np.log(gaps).sum() - (cuts**2).sum() / 8)


class Point:
    """A block's marks at given scores and cut points; ``near`` raters come before the outer ones."""

    def __init__(self, block: Block, s: dict):
        self.block, self.k = block, s["k"]
        k, self.near = self.k, len(block.sizes)
        if "cuts" in block.column:
            own = block.column["cuts"].reshape(-1, k) + s["t"] * block.column["moves"].reshape(-1, k)
        else:
            own = np.tile(s["start"], (self.near, 1))
        self.cuts = np.concatenate([own, s["far"]])
        self.g = block.column["g"].astype(np.intp)
        self.level = np.concatenate([np.repeat(np.arange(self.near), block.sizes), self.near + block.far.astype(np.intp)])
        self.at = self.level * (k + 2) + block.column["y"]
        bounds = np.full((len(self.cuts), k + 2), OPEN)
        bounds[:, 0], bounds[:, 1:k + 1] = -OPEN, self.cuts
        gap = np.full_like(bounds, np.inf)
        gap[:, 2:k + 1] = np.diff(self.cuts, axis=1)
        with np.errstate(all="ignore"):
            self.width = -np.expm1(-gap).ravel()
            near_by, whole = np.exp(-gap).ravel()[self.at], (1 / self.width)[self.at]
        theta = s["theta"][self.g]
        u, v = bounds.ravel()[self.at] - theta, bounds.ravel()[self.at - 1] - theta
        self.u, self.v = u, v
        eu, ev = np.exp(-np.abs(u)), np.exp(-np.abs(v))
        self.u1, self.v1 = eu + 1, ev + 1
        ratio = self.v1 / self.u1
        # slopes of a bound over the mark's probability: ratios of shares, of which none can be 0 by 0
        fu = np.where(v >= 0, near_by, np.where(u >= 0, eu, 1.0)) * ratio * whole
        fl = np.where(u < 0, near_by, np.where(v < 0, ev, 1.0)) / ratio * whole
        self.up, self.lo = np.where(u >= 0, 1.0, eu) / self.u1, np.where(v >= 0, 1.0, ev) / self.v1
        self.fu, self.fl = fu, fl
        self.hm = -fu * fl
        self.hu, self.hl = fu * (fu - 1 + 2 * self.up), fl * (fl + 1 - 2 * self.lo)
        self.b_up, self.b_lo = -self.hu - self.hm, -self.hl - self.hm

    def log_p(self) -> float:
        """The sum of the marks' log probabilities."""
        with np.errstate(all="ignore"):
            own = np.log(self.width)[self.at]
        return float((np.minimum(self.u, 0) + np.minimum(-self.v, 0) - np.log(self.u1 * self.v1) + own).sum())

    def by_cut(self, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """For each cut point the sum of ``upper`` over the marks below it and of ``lower`` over those above."""
        size, k = len(self.cuts) * (self.k + 2), self.k
        return (np.bincount(self.at, upper, size).reshape(-1, k + 2)[:, 1:k + 1]
                + np.bincount(self.at, lower, size).reshape(-1, k + 2)[:, 2:k + 2])

    def matrices(self) -> tuple[np.ndarray, np.ndarray]:
        """Diagonal and band of each rater, the prior left out."""
        band = np.bincount(self.at, self.hm, len(self.cuts) * (self.k + 2)).reshape(-1, self.k + 2)[:, 2:self.k + 1]
        return self.by_cut(self.hu, self.hl), band

    def factors(self, d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, own_d, own_o, _ = _prior_terms(self.cuts[:self.near])
        return _factors(d[:self.near] + own_d, o[:self.near] + own_o)

    def ahead(self, vector: np.ndarray) -> np.ndarray:
        """Links times a vector of the scores, summed up by rater."""
        p = vector[self.g]
        return self.by_cut(self.b_up * p, self.b_lo * p)

    def back(self, levels: np.ndarray) -> np.ndarray:
        """Links times a vector of the raters, for each mark."""
        padded = np.zeros((len(levels), self.k + 2))
        padded[:, 1:self.k + 1] = levels
        flat = padded.ravel()
        return self.b_up * flat[self.at] + self.b_lo * flat[self.at - 1]

    def taken(self, rows: slice, factors: tuple[np.ndarray, np.ndarray], first: int) -> tuple[np.ndarray, np.ndarray]:
        """(score, what a rater's removal takes from its own entry) for each pair of them among the rows."""
        level, g, k = self.level[rows] - first, self.g[rows], self.k
        if not len(g):
            return g, np.zeros(0)
        y, up, lo = self.block.column["y"][rows].astype(np.intp), self.b_up[rows], self.b_lo[rows]
        units = np.stack([_solved(np.broadcast_to(np.eye(k)[i], (len(factors[1]), k)), factors) for i in range(k)], axis=1)
        padded = np.zeros((len(units), k + 2, k + 2))
        padded[:, 1:k + 1, 1:k + 1] = units
        at = (level * (k + 2) + y) * (k + 2) + y
        flat = padded.ravel()
        own = up * up * flat[at] + 2 * up * lo * flat[at - 1] + lo * lo * flat[at - k - 3]
        # marks of one person by one rater: with each other as well
        code = level * (int(g.max()) + 1) + g
        if (np.diff(code) < 0).any():
            order = np.argsort(code, kind="stable")
            code, g, level, y, up, lo, own = (x[order] for x in (code, g, level, y, up, lo, own))
        ahead = 1
        while len(same := np.flatnonzero(code[ahead:] == code[:-ahead])):
            i, j = same, same + ahead
            for x, place_x in ((up, y), (lo, y - 1)):
                for z, place_z in ((up, y), (lo, y - 1)):
                    own[i] += 2 * x[i] * z[j] * padded[level[i], place_x[i], place_z[j]]
            ahead += 1
        return g, own


def _evaluate(block: Block, s: dict, total: np.ndarray):
    """Into [gradient, information, taken, rater part] of the scores and [gradient, diagonal, band] of the outer raters."""
    point, size = Point(block, s), len(s["theta"])
    near = point.near
    own_g, _, _, height = _prior_terms(point.cuts[:near])
    if height == -np.inf:
        return -np.inf, 0.0
    d, o = point.matrices()
    factors = point.factors(d, o)
    g = point.by_cut(point.fu, -point.fl)
    near_g = g[:near] + own_g
    scatter(total[:size], point.g, point.up + point.lo - 1)
    scatter(total[size:2 * size], point.g, point.up * (1 - point.up) + point.lo * (1 - point.lo))
    scatter(total[2 * size:3 * size], *point.taken(slice(0, block.near), factors, 0))
    scatter(total[3 * size:4 * size], point.g, point.back(np.concatenate([_solved(near_g, factors), np.zeros_like(s["far"])])))
    if len(s["far"]):
        total[4 * size:] += np.concatenate([g[near:].ravel(), d[near:].ravel(), o[near:].ravel()])
    return point.log_p() + height, np.abs(near_g).max(initial=0.0)


def _product(block: Block, s: dict, total: np.ndarray):
    """The second derivatives, inner raters removed, times (p of the scores, steps of the outer raters), without diagonals."""
    point, size = Point(block, s), len(s["theta"])
    w = point.ahead(s["p"])
    z = _solved(w[:point.near], point.factors(*point.matrices()))
    scatter(total[:size], point.g, point.back(np.concatenate([-z, s["p_far"]])))
    if len(s["far"]):
        total[size:] += w[point.near:].ravel()
    return (0.0,)


def _taken_far(block: Block, s: dict, total: np.ndarray):
    point = Point(block, s)
    scatter(total, *point.taken(slice(block.near, None), s["far_factors"], point.near))
    return (0.0,)


def _advanced(block: Block, s: dict) -> pa.Table:
    """The block with its present cut points, and the steps that belong to the scores' step."""
    point = Point(block, s)
    near = point.near
    g = point.by_cut(point.fu, -point.fl)[:near] + _prior_terms(point.cuts[:near])[0]
    moves = _solved(g - point.ahead(s["p"])[:near], point.factors(*point.matrices()))
    out = {c: block.raw[c] for c in ("keys", "sizes", "heavy", *MARKS)}
    out |= {"cuts": point.cuts[:near].tobytes(), "moves": moves.tobytes()}
    return pa.table({c: pa.array([v], pa.binary()) for c, v in out.items()})


class PackedFit:
    """Marks as blocks by rater; scores, outer cut points and all vectors of the solver on the driver."""

    def __init__(self, rows: DataFrame, levels: int, inner: dict[str, str], score_key: list[str], cut_key: list[str],
                 found: DataFrame, n_rows: int, trait: str | None = None, prior: dict | None = None):
        self.spark, self.k, self.inner, self.score_key, self.cut_key = rows.sparkSession, levels - 1, inner, score_key, cut_key
        names, self.raters = [inner[c] for c in score_key], [inner[c] for c in cut_key]
        self.precision = np.array([[prior[a][b] for b in prior] for a in prior]) if prior else None
        self.scores = self._completed(found, names, inner[trait], list(prior)) if prior else bl.numbered(found, names, 0)
        self.size = self.scores.count()
        of_raters, _, _ = bl.counted(rows, self.raters)
        self.far_keys = bl.numbered(of_raters.where(F.col("n") > bl.WHOLE), self.raters, 0)
        n_far = self.far_keys.count()
        known = bl.told(rows, self.scores, self.size, names, "g")
        known = bl.told(known, self.far_keys, n_far, self.raters, "heavy") if n_far else known.withColumn("heavy", F.lit(None).cast("bigint"))
        self.kinds = bl.key_types(rows, self.raters)
        self.blocks, self.types = bl.pack(known, self.raters, ["g"], {"y": MARKS["y"]}, n_rows), MARKS
        self.start = np.array(starting_values(rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")), levels))
        self.theta, self.far, self.t = np.zeros(self.size), np.tile(self.start, (n_far, 1)), 1.0
        self.products = 0

    @staticmethod
    def _completed(found: DataFrame, names: list[str], trait: str, traits: list[str]) -> DataFrame:
        """Every trait of every person, a person's traits in a row, with 0 marks where there are none."""
        person = ["__one", *[c for c in names if c != trait]]
        people = bl.numbered(found.withColumn("__one", F.lit(0)).select(*person).distinct(), person, 0)
        of_traits = F.posexplode(F.array(*[F.lit(t) for t in traits])).alias("__slot", trait)
        every = people.select(*person, "id", of_traits).withColumn("id", F.col("id") * len(traits) + F.col("__slot"))
        return cut_lineage(left_on(every, found, names).select(*names, "id", F.coalesce("n", F.lit(0)).alias("n")))

    def _prior(self, vector: np.ndarray) -> np.ndarray:
        return vector if self.precision is None else (vector.reshape(-1, len(self.precision)) @ self.precision).ravel()

    def _own(self) -> np.ndarray:
        return np.ones(self.size) if self.precision is None else np.tile(np.diag(self.precision), self.size // len(self.precision))

    def _shared(self, **more) -> dict:
        return {"k": self.k, "start": self.start, "theta": self.theta, "far": self.far, "t": self.t, **more}

    def evaluate(self, theta: np.ndarray, far: np.ndarray, t: float) -> float:
        """Goes to a point; sets the gradient, the second derivatives' parts and ``height``."""
        self.theta, self.far, self.t = theta, far, t
        n, h, k = self.size, len(far), self.k
        own_g, own_d, own_o, height = _prior_terms(far)
        if height == -np.inf:
            return -np.inf
        total, few = bl.run(self.blocks, self.types, self._shared(), _evaluate, 4 * n + h * (3 * k - 1))
        g, a, taken, first = total[:4 * n].reshape(4, n)
        prior = self._prior(theta)
        self.g, self.a, own = g - prior, a, self._own()
        self.m, self.rest = a + own - taken, self.g - first
        far_part = total[4 * n:]
        self.far_g = far_part[:h * k].reshape(h, k) + own_g
        self.far_d, self.far_o = far_part[h * k:2 * h * k].reshape(h, k) + own_d, far_part[2 * h * k:].reshape(h, k - 1) + own_o
        self.gradient = float(max(np.abs(self.g).max(), few[:, 1].max(), np.abs(self.far_g).max(initial=0.0)))
        value = few[:, 0].sum() + height - theta @ prior / 2
        return float(value) if np.isfinite(value) else -np.inf

    def _times(self, p: np.ndarray, p_far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total, _ = bl.run(self.blocks, self.types, self._shared(p=p, p_far=p_far), _product, self.size + p_far.size)
        self.products += 1
        far = total[self.size:].reshape(p_far.shape) + self.far_d * p_far
        far[:, 1:] += self.far_o * p_far[:, :-1]
        far[:, :-1] += self.far_o * p_far[:, 1:]
        return total[:self.size] + self.a * p + self._prior(p), far

    def direction(self, share: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Newton's step of the scores and the outer cut points; conjugate gradients until the rest is ``share`` of what it was."""
        factors = _factors(self.far_d, self.far_o)
        rest, rest_far = self.rest.copy(), self.far_g.copy()
        x, x_far = np.zeros_like(rest), np.zeros_like(rest_far)
        ahead, ahead_far = rest / self.m, _solved(rest_far, factors)
        p, p_far = ahead, ahead_far
        begin = rz = rest @ ahead + (rest_far * ahead_far).sum()
        count = 0
        while rz > share * share * begin and count < most:
            q, q_far = self._times(p, p_far)
            step = rz / (p @ q + (p_far * q_far).sum())
            x, x_far = x + step * p, x_far + step * p_far
            rest, rest_far = rest - step * q, rest_far - step * q_far
            ahead, ahead_far = rest / self.m, _solved(rest_far, factors)
            rz, last = rest @ ahead + (rest_far * ahead_far).sum(), rz
            p, p_far = ahead + rz / last * p, ahead_far + rz / last * p_far
            count += 1
        return x, x_far

    def advance(self, step: np.ndarray) -> None:
        """Writes the blocks with the present cut points and the raters' steps."""
        columns = ["keys", "sizes", "heavy", *STATE]
        self.blocks = bl.each(self.blocks, self.types, self._shared(p=step), _advanced, ", ".join(f"{c} binary" for c in columns))
        self.types, self.t = STATE, 0.0

    def solve(self, tolerance: float, max_steps: int, shortest: float) -> tuple[int, float]:
        height, steps = self.evaluate(self.theta, self.far, 1.0), 0
        while self.gradient > tolerance and steps < max_steps:
            step, step_far = self.direction(min(0.1, max(self.gradient, 1e-3 * tolerance)), 200)
            self.advance(step)
            theta, far, t = self.theta, self.far, 1.0
            while True:
                new = self.evaluate(theta + t * step, far + t * step_far, t)
                if new >= height - 1e-9 * abs(height) or t < shortest:
                    break
                t /= 2
            height, steps = new, steps + 1
        return steps, height

    def score_table(self) -> DataFrame:
        """(keys, theta, sd, n)."""
        m = self.m
        if len(self.far):
            more, _ = bl.run(self.blocks, self.types, self._shared(far_factors=_factors(self.far_d, self.far_o)), _taken_far, self.size)
            m = m - more
        values = bl.held(self.spark, __theta=self.theta, __sd=1 / np.sqrt(m))
        joined = self.scores.select(*[F.col(self.inner[c]) for c in dict.fromkeys(self.score_key)], "id", F.col("n").cast("bigint").alias("__n")).join(values, "id")
        return joined.select(*[F.col(self.inner[c]).alias(c) for c in self.score_key], F.col("__theta").alias("theta"), F.col("__sd").alias("sd"), F.col("__n").alias("n"))

    def cut_table(self) -> DataFrame:
        """(keys, cuts, n)."""
        def own(block: Block, s: dict) -> pa.Table:
            cuts = Point(block, s).cuts[:len(block.sizes)]
            return block.keys().append_column("__cuts", pa.array(list(cuts), pa.list_(pa.float64()))).append_column("__n", pa.array(block.sizes))

        found = bl.each(self.blocks, self.types, self._shared(), own, f"{self.kinds}, `__cuts` array<double>, `__n` bigint")
        if len(self.far):
            values = self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(self.far)], "id bigint, __cuts array<double>")
            far = self.far_keys.withColumnRenamed("n", "__n").join(values, "id")
            found = found.unionByName(far.select(*found.columns))
        return found.select(*[F.col(self.inner[c]).alias(c) for c in self.cut_key], F.col("__cuts").alias("cuts"), F.col("__n").alias("n"))
