"""Linear model with crossed random intercepts: moment variances and exact effects.

Variances come from within-level sums of squares, whose expectations are linear in them
with coefficients that depend on the counts of level pairs alone. For given variances the
coefficients and effects solve one sparse linear system; preconditioned conjugate
gradients solve it until no level's equation is off by more than the tolerance. Both are
repeated, each from the last result, until the variances stay.

The rows are packed by the factor with the most levels (see ``blocks``), whose effects are
eliminated: a product of the system with a vector is one pass over arrays, and the vectors,
a number for each level of the other factors, lie on the driver. The sums that the variances
need are found in one pass at the start.

If the other factors have more levels than the driver holds, rows are collapsed to counts by
level ids and covariates. A product then joins the vector's values by id, and one partially
aggregated sum by id gives the product. The vectors are one table with a row for each level;
only sums for the fixed effects and scalar products reach the driver.
"""

from __future__ import annotations

import sys
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.functions.missing import as_col
from scoreframe.operators import blocks as bl
from scoreframe.operators.blocks import Block, scatter
from scoreframe.operators.joins import left_on
from scoreframe.operators.ordered import number_rows
from scoreframe.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # so that the workers need no copy of it

#: An effect variance counts as at least this share of the residual variance.
LEAST = 1e-9
#: Effects are solved to this share of the last residual as long as the variances move.
ROUGH = 1e-4
#: Sums of doubles are not held to less than this share of the largest one.
EXACT = 2e-14


class MixedFit:
    """Coefficients, level effects per factor, variance components, and how the fit ended.

    ``gradient`` is the largest amount by which an equation of the system is off.
    """

    def __init__(self, covariates, beta, effects, residual_var, effect_vars, steps, rounds, gradient, converged):
        self.covariates, self.beta, self.effects = covariates, beta, effects
        self.residual_var, self.effect_vars = residual_var, effect_vars
        self.steps, self.rounds, self.gradient, self.converged = steps, rounds, gradient, converged


def _fixed(covariates: list[str], beta) -> Column:
    value = F.lit(float(beta[0]))
    for b, c in zip(beta[1:], covariates):
        value = value + F.lit(float(b)) * as_col(c)
    return value


def _solved_variances(left: np.ndarray, right: np.ndarray, total: float, n: float) -> tuple[float, np.ndarray]:
    found = np.linalg.lstsq(left, right, rcond=None)[0]
    noise = max(found[0], 1e-12 * max(total / n, 1e-300))
    return noise, np.maximum(found[1:], LEAST * noise)


class Design:
    """The rows as counts by level ids and covariates, and the levels with their ids.

    ``cells``: id_0.., x_0.. (x_0 is 1), n, sy, syy. ``levels``: id, f (the factor's number), n, b (sum of y).
    """

    def __init__(self, df: DataFrame, y: str, covariates: list[str], factors: dict[str, list[str]]):
        self.names, self.keys, self.p = list(factors), factors, 1 + len(covariates)
        value = as_col(y).cast("double")
        xs = [as_col(c).cast("double").alias(f"x_{j + 1}") for j, c in enumerate(covariates)]
        keys = list(dict.fromkeys(k for names in factors.values() for k in names))
        inner = {k: f"__key_{i}" for i, k in enumerate(keys)}
        rows = cut_lineage(df.select(*[F.col(f"`{k}`").alias(v) for k, v in inner.items()], *xs, value.alias("y")).groupBy(
            *inner.values(), *[f"x_{j}" for j in range(1, self.p)]).agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")))
        self.tables, self.sizes, raw, first = {}, [], [], 0
        for f, (name, names) in enumerate(factors.items()):
            own = [inner[k] for k in names]
            found = rows.groupBy(*own).agg(F.sum("n").alias("n"), F.sum("sy").alias("b"))
            table = cut_lineage(number_rows(found, own, "__place").withColumn("id", (F.col("__place") + first - 1).cast("bigint")).drop("__place"))
            rows = left_on(rows, table.select(*own, F.col("id").alias(f"id_{f}")), own)
            self.tables[name] = table.select(*[F.col(inner[k]).alias(k) for k in names], F.col("id").alias("__id"), F.col("n").cast("bigint").alias("__n"))
            raw.append(table)
            self.sizes.append(table.count())
            first += self.sizes[-1]
        levels = [t.select("id", F.lit(f).alias("f"), "n", "b") for f, t in enumerate(raw)]
        self.ids = [f"id_{f}" for f in range(len(factors))]
        self.cells = cut_lineage(rows.select(*self.ids, F.lit(1.0).alias("x_0"), *[f"x_{j}" for j in range(1, self.p)], "n", "sy", "syy"))
        self.levels = levels[0]
        for other in levels[1:]:
            self.levels = self.levels.unionByName(other)
        self._moments()
        self._overlaps()

    def _moments(self) -> None:
        """Sums over all rows: X'X, X'y, y'y."""
        x, n = [F.col(f"x_{j}") for j in range(self.p)], F.col("n")
        pairs = [(i, j) for i in range(self.p) for j in range(i, self.p)]
        row = self.cells.agg(*[F.sum(n * x[i] * x[j]).alias(f"s{i}_{j}") for i, j in pairs],
                             *[F.sum(x[j] * F.col("sy")).alias(f"b{j}") for j in range(self.p)], F.sum("syy").alias("yy")).first()
        self.xx = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(self.p)] for i in range(self.p)])
        self.xy = np.array([row[f"b{j}"] for j in range(self.p)])
        self.yy, self.rows = row["yy"], self.xx[0, 0]

    def _overlaps(self) -> None:
        """For factors f, g the sum over f's levels of the squared counts shared with g's levels, by the level's count."""
        k = len(self.ids)
        self.overlap = np.zeros((k, k))
        squares = self.levels.groupBy("f").agg(F.sum(F.col("n") * F.col("n")).alias("s")).collect()
        self.squares = np.zeros(k)
        for r in squares:
            self.squares[r.f] = r.s
        for f in range(k):
            for g in range(f + 1, k):
                shared = self.cells.groupBy(f"id_{f}", f"id_{g}").agg(F.sum("n").alias("m"))
                for c in (f, g):
                    shared = shared.join(self.levels.where(F.col("f") == c).select(F.col("id").alias(f"id_{c}"), F.col("n").alias(f"n_{c}")), f"id_{c}")
                square = F.col("m") * F.col("m")
                row = shared.agg(F.sum(square / F.col(f"n_{f}")).alias("a"), F.sum(square / F.col(f"n_{g}")).alias("b")).first()
                self.overlap[f, g], self.overlap[g, f] = row.a, row.b

    def fixed(self, beta: np.ndarray) -> Column:
        value = F.lit(float(beta[0]))
        for j in range(1, self.p):
            value = value + F.lit(float(beta[j])) * F.col(f"x_{j}")
        return value

    def variances(self, beta: np.ndarray) -> tuple[float, np.ndarray]:
        """Residual variance and effect variances that match the sums of squares about ``beta``."""
        rest = F.col("sy") - F.col("n") * self.fixed(beta)
        parts = F.explode(F.array(*[F.struct(F.col(c).alias("id"), rest.alias("v")) for c in self.ids])).alias("e")
        sums = self.cells.select(parts).groupBy("e.id").agg(F.sum("e.v").alias("s"))
        within = self.levels.join(sums, "id").groupBy("f").agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.sum("s").alias("s"))
        total = self.yy - 2 * beta @ self.xy + beta @ self.xx @ beta
        k, n = len(self.ids), self.rows
        left, right = np.zeros((k + 1, k + 1)), np.zeros(k + 1)
        for r in within.collect():
            right[r.f] = total - r.q
            if r.f == 0:
                right[k] = total - r.s * r.s / n
        for f in range(k):
            left[f, 0] = n - self.sizes[f]
            left[f, 1:] = [0.0 if g == f else n - self.overlap[f, g] for g in range(k)]
        left[k] = [n - 1, *(n - self.squares / n)]
        return _solved_variances(left, right, total, n)

    def product(self, vector: DataFrame, fixed: np.ndarray) -> DataFrame:
        """(id, v): Z'W(Z p + X q) by level id, and X'W(Z p + X q) under the ids -1, -2 ..; ``vector`` has (id, p)."""
        rows, t = self.cells, self.fixed(fixed)
        for f, c in enumerate(self.ids):
            rows = rows.join(vector.select(F.col("id").alias(c), F.col("p").alias(f"p_{f}")), c)
            t = t + F.col(f"p_{f}")
        t = F.col("n") * t
        parts = [F.struct(F.col(c).alias("id"), t.alias("v")) for c in self.ids]
        parts += [F.struct(F.lit(-1 - j).cast("bigint").alias("id"), (t * F.col(f"x_{j}")).alias("v")) for j in range(self.p)]
        return rows.select(F.explode(F.array(*parts)).alias("e")).groupBy("e.id").agg(F.sum("e.v").alias("v"))


class Solver:
    """Coefficients ``beta`` and effects (column ``x`` of ``state``) of a design for given penalties."""

    def __init__(self, design: Design):
        self.d, self.steps, self.gradient = design, 0, np.inf
        self.beta = np.linalg.solve(design.xx, design.xy)
        self.state = design.levels.withColumn("x", F.lit(0.0))

    def _applied(self, state: DataFrame, fixed: np.ndarray, penalty: Column) -> tuple[DataFrame, list[Column]]:
        """The product joined to ``state`` as ``q`` and written; aggregates that give its fixed part."""
        sums = self.d.product(state.select("id", "p"), fixed)
        table = cut_lineage(sums.join(state, "id", "left").withColumn("q", F.col("v") + penalty * F.col("p")))
        return table, [F.max(F.when(F.col("id") == -1 - j, F.col("v"))).alias(f"q{j}") for j in range(self.d.p)]

    def solve(self, penalties: np.ndarray, tolerance: float, max_steps: int) -> bool:
        """Conjugate gradients from the present state; restarted until the true residual is small everywhere."""
        d = self.d
        penalty = F.element_at(F.array(*[F.lit(float(v)) for v in penalties]), F.col("f") + 1)
        scale = F.col("n") + penalty
        r, q = F.col("r"), F.col("q")
        while True:
            table, fixed_parts = self._applied(self.state.withColumn("p", F.col("x")), self.beta, penalty)
            state = table.where("id >= 0").select("id", "f", "n", "b", "x", (F.col("b") - q).alias("r"))
            row = table.agg(F.max(F.abs(F.col("b") - q)).alias("most"), F.sum((F.col("b") - q) ** 2 / scale).alias("rz"), *fixed_parts).first()
            rest = d.xy - np.array([row[f"q{j}"] for j in range(d.p)])
            self.gradient = max(row.most, np.abs(rest).max())
            tolerance = max(tolerance, EXACT * np.abs(d.xy).max())
            if self.gradient <= tolerance or self.steps >= max_steps:
                return self.gradient <= tolerance
            ahead = np.linalg.solve(d.xx, rest)
            rz = row.rz + rest @ ahead
            state = state.withColumn("p", r / scale)
            while self.steps < max_steps:
                table, fixed_parts = self._applied(state, ahead, penalty)
                row = table.agg(
                    F.max(F.abs(r)).alias("most"), F.sum(F.col("p") * q).alias("pq"), F.sum(r * r / scale).alias("rr"),
                    F.sum(r * q / scale).alias("rq"), F.sum(q * q / scale).alias("qq"), *fixed_parts).first()
                if max(row.most, np.abs(rest).max()) <= tolerance / 4:
                    break
                fixed_q = np.array([row[f"q{j}"] for j in range(d.p)])
                a = float(rz / (row.pq + ahead @ fixed_q))
                self.beta, rest = self.beta + a * ahead, rest - a * fixed_q
                z = np.linalg.solve(d.xx, rest)
                new = max(row.rr - 2 * a * row.rq + a * a * row.qq, 0.0) + rest @ z
                turn, rz = float(new / rz), new
                ahead = z + turn * ahead
                left = r - F.lit(a) * q
                state = table.where("id >= 0").select("id", "f", "n", "b", (F.col("x") + F.lit(a) * F.col("p")).alias("x"),
                                                      left.alias("r"), (left / scale + F.lit(turn) * F.col("p")).alias("p"))
                self.steps += 1
            self.state = state.select("id", "f", "n", "b", "x")


def _sums(block: Block, s: dict, total: np.ndarray):
    """Into (1, y, x..) sums and squared shared counts by outer level; the inner levels' sums of squares are returned."""
    columns = [np.ones(len(block.column[s["y"]])), *[block.column[c] for c in (s["y"], *s["xs"])]]
    table = total.reshape(len(columns) + 1, -1)
    outer = [block.column[c].astype(np.intp) for c in s["ids"]]
    far = block.far.astype(np.intp)
    for v, row in zip(columns, table):
        for at in outer:
            scatter(row, at, v)
        if len(far):
            scatter(row, far, v[block.near:])
    level, shared = np.repeat(np.arange(len(block.sizes)), block.sizes), []
    for at in outer:
        pair, m = np.unique(level * table.shape[1] + at[:block.near], return_counts=True)
        scatter(table[-1], pair % table.shape[1], (m * m).astype(float))
        shared.append((m * m / block.sizes[pair // table.shape[1]]).sum())
    own = np.stack([block.by_level(v) for v in columns])
    rows = np.stack(columns)
    return [*(own / block.sizes @ own.T).ravel(), *(rows @ rows.T).ravel(), *shared, (block.sizes.astype(float) ** 2).sum()]


def _left(block: Block, s: dict) -> tuple[np.ndarray, np.ndarray]:
    """What is left of the response, if it is asked for, and the inner levels' effects on that."""
    fitted = np.full(block.near + len(block.far), s["fixed"][0])
    for b, c in zip(s["fixed"][1:], s["xs"]):
        fitted += b * block.column[c]
    for c in s["ids"]:
        fitted += s["v"][block.column[c]]
    if len(block.far):
        fitted[block.near:] += s["v"][block.far]
    rest = block.column[s["y"]] - fitted if s["y"] else -fitted
    return rest, block.by_level(rest) / (block.sizes + s["penalty"])


def _rest(block: Block, s: dict, total: np.ndarray):
    rest, effects = _left(block, s)
    rest[:block.near] -= block.to_rows(effects)
    for c in s["ids"]:
        scatter(total, block.column[c], rest)
    if len(block.far):
        scatter(total, block.far, rest[block.near:])
    return [rest.sum(), *[rest @ block.column[c] for c in s["xs"]]]


class Packed:
    """The rows as blocks by the inner factor's levels; the outer levels, with ids, and their sums on the driver."""

    def __init__(self, rows: DataFrame, inner: dict[str, str], tables: dict[str, DataFrame], sizes: dict[str, int], n_rows: int,
                 p: int, factors: dict[str, list[str]], responses: list[str]):
        self.spark, self.rows, self.p, self.factors, self.inner = rows.sparkSession, n_rows, p, factors, inner
        self.xs = [f"x_{j}" for j in range(1, p)]
        self.own = {f: [inner[k] for k in names] for f, names in factors.items()}
        known, self.ids, self.span, self.tables, self.near, self.size = bl.laid_out(rows, self.own, tables, sizes)
        self.outer = [f for f in factors if f != self.near]
        self.kinds = bl.key_types(rows, self.own[self.near])
        self.types = {c: "int32" for c in self.ids} | {c: "float64" for c in self.xs}
        values = {c: "float64" for c in (*responses, *self.xs)}
        self.blocks = bl.pack(known, self.own[self.near], self.ids, values, n_rows)
        self.source, self.sizes_of, self.overlap = rows, sizes, None

    def begin(self, response: str) -> None:
        """Starts the fit of one of the packed responses."""
        self.response = response
        self._sums(self.source, self.sizes_of)
        self.steps, self.gradient = 0, np.inf
        self.v, self.beta = np.zeros(self.size), np.linalg.solve(self.xx, self.xy)

    def _sums(self, rows: DataFrame, sizes: dict[str, int]) -> None:
        """Moments of the rows; for each factor sums of products by level, counts shared with other factors."""
        width, k = self.p + 1, len(self.factors)
        total, few = bl.run(self.blocks, {self.response: "float64"} | self.types, {"ids": self.ids, "xs": self.xs, "y": self.response}, _sums, (width + 1) * self.size)
        table, few = total.reshape(width + 1, self.size), few.sum(axis=0)
        by_near, whole = few[:width * width].reshape(width, width), few[width * width:2 * width * width].reshape(width, width)
        # order of the columns: 1, y, x..
        fixed = [0, *range(2, width)]
        self.n, self.xx, self.xy, self.whole = table[0], whole[np.ix_(fixed, fixed)], whole[fixed, 1], whole
        names = list(self.factors)
        self.within, self.squares = {}, np.zeros(k)
        self.sizes = np.array([sizes[f] for f in names], dtype=float)
        near = names.index(self.near)
        for i, f in enumerate(names):
            part = table[:width, self.span[f]]
            self.within[f] = part / part[0] @ part.T + (by_near if f == self.near else 0)
            self.squares[i] = (part[0] ** 2).sum() + (few[-1] if f == self.near else 0)
        if self.overlap is not None:  # the same for every response
            return
        self.overlap, shared = np.zeros((k, k)), table[-1].copy()
        for i, f in enumerate(self.outer):
            at = names.index(f)
            of_near = few[2 * width * width + i]
            if self.span[self.near].stop > self.span[self.near].start:
                heavy = rows.join(F.broadcast(self.tables[self.near].select(*self.own[self.near], "id")), self._matches(rows), "inner")
                pairs = heavy.select("id", *[rows[c] for c in self.own[f]]).groupBy("id", *self.own[f]).agg(F.count(F.lit(1)).cast("double").alias("m"))
                pairs = bl.cut_lineage(left_on(pairs, self.tables[f].select(*self.own[f], F.col("id").alias("__at")), self.own[f]))
                of_near += pairs.groupBy("id").agg((F.sum(F.col("m") * F.col("m")) / F.sum("m")).alias("s")).agg(F.sum("s")).first()[0]
                met = pairs.groupBy("__at").agg(F.sum(F.col("m") * F.col("m")).alias("s")).toArrow()
                shared[met.column("__at").to_numpy()] += met.column("s").to_numpy()
            self.overlap[near, at] = of_near
            self.overlap[at, near] = (shared[self.span[f]] / self.n[self.span[f]]).sum()
        for f, g in combinations(self.outer, 2):
            i, j, keys = names.index(f), names.index(g), list(dict.fromkeys([*self.own[f], *self.own[g]]))
            pairs = bl.cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("m")))
            for a, b, own in ((i, j, self.own[f]), (j, i, self.own[g])):
                each = pairs.groupBy(*own).agg((F.sum(F.col("m") * F.col("m")) / F.sum("m")).alias("s"))
                self.overlap[a, b] = each.agg(F.sum("s")).first()[0]

    def _matches(self, rows: DataFrame) -> Column:
        table, out = self.tables[self.near], F.lit(True)
        for c in self.own[self.near]:
            out = out & rows[c].eqNullSafe(table[c])
        return out

    def variances(self, beta: np.ndarray) -> tuple[float, np.ndarray]:
        """Residual variance and effect variances that match the sums of squares about ``beta``."""
        a = np.array([-beta[0], 1.0, *(-beta[1:])])
        total, whole, k, n = a @ self.whole @ a, a @ self.whole[:, 0], len(self.factors), float(self.rows)
        left, right = np.zeros((k + 1, k + 1)), np.zeros(k + 1)
        for f, name in enumerate(self.factors):
            right[f] = total - a @ self.within[name] @ a
            left[f, 0] = n - self.sizes[f]
            left[f, 1:] = [0.0 if g == f else n - self.overlap[f, g] for g in range(k)]
        right[k] = total - whole * whole / n
        left[k] = [n - 1, *(n - self.squares / n)]
        return _solved_variances(left, right, total, n)

    def rest(self, v: np.ndarray, fixed: np.ndarray, response: bool) -> tuple[np.ndarray, np.ndarray]:
        """By outer level and fixed effect: what is left of the response (or of 0) once the inner levels are fitted."""
        types = ({self.response: "float64"} if response else {}) | self.types
        total, few = bl.run(self.blocks, types, self._shared(v, fixed, response), _rest, self.size)
        return total - self.penalty * v, few.sum(axis=0)

    def _shared(self, v: np.ndarray, fixed: np.ndarray, response: bool = True) -> dict:
        return {"y": self.response if response else None, "ids": self.ids, "xs": self.xs, "v": v, "fixed": fixed, "penalty": self.near_penalty}

    def solve(self, penalties: np.ndarray, tolerance: float, max_steps: int, share: float = 0.0) -> bool:
        """Conjugate gradients from the present state; restarted until the true residual is small everywhere.

        With a ``share`` they end once the residual is that share of what it was; the next call measures it anew.
        """
        names = list(self.factors)
        self.near_penalty = float(penalties[names.index(self.near)])
        self.penalty = np.zeros(self.size)
        for f in names:
            self.penalty[self.span[f]] = penalties[names.index(f)]
        scale = self.n + self.penalty
        tolerance = max(tolerance, EXACT * np.abs(self.xy).max())
        while True:
            r, rest = self.rest(self.v, self.beta, True)
            self.gradient = float(max(np.abs(r).max(initial=0.0), np.abs(rest).max()))
            if self.gradient <= tolerance or self.steps >= max_steps:
                return self.gradient <= tolerance
            z, ahead = r / scale, np.linalg.solve(self.xx, rest)
            rz, p = r @ z + rest @ ahead, z
            enough = max(tolerance / 4, share * self.gradient)
            while self.steps < max_steps and max(np.abs(r).max(initial=0.0), np.abs(rest).max()) > enough:
                q, fixed_q = (-x for x in self.rest(p, ahead, False))
                a = rz / (p @ q + ahead @ fixed_q)
                self.v, self.beta = self.v + a * p, self.beta + a * ahead
                r, rest = r - a * q, rest - a * fixed_q
                z, solved = r / scale, np.linalg.solve(self.xx, rest)
                last, rz = rz, r @ z + rest @ solved
                p, ahead = z + rz / last * p, solved + rz / last * ahead
                self.steps += 1
            if enough > tolerance / 4:
                return False

    def effects(self) -> dict[str, DataFrame]:
        """For each factor its keys, ``effect`` and ``n``."""
        def own(block: Block, s: dict) -> pa.Table:
            return block.keys().append_column("__effect", pa.array(_left(block, s)[1])).append_column("__n", pa.array(block.sizes))

        near = bl.each(self.blocks, {self.response: "float64"} | self.types, self._shared(self.v, self.beta), own, f"{self.kinds}, `__effect` double, `__n` bigint")
        out, values = {}, bl.held(self.spark, __effect=self.v) if self.size else None
        for f, keys in self.factors.items():
            found = None
            if self.span[f].stop > self.span[f].start:
                found = self.tables[f].withColumnRenamed("n", "__n").join(values, "id").select(*self.own[f], "__effect", "__n")
            if f == self.near:
                found = near if found is None else near.unionByName(found)
            out[f] = found.select(*[F.col(self.inner[k]).alias(k) for k in keys], F.col("__effect").alias("effect"), F.col("__n").alias("n"))
        return out


def _packed(df: DataFrame, responses: list[str], covariates: list[str], factors: dict[str, list[str]]) -> Packed | None:
    """None if there are no rows, or more outer levels than the driver holds."""
    inner = {k: f"__part_{i}" for i, k in enumerate(dict.fromkeys(k for names in factors.values() for k in names))}
    kinds = dict(df.dtypes)
    xs = [as_col(c).cast("double").alias(f"x_{j + 1}") for j, c in enumerate(covariates)]
    rows = bl.cut_lineage(df.select(*[bl.plain(k, kinds[k]).alias(v) for k, v in inner.items()], *xs, *[as_col(y).cast("double").alias(f"y_{j}") for j, y in enumerate(responses)]))
    tables, sizes, n_rows = {}, {}, 0
    for f, names in factors.items():
        tables[f], sizes[f], n_rows = bl.counted(rows, [inner[k] for k in names])
    if not n_rows or sum(sizes.values()) - max(sizes.values()) > bl.HELD:
        return None
    return Packed(rows, inner, tables, sizes, n_rows, 1 + len(covariates), factors, [f"y_{j}" for j in range(len(responses))])


def fit_intercepts(df: DataFrame, y: str, covariates: list[str], factors: dict[str, list[str]],
                   tolerance: float = 1e-6, max_steps: int = 500, max_rounds: int = 30) -> MixedFit:
    """``y`` on ``covariates`` plus a random intercept per level of each factor.

    A missing key is a level of its own. ``converged`` says that the variances moved by less than
    ``tolerance`` of their sum in the last round and that no equation is off by more than ``tolerance``.
    """
    return fit_responses(df, [y], covariates, factors, tolerance, max_steps, max_rounds)[0]


def fit_responses(df: DataFrame, responses: list[str], covariates: list[str], factors: dict[str, list[str]],
                  tolerance: float = 1e-6, max_steps: int = 500, max_rounds: int = 30) -> list[MixedFit]:
    """``fit_intercepts`` of each response; rows are packed once for responses that are missing in the same rows."""
    known = [as_col(y).isNotNull() & ~F.isnan(as_col(y).cast("double")) for y in responses]
    apart = len(responses) > 1 and not df.where(F.least(*[k.cast("int") for k in known]) != F.greatest(*[k.cast("int") for k in known])).isEmpty()
    if apart:
        return [fit_intercepts(df, y, covariates, factors, tolerance, max_steps, max_rounds) for y in responses]
    complete = df.dropna(subset=[*responses, *covariates])
    packed = _packed(complete, responses, covariates, factors)
    found = []
    for j, y in enumerate(responses):
        if packed:
            packed.begin(f"y_{j}")
        found.append(_fitted(complete, y, covariates, factors, packed, tolerance, max_steps, max_rounds))
    return found


def _fitted(complete: DataFrame, y: str, covariates: list[str], factors: dict[str, list[str]], packed: Packed | None,
            tolerance: float, max_steps: int, max_rounds: int) -> MixedFit:
    design = packed or Design(complete, y, covariates, factors)
    solver = packed or Solver(design)
    noise, spread = design.variances(solver.beta)
    rounds, settled = 0, False
    share = ROUGH if packed else 0.0
    while True:
        solved = solver.solve(noise / spread, tolerance, max_steps, share) if packed else solver.solve(noise / spread, tolerance, max_steps)
        rounds += 1
        if not solved and (not share or solver.steps >= max_steps) or solved and rounds >= max_rounds:
            break
        new_noise, new_spread = design.variances(solver.beta)
        moved = max(abs(new_noise - noise), np.abs(new_spread - spread).max())
        # the last variances and the effects solved for them belong together
        still = moved <= tolerance * (new_noise + new_spread.sum())
        settled = still and solved
        if settled:
            break
        if still or rounds >= max_rounds:
            share = 0.0  # the same variances once more, to the end
        else:
            noise, spread = new_noise, new_spread
    effects = packed.effects() if packed else {}
    state = None if packed else cut_lineage(solver.state.select(F.col("id").alias("__id"), F.col("x").alias("effect")))
    for name, keys in factors.items() if not packed else ():
        effects[name] = design.tables[name].join(state, "__id").select(*[F.col(f"`{k}`") for k in keys], "effect", F.col("__n").alias("n"))
    return MixedFit(covariates, solver.beta, effects, float(noise), dict(zip(factors, map(float, spread))), solver.steps,
                    rounds, float(solver.gradient), bool(settled and solved))


def _with_effects(df: DataFrame, factors: dict, effects: dict) -> DataFrame:
    for name, keys in factors.items():
        df = left_on(df, effects[name].select(*keys, F.col("effect").alias(f"__u_{name}")), keys)
    return df


def fitted_values(df: DataFrame, fit: MixedFit, y: str, factors: dict[str, list[str]]) -> DataFrame:
    """Adds ``fitted`` and ``residual``; an unseen level has effect zero."""
    joined = _with_effects(df, factors, fit.effects)
    value = _fixed(fit.covariates, fit.beta)
    for name in factors:
        value = value + F.coalesce(F.col(f"__u_{name}"), F.lit(0.0))
    out = joined.withColumn("fitted", value).withColumn("residual", as_col(y) - F.col("fitted"))
    return out.drop(*[f"__u_{name}" for name in factors])


def effect_table(fit: MixedFit, factor: str) -> DataFrame:
    """Level effects with the half-width of a 95% interval given the other effects, sorted."""
    penalty = fit.residual_var / fit.effect_vars[factor]
    width = F.lit(1.96) * F.sqrt(F.lit(fit.residual_var) / (F.col("n") + F.lit(penalty)))
    return fit.effects[factor].withColumn("half_width", width).orderBy("effect")
