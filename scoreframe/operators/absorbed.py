"""Least squares with categories of any size: fixed effects are swept out, not written as columns.

Sweeping a column by the factors leaves what no sum of level effects explains. The effects
solve a sparse system, all columns side by side by conjugate gradients. Rows are packed by the
factor with the most levels (see ``blocks``), whose effects are eliminated: a step is one pass
over arrays, and the vectors, a number for each level of the other factors and column, lie on
the driver. Slopes then come from the cross products of the swept columns.

If the other factors have more levels than the driver holds, rows are collapsed to counts and
sums by level ids once. A step is then one pass over the counts, joined by level id, and one
partially aggregated sum by id; only the cross products and a few sums for each column reach
the driver, and the effects stay one table with a row for each level.
"""

from __future__ import annotations

import sys
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.functions.missing import as_col
from scoreframe.operators import blocks as bl
from scoreframe.operators.blocks import Block, scatter
from scoreframe.operators.joins import left_on
from scoreframe.operators.links import components
from scoreframe.operators.ordered import number_rows
from scoreframe.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # so that the workers need no copy of it

#: A column counts as a sum of earlier terms if less than this share of its square is left.
ALIASED = 1e-9
#: A column whose spread is less than this share of its mean is constant up to rounding.
FLAT = 1e-12


class Absorbed:
    """Effects of each factor's levels on the columns, and how the sweep ended.

    ``effects``: for each factor its keys and ``effect_<column>``; only the sum of a row's effects is
    determined, not how factors share it. ``largest`` is the greatest mean that a level of any factor
    still has in a swept column, in standard deviations of the column. ``moments``, if known: number of
    rows, cross products of the swept columns, means and standard deviations of the columns.
    """

    def __init__(self, columns, factors, effects, sizes, rank, steps, largest, converged, moments=None):
        self.columns, self.factors, self.effects, self.sizes, self.rank = columns, factors, effects, sizes, rank
        self.steps, self.largest, self.converged, self.moments = steps, largest, converged, moments

    def sweep(self, df: DataFrame) -> DataFrame:
        """Adds ``swept_<column>``; NULL where the column is, or where a level was in no complete row."""
        for name, keys in self.factors.items():
            renamed = {f"effect_{c}": f"__{name}_{c}" for c in self.columns}
            df = left_on(df, self.effects[name].withColumnsRenamed(renamed), keys)
        swept = {f"swept_{c}": reduce(lambda a, name: a - F.col(f"`__{name}_{c}`"), self.factors, as_col(c).cast("double"))
                 for c in self.columns}
        return df.withColumns(swept).drop(*[f"__{name}_{c}" for name in self.factors for c in self.columns])


def _standard(df: DataFrame, columns: list[str]):
    """The columns as numbers, what to subtract from each and to divide it by, and (means, standard deviations)."""
    value = [as_col(c).cast("double") for c in columns]
    stats = df.agg(*[F.avg(v).alias(f"m{j}") for j, v in enumerate(value)], *[F.stddev_pop(v).alias(f"s{j}") for j, v in enumerate(value)]).first()
    shift, spread = ([stats[f"{c}{j}"] or 0.0 for j in range(len(columns))] for c in "ms")
    # a column without spread is left with rounding errors, which must not be blown up
    return value, shift, [s if s and s > FLAT * abs(m) else 1.0 for m, s in zip(shift, spread)], (np.array(shift), np.array(spread))


def _level_sums(block: Block, s: dict, total: np.ndarray):
    """Into (1, columns..) sums by outer level."""
    table = total.reshape(len(s["columns"]) + 1, -1)
    for row, v in zip(table, [np.ones(block.near + len(block.far)), *[block.column[c] for c in s["columns"]]]):
        for c in s["ids"]:
            scatter(row, block.column[c], v)
        if len(block.far):
            scatter(row, block.far, v[block.near:])
    return (0.0,)


def _swept(block: Block, s: dict):
    """For each column what is left of it (of 0 without columns) once all levels are taken out, and the inner levels' effects."""
    for j, own in enumerate(s["v"]):
        rest = block.column[s["columns"][j]].copy() if s["columns"] else np.zeros(block.near + len(block.far))
        for c in s["ids"]:
            rest -= own[block.column[c]]
        if len(block.far):
            rest[block.near:] -= own[block.far]
        effects = block.by_level(rest) / block.sizes
        rest[:block.near] -= block.to_rows(effects)
        yield rest, effects


def _rest(block: Block, s: dict, total: np.ndarray):
    """Into a vector for each column the sums of what is left by outer level; cross products of the columns."""
    table, swept = total.reshape(s["v"].shape), [rest for rest, _ in _swept(block, s)]
    for row, rest in zip(table, swept):
        for c in s["ids"]:
            scatter(row, block.column[c], rest)
        if len(block.far):
            scatter(row, block.far, rest[block.near:])
    if not s["columns"]:
        return (0.0,)
    rows = np.stack(swept)
    return (rows @ rows.T).ravel()


def _reached(block: Block, s: dict, total: np.ndarray):
    """The least label next to each outer level, over the inner levels of its rows."""
    label, at, far = s["label"], block.column[s["ids"][0]], block.far
    value = label[at]
    if len(block.starts):
        value[:block.near] = block.to_rows(np.minimum.reduceat(value[:block.near], block.starts))
    if len(far):
        value[block.near:] = np.minimum(value[block.near:], label[far])
        np.minimum.at(total, far, value[block.near:])
    np.minimum.at(total, at, value)
    return (0.0,)


def _connected(blocks: DataFrame, types: dict[str, str], ids: list[str], size: int) -> int:
    """Number of connected parts: each outer level takes the least label near it, and its label's, until none changes."""
    label = np.arange(size)
    while True:
        near = bl.run(blocks, types, {"ids": ids, "label": label.astype(float)}, _reached, size, least=True)[0].astype(np.int64)
        new = label.copy()
        np.minimum.at(new, label, near)
        new = np.minimum(new, near)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return len(np.unique(label))
        label = new


def _packed(df: DataFrame, columns: list[str], factors: dict[str, list[str]], tolerance: float, max_steps: int) -> Absorbed | None:
    """None if there are no rows, or more outer levels and columns than the driver holds."""
    value, shift, scale, stats = _standard(df, columns)
    inner = {k: f"__part_{i}" for i, k in enumerate(dict.fromkeys(k for names in factors.values() for k in names))}
    kinds, names = dict(df.dtypes), [f"b{j}" for j in range(len(columns))]
    rows = bl.cut_lineage(df.select(*[bl.plain(k, kinds[k]).alias(v) for k, v in inner.items()],
                                    *[((v - F.lit(m)) / F.lit(s)).alias(b) for v, m, s, b in zip(value, shift, scale, names)]))
    own = {f: [inner[k] for k in keys] for f, keys in factors.items()}
    tables, sizes, n_rows = {}, {}, 0
    for f in factors:
        tables[f], sizes[f], n_rows = bl.counted(rows, own[f])
    if not n_rows or (sum(sizes.values()) - max(sizes.values())) * len(columns) > bl.HELD:
        return None
    known, ids, span, outer, near, size = bl.laid_out(rows, own, tables, sizes)
    types, numbers = {c: "int32" for c in ids}, {b: "float64" for b in names}
    blocks = bl.pack(known, own[near], ids, numbers, n_rows)
    width = len(columns)
    n = bl.run(blocks, numbers | types, {"ids": ids, "columns": names}, _level_sums, (width + 1) * size)[0].reshape(width + 1, size)[0]

    def left(v: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        total, few = bl.run(blocks, (numbers if whole else {}) | types, {"ids": ids, "v": v, "columns": names if whole else []}, _rest, v.size)
        return total.reshape(v.shape), few.sum(axis=0)

    def worst(r: np.ndarray) -> np.ndarray:
        return (np.abs(r) / n).max(axis=1, initial=0.0)

    x, steps = np.zeros((width, size)), 1  # taking out the inner levels is the first step
    while True:
        r, cross = left(x, True)
        largest = worst(r).max()
        if largest <= tolerance or steps >= max_steps:
            break
        z = r / n
        rz, p = (r * z).sum(axis=1), z
        while steps < max_steps and worst(r).max() > tolerance / 4:
            q = -left(p, False)[0]
            pq = (p * q).sum(axis=1)
            moving = (worst(r) > tolerance / 4) & (pq > 0)  # a column that has come to rest stays as it is
            a = np.where(moving, rz / np.where(moving, pq, 1.0), 0.0)
            x, r = x + a[:, None] * p, r - a[:, None] * q
            z = r / n
            new = np.where(moving, (r * z).sum(axis=1), rz)
            p = np.where(moving[:, None], z + (new / np.where(rz > 0, rz, 1.0))[:, None] * p, p)
            rz, steps = new, steps + 1
    rank = sizes[near] if len(factors) == 1 else sum(sizes.values()) - _connected(blocks, types, ids, size) if len(factors) == 2 else None
    real = [f"__effect_{j}" for j in range(width)]
    offset = {f: [m if i == 0 else 0.0 for m in shift] for i, f in enumerate(factors)}  # the first factor also takes what was subtracted

    def effects(block: Block, s: dict) -> pa.Table:
        out = block.keys()
        for j, (_, found) in enumerate(_swept(block, s)):
            out = out.append_column(real[j], pa.array(found * scale[j] + offset[near][j]))
        return out

    schema = ", ".join([bl.key_types(rows, own[near]), *[f"`{c}` double" for c in real]])
    inside = bl.each(blocks, numbers | types, {"ids": ids, "v": x, "columns": names}, effects, schema)
    out, values = {}, bl.held(df.sparkSession, **{c: row * s for c, row, s in zip(real, x, scale)}) if size else None
    for f, keys in factors.items():
        found = inside if f == near else None
        if span[f].stop > span[f].start:
            of_outer = outer[f].join(values, "id").select(*own[f], *[(F.col(c) + F.lit(float(m))).alias(c) for c, m in zip(real, offset[f])])
            found = of_outer if found is None else found.unionByName(of_outer)
        out[f] = found.select(*[F.col(inner[k]).alias(k) for k in keys], *[F.col(e).alias(f"effect_{c}") for e, c in zip(real, columns)])
    moments = (n_rows, cross.reshape(width, width) * np.outer(scale, scale), *stats)
    return Absorbed(columns, factors, out, sizes, rank, steps, float(largest), bool(largest <= tolerance), moments)


def _collapsed(df: DataFrame, columns: list[str], factors: dict[str, list[str]]):
    """(counts by level ids, level tables with keys, all levels as (id, f, n, b0..), mean and spread of each column)."""
    value, shift, scale, _ = _standard(df, columns)
    keys = {k: f"__key_{i}" for i, k in enumerate(dict.fromkeys(k for names in factors.values() for k in names))}
    sums = [f"b{j}" for j in range(len(columns))]
    rows = cut_lineage(df.select(*[F.col(f"`{k}`").alias(v) for k, v in keys.items()],
                                 *[((v - F.lit(m)) / F.lit(s)).alias(b) for v, m, s, b in zip(value, shift, scale, sums)])
                       .groupBy(*keys.values()).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(b).alias(b) for b in sums]))
    tables, levels, sizes, first = {}, [], [], 0
    for f, (name, names) in enumerate(factors.items()):
        own = [keys[k] for k in names]
        found = rows.groupBy(*own).agg(F.sum("n").alias("n"), *[F.sum(b).alias(b) for b in sums])
        table = cut_lineage(number_rows(found, own, "__place").withColumn("id", (F.col("__place") + first - 1).cast("bigint")).drop("__place"))
        rows = left_on(rows, table.select(*own, F.col("id").alias(f"id_{f}")), own)
        tables[name] = table.select(F.col("id").alias("__id"), *[F.col(keys[k]).alias(k) for k in names])
        levels.append(table.select("id", F.lit(f).alias("f"), "n", *sums))
        sizes.append(table.count())
        first += sizes[-1]
    return cut_lineage(rows.select(*[f"id_{f}" for f in range(len(factors))], "n")), tables, reduce(DataFrame.unionByName, levels), sizes, shift, scale


def _product(cells: DataFrame, n_factors: int, vector: DataFrame, width: int) -> DataFrame:
    """(id, q0..): for each level the sum over its rows of the vector's values at all levels of the row."""
    rows = cells
    for f in range(n_factors):
        own = vector.where(F.col("f") == f).select(F.col("id").alias(f"id_{f}"), *[F.col(f"p{j}").alias(f"p{f}_{j}") for j in range(width)])
        rows = rows.join(own, f"id_{f}")
    total = [(F.col("n") * reduce(add, [F.col(f"p{f}_{j}") for f in range(n_factors)])).alias(f"t{j}") for j in range(width)]
    parts = F.explode(F.array(*[F.struct(F.col(f"id_{f}").alias("id"), *total) for f in range(n_factors)])).alias("e")
    return rows.select(parts).groupBy("e.id").agg(*[F.sum(f"e.t{j}").alias(f"q{j}") for j in range(width)])


def _each(width: int, make) -> list[Column]:
    return [c for j in range(width) for c in make(j)]


def absorb(df: DataFrame, columns: list[str], factors: dict[str, list[str]],
           tolerance: float = 1e-9, max_steps: int = 1000) -> Absorbed:
    """Effects of the levels of ``factors`` (name: key columns) on each of ``columns``.

    Rows with a missing value in a column are left out; a missing key is a level of its own. An
    empty table has no effects and has converged. Columns and levels in any number: the state is
    a row for each level, the work of a step a row for each combination of levels that occurs.
    """
    if not factors or not columns:
        raise ValueError("name at least one factor and one column")
    df = df.dropna(subset=columns)
    if (found := _packed(df, columns, factors, tolerance, max_steps)) is not None:
        return found
    cells, tables, levels, sizes, shift, scale = _collapsed(df, columns, factors)
    width, k = len(columns), len(factors)
    state = levels.select("id", "f", "n", *_each(width, lambda j: [F.col(f"b{j}"), F.lit(0.0).alias(f"x{j}")]))
    steps, largest, ended = 0, 0.0, sum(sizes) == 0
    n = F.col("n")
    while not ended:
        # from the effects themselves: what is left in each level
        vector = state.withColumns({f"p{j}": F.col(f"x{j}") for j in range(width)})
        table = cut_lineage(state.join(_product(cells, k, vector, width), "id").select(
            "id", "f", "n", *_each(width, lambda j: [F.col(f"b{j}"), F.col(f"x{j}"), (F.col(f"b{j}") - F.col(f"q{j}")).alias(f"r{j}")])))
        row = table.agg(*_each(width, lambda j: [F.max(F.abs(F.col(f"r{j}")) / n).alias(f"most{j}"), F.sum(F.col(f"r{j}") ** 2 / n).alias(f"rz{j}")])).first()
        largest = max(row[f"most{j}"] for j in range(width))
        if largest <= tolerance or steps >= max_steps:
            break
        rz = np.array([row[f"rz{j}"] for j in range(width)])
        state = table.withColumns({f"p{j}": F.col(f"r{j}") / n for j in range(width)})
        while steps < max_steps:
            table = cut_lineage(state.join(_product(cells, k, state, width), "id"))
            row = table.agg(*_each(width, lambda j: [
                F.max(F.abs(F.col(f"r{j}")) / n).alias(f"most{j}"), F.sum(F.col(f"p{j}") * F.col(f"q{j}")).alias(f"pq{j}"),
                F.sum(F.col(f"r{j}") ** 2 / n).alias(f"rr{j}"), F.sum(F.col(f"r{j}") * F.col(f"q{j}") / n).alias(f"rq{j}"),
                F.sum(F.col(f"q{j}") ** 2 / n).alias(f"qq{j}")])).first()
            if max(row[f"most{j}"] for j in range(width)) <= tolerance / 4:
                break
            ahead, turn = np.zeros(width), np.zeros(width)
            for j in range(width):
                # a column that has come to rest stays as it is
                if row[f"most{j}"] > tolerance / 4 and row[f"pq{j}"] > 0:
                    ahead[j] = rz[j] / row[f"pq{j}"]
                    new = max(row[f"rr{j}"] - 2 * ahead[j] * row[f"rq{j}"] + ahead[j] ** 2 * row[f"qq{j}"], 0.0)
                    turn[j], rz[j] = new / rz[j], new
            left = [F.col(f"r{j}") - F.lit(float(ahead[j])) * F.col(f"q{j}") for j in range(width)]
            state = table.select("id", "f", "n", *_each(width, lambda j: [
                F.col(f"b{j}"), (F.col(f"x{j}") + F.lit(float(ahead[j])) * F.col(f"p{j}")).alias(f"x{j}"), left[j].alias(f"r{j}"),
                (left[j] / n + F.lit(float(turn[j])) * F.col(f"p{j}")).alias(f"p{j}")]))
            steps += 1
        state = state.select("id", "f", "n", *_each(width, lambda j: [F.col(f"b{j}"), F.col(f"x{j}")]))
    state = cut_lineage(state)
    effects = {}
    for f, (name, keys) in enumerate(factors.items()):
        # the first factor also takes what was subtracted from the column beforehand
        found = [(F.col(f"x{j}") * F.lit(float(scale[j])) + F.lit(float(shift[j]) if f == 0 else 0.0)).alias(f"effect_{c}") for j, c in enumerate(columns)]
        effects[name] = tables[name].join(state.select(F.col("id").alias("__id"), *found), "__id").drop("__id")
    rank = sizes[0] if k == 1 else None
    if k == 2:
        # each connected part of the levels has one shift that moves no row
        linked = components(cells.select(F.col("id_0").alias("level"), F.col("id_1").alias("other")), "level", "other")
        rank = sum(sizes) - linked.select("component").distinct().count()
    return Absorbed(columns, factors, effects, dict(zip(factors, sizes)), rank, steps, float(largest), bool(largest <= tolerance))


def _slopes(products: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes and the diagonal of the inverse; a term that earlier ones or the factors explain gets NaN."""
    gram, target = products[1:, 1:], products[1:, 0]
    kept: list[int] = []
    for j in range(len(target)):
        rest = gram[j, j]
        if kept:
            rest -= gram[j, kept] @ np.linalg.solve(gram[np.ix_(kept, kept)], gram[kept, j])
        if rest > ALIASED * max(spread[j], 1e-300):
            kept.append(j)
    beta, inverse = np.full(len(target), np.nan), np.full(len(target), np.nan)
    if kept:
        scale = np.sqrt(np.diag(gram)[kept])
        found = np.linalg.inv(gram[np.ix_(kept, kept)] / np.outer(scale, scale)) / np.outer(scale, scale)
        beta[kept], inverse[kept] = found @ target[kept], np.diag(found)
    return beta, inverse


def fit_absorbed(df: DataFrame, y: str, xs: list[str], factors: dict[str, list[str]],
                 tolerance: float = 1e-9, max_steps: int = 1000) -> tuple[DataFrame, DataFrame]:
    """``y`` on ``xs`` with an intercept for each level of each factor: (terms, rows with residual).

    Terms: term, estimate, std_error, t, df, steps, converged. A term that the factors or the
    terms before it explain has a NULL estimate. Residual degrees of freedom, and so errors, are
    exact for one and two factors (levels without one for each connected part of two factors'
    levels); for more they are NULL. Rows with a missing value in ``y`` or ``xs`` are left out.
    """
    complete = df.dropna(subset=[y, *xs])
    names = list(dict.fromkeys([y, *xs]))
    found = absorb(complete, names, factors, tolerance, max_steps)
    swept = found.sweep(complete)
    columns = [F.col(f"`swept_{c}`") for c in [y, *xs]]
    size = len(columns)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    if found.moments:
        n, products, means, spread = found.moments
        at, of_xs = [names.index(c) for c in (y, *xs)], [names.index(c) for c in xs]
        products, means, spread = products[np.ix_(at, at)], means[of_xs], spread[of_xs] ** 2
    else:
        row = swept.agg(F.count(F.lit(1)).alias("n"), *[F.sum(columns[i] * columns[j]).alias(f"s{i}_{j}") for i, j in pairs],
                        *_each(len(xs), lambda j: [F.var_pop(as_col(xs[j]).cast("double")).alias(f"v{j}"), F.avg(as_col(xs[j])).alias(f"m{j}")])).first()
        n, products = row["n"], np.array([[row[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(size)] for i in range(size)])
        spread, means = (np.array([row[f"{c}{j}"] or 0.0 for j in range(len(xs))]) for c in "vm")
    constant = np.sqrt(spread) <= FLAT * np.abs(means)
    beta, inverse = _slopes(products, np.where(constant, np.inf, spread * n))
    known = ~np.isnan(beta)
    freedom = None if found.rank is None else int(n - found.rank - known.sum())
    rest = max(products[0, 0] - beta[known] @ products[1:, 0][known], 0.0)
    terms = []
    for c, b, v in zip(xs, beta, inverse):
        error = float(np.sqrt(rest / freedom * v)) if freedom and freedom > 0 and not np.isnan(b) else None
        terms.append((c, None if np.isnan(b) else float(b), error, float(b) / error if error else None, freedom, found.steps, found.converged))
    table = df.sparkSession.createDataFrame(
        terms, "term string, estimate double, std_error double, t double, df long, steps int, converged boolean")
    fitted = reduce(add, [F.lit(float(b)) * c for b, c, k in zip(beta, columns[1:], known) if k], F.lit(0.0))
    return table, swept.withColumn("residual", columns[0] - fitted).drop(*[f"swept_{c}" for c in names])


def interaction_terms(df: DataFrame, y: str, x: str, nominal: str) -> DataFrame:
    """Terms of ``y`` on ``x``, a category and their products, for any number of categories.

    Every category has its own line, so one aggregation gives all terms: the line of the first
    category, and for every other one the differences of intercept and slope from it.
    """
    from scoreframe.functions.missing import intercept, slope

    lines = cut_lineage(df.dropna(subset=[y, x, nominal]).groupBy(as_col(nominal).alias("level")).agg(
        slope(y, x).alias("b"), intercept(y, x).alias("a")))
    first = lines.select(F.min("level").alias("level")).scalar()
    base = lines.filter(F.col("level") == first).select(F.col("a").alias("a0"), F.col("b").alias("b0"))
    a0, b0 = base.select("a0").scalar(), base.select("b0").scalar()
    named = lambda prefix: F.concat(F.lit(prefix), F.col("level").cast("string"))
    is_base = F.col("level") == first
    parts = F.explode(F.array(
        F.struct(F.when(is_base, "(Intercept)").otherwise(named(f"{nominal}_")).alias("term"),
                 F.when(is_base, F.col("a")).otherwise(F.col("a") - a0).alias("estimate")),
        F.struct(F.when(is_base, x).otherwise(named(f"{x}_x_")).alias("term"),
                 F.when(is_base, F.col("b")).otherwise(F.col("b") - b0).alias("estimate")))).alias("t")
    return lines.select(parts).select("t.term", "t.estimate")
