"""Least squares with categorical terms, penalised paths, residual comparisons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import RFormula
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.functions.missing import as_col, intercept, slope
from scoreframe.operators.grouped import attach
from scoreframe.operators.joins import left_on
from scoreframe.session import cut_lineage

MAX_LEVELS = 1_000


def levels_of(df: DataFrame, column: str) -> list:
    """Sorted categories that become columns, so at most ``MAX_LEVELS`` of them.

    For more, ``indicators`` writes them as rows and ``absorbed.fit_absorbed`` fits without writing them.
    """
    found = df.select(as_col(column)).filter(as_col(column).isNotNull()).distinct().limit(MAX_LEVELS + 1)
    rows = [r[0] for r in found.collect()]
    if len(rows) > MAX_LEVELS:
        raise ValueError(f"{column} has more than {MAX_LEVELS} categories: too many for columns, see indicators and fit_absorbed")
    return sorted(rows)


def dummies(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """0/1 columns for all but the first category of each nominal column."""
    added = {}
    for c in columns:
        for level in levels_of(df, c)[1:]:
            added[f"{c}_{level}"] = (as_col(c) == F.lit(level)).cast("double")
    return df.withColumns(added), list(added)


def indicators(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key, column, level, value 1.0): the dummies that are 1, as rows, for any number of categories.

    The first category of each column, found by one aggregation, has no rows, as it has no dummy.
    """
    first = df.agg(*[F.min(as_col(c)).alias(f"f{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), as_col(c).cast("string").alias("level"),
                               (as_col(c) > first.select(f"f{i}").scalar()).alias("later")) for i, c in enumerate(columns)])
    long = df.select(*[as_col(k) for k in key], F.explode(pairs).alias("e")).filter("e.later")
    return long.select(*[as_col(k) for k in key], "e.column", "e.level", F.lit(1.0).alias("value"))


def interactions(df: DataFrame, nominal: str, numeric: str) -> tuple[DataFrame, list[str]]:
    """Products of ``numeric`` with the dummies of ``nominal``, base category dropped."""
    added = {
        f"{numeric}_x_{level}": F.when(as_col(nominal) == F.lit(level), as_col(numeric)).otherwise(0.0)
        for level in levels_of(df, nominal)[1:]
    }
    return df.withColumns(added), list(added)


def normalise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Whole-table centring and scaling."""
    from scoreframe.operators.grouped import zscore

    return zscore(df, columns, [])


def _solved(df: DataFrame, formula: str):
    """Design rows, the solved model and its terms in order, the intercept left out."""
    design = RFormula(formula=formula, stringIndexerOrderType="alphabetDesc",
                      featuresCol="__features", labelCol="__label", handleInvalid="error")
    matrix = design.fit(df).transform(df)
    model = LinearRegression(featuresCol="__features", labelCol="__label", predictionCol="fitted",
                             regParam=0.0, solver="normal").fit(matrix)
    attributes = matrix.schema["__features"].metadata["ml_attr"]["attrs"]
    return matrix, model, [name for _, name in sorted((a["idx"], a["name"]) for kind in attributes.values() for a in kind)]


def coefficient_statistics(df: DataFrame, formula: str) -> DataFrame:
    """Per term: estimate, std_error, t, p, and the fit's r2 and residual df.

    The terms must be linearly independent and fewer than the rows.
    """
    _, model, terms = _solved(df, formula)
    found = model.summary
    values = zip([*terms, "(Intercept)"], [*model.coefficients, model.intercept],
                 found.coefficientStandardErrors, found.tValues, found.pValues)
    rows = [(term, *map(float, numbers), float(found.r2), int(found.degreesOfFreedom)) for term, *numbers in values]
    return df.sparkSession.createDataFrame(
        rows, "term string, estimate double, std_error double, t double, p double, r2 double, df long")


def fit_formula(df: DataFrame, formula: str) -> tuple[DataFrame, DataFrame]:
    """Ordinary least squares: (coefficient table, rows with fitted and residual).

    Nominal terms drop their alphabetically first category. The normal equations are
    summed in one pass over the rows.
    """
    matrix, model, terms = _solved(df, formula)
    rows = [("(Intercept)", float(model.intercept))]
    rows += [(name, float(b)) for name, b in zip(terms, model.coefficients)]
    table = df.sparkSession.createDataFrame(rows, "term string, estimate double")
    fitted = model.transform(matrix).withColumn("residual", F.col("__label") - F.col("fitted"))
    return table, fitted.drop("__features", "__label")


def double_residuals(df: DataFrame, first: str, second: str, terms: str) -> DataFrame:
    """Residuals of two scores after the same covariates: ``resid_<first>``, ``resid_<second>``."""
    out = df
    for score in (first, second):
        _, fitted = fit_formula(out, f"{score} ~ {terms}")
        out = fitted.withColumnRenamed("residual", f"resid_{score}").drop("fitted")
    return out


def fold_of(key: str, folds: int) -> Column:
    """Reproducible fold number from a hash of the row key."""
    return F.pmod(F.xxhash64(as_col(key)), F.lit(folds)).cast("int")


def moments(df: DataFrame, y: str, xs: list[str], by: list[str]) -> DataFrame:
    """Cross products of (1, xs, y) per group as one flat array: the whole data pass."""
    terms = [F.lit(1.0)] + [as_col(c).cast("double") for c in [*xs, y]]
    sums = [F.sum(terms[i] * terms[j]) for i in range(len(terms)) for j in range(i, len(terms))]
    complete = df.dropna(subset=[*xs, y])
    return complete.groupBy(*by).agg(F.array(*sums).alias("products"))


def _square(flat, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = flat
    return out + np.triu(out, 1).T


def _standardised(m: np.ndarray):
    """Centred, unit-variance cross products of one moment matrix."""
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 0.0))
    use = sd > 1e-12
    scale = np.where(use, sd, 1.0)
    gram = cov[:-1, :-1] / np.outer(scale, scale)
    return gram, cov[:-1, -1] / scale, mean, scale, use


def _penalised(gram, target, use, lam, alpha, start):
    if alpha == 0.0:
        keep = np.flatnonzero(use)
        out = np.zeros_like(target)
        out[keep] = np.linalg.solve(gram[np.ix_(keep, keep)] + lam * np.eye(keep.size), target[keep])
        return out
    b = start.copy()
    for _ in range(1000):
        before = b.copy()
        for j in np.flatnonzero(use):
            z = target[j] - gram[j] @ b + gram[j, j] * b[j]
            b[j] = np.sign(z) * max(abs(z) - lam * alpha, 0.0) / (gram[j, j] + lam * (1 - alpha))
        if np.max(np.abs(b - before)) < 1e-9:
            break
    return b


def _path(m: np.ndarray, lambdas, alpha):
    gram, target, mean, scale, use = _standardised(m)
    b, rows = np.zeros_like(target), []
    for lam in lambdas:
        b = _penalised(gram, target, use, lam, alpha, b)
        raw = b / scale
        rows.append(np.concatenate([[mean[-1] - mean[:-1] @ raw], raw]))
    return rows


def _held_out(m: np.ndarray, beta: np.ndarray) -> float:
    xx, xy, yy = m[:-1, :-1], m[:-1, -1], m[-1, -1]
    return max(yy - 2 * beta @ xy + beta @ xx @ beta, 0.0) / m[0, 0]


def select_penalty(folds: list[np.ndarray], alpha: float, n_lambdas: int, ratio: float) -> dict:
    """Cross-validated path from the moment matrices of the folds."""
    total = sum(folds)
    gram, target, *_ = _standardised(total)
    top = np.max(np.abs(target)) / max(alpha, 1e-3)
    lambdas = np.geomspace(top, top * ratio, n_lambdas)
    sizes = np.array([m[0, 0] for m in folds])
    errors = np.array([
        [_held_out(m, b) for b in _path(total - m, lambdas, alpha)] for m in folds
    ])
    mean = np.average(errors, axis=0, weights=sizes)
    spread = np.sqrt(np.average((errors - mean) ** 2, axis=0, weights=sizes) / max(len(folds) - 1, 1))
    best = int(np.argmin(mean))
    simple = int(np.flatnonzero(mean <= mean[best] + spread[best])[0])
    path = _path(total, lambdas, alpha)
    return {
        "lambda_min": float(lambdas[best]), "lambda_1se": float(lambdas[simple]),
        "cv_error": float(mean[best]), "coef_min": path[best].tolist(), "coef_1se": path[simple].tolist(),
    }


def penalised_fits(df: DataFrame, y: str, xs: list[str], by: list[str], key: str, folds: int = 10,
                   alpha: float = 1.0, n_lambdas: int = 50, ratio: float = 1e-4) -> DataFrame:
    """Cross-validated elastic net per group (``alpha`` 1 lasso, 0 ridge).

    The rows are read once, into one moment matrix per group and fold. Training
    matrices are differences of those, so any number of penalties and folds costs
    nothing more; a task then sees at most ``folds`` rows per group.
    """
    size = len(xs) + 2
    sums = moments(df.withColumn("__fold", fold_of(key, folds)), y, xs, [*by, "__fold"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_square(np.asarray(v, dtype=float), size) for v in pdf["products"]]
        fit = select_penalty(parts, alpha, n_lambdas, ratio)
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in by}, **fit}])

    types = dict(df.dtypes)
    keys = "".join(f"`{c}` {types[c]}, " for c in by)
    schema = keys + ("lambda_min double, lambda_1se double, cv_error double, "
                     "coef_min array<double>, coef_1se array<double>")
    return sums.withColumn("__all", F.lit(0)).groupBy("__all", *by).applyInPandas(solve, schema)


def _ridge(flat, size: int, penalties: list[float]) -> dict:
    """Means and scales of the predictors, and for each penalty coefficients and inverse on that scale."""
    m = _square(np.asarray(flat, dtype=float), size)
    gram, target, mean, scale, use = _standardised(m)
    gram[~use, :] = gram[:, ~use] = 0.0
    target = np.where(use, target, 0.0)
    inverses = [np.linalg.pinv(gram + lam * np.diag(use.astype(float)), rcond=1e-12, hermitian=True) for lam in penalties]
    return {"__n": float(m[0, 0]), "__my": float(mean[-1]), "__mx": mean[:-1].tolist(), "__sx": scale.tolist(),
            "__use": use.astype(float).tolist(), "__b": [(v @ target).tolist() for v in inverses],
            "__v": [v.ravel().tolist() for v in inverses]}


def left_out_predictions(df: DataFrame, y: str, xs: list[str], by: list[str], penalties: list[float],
                         out: str = "left_out") -> DataFrame:
    """Complete rows with ``out``: for each penalty the prediction from all other rows of the group.

    Ridge on predictors in units of their spread in the group, the intercept free; penalty 0 is
    least squares. Nothing is fitted again: the residual a row has when it is left out is its
    residual over one less its leverage, and leverages are quadratic forms in the inverse of the
    group's moment matrix, so the rows are read once for the moments and once for one
    expression each. Constant predictors count for nothing. NULL where a row has leverage 1, that is
    where the other rows leave its prediction open. Scales and penalty are those of all rows.
    """
    complete = df.dropna(subset=[y, *xs])
    size, p = len(xs) + 2, len(xs)
    means = attach(complete, by, **{f"__c{i}": F.avg(as_col(c)) for i, c in enumerate([*xs, y])})
    # moments about the group's means: sums of squares of large values would cancel
    about = [f"__z{i}" for i in range(p + 1)]
    rows = means.withColumns({z: as_col(c).cast("double") - F.col(f"__c{i}") for i, (z, c) in enumerate(zip(about, [*xs, y]))})
    sums = moments(rows, about[-1], about[:-1], by)

    @F.pandas_udf("__n double, __my double, __mx array<double>, __sx array<double>, __use array<double>, "
                  "__b array<array<double>>, __v array<array<double>>")
    def solve(products: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_ridge(flat, size, penalties) for flat in products])

    solved = cut_lineage(sums.filter(F.get("products", F.lit(0)) > 0).select(*by, solve("products").alias("__fit")))
    joined = left_on(rows, solved, by) if by else rows.withColumn("__fit", solved.scalar())
    joined = joined.select("*", "__fit.*")
    z = [(F.col(about[j]) - F.get("__mx", F.lit(j))) / F.get("__sx", F.lit(j)) * F.get("__use", F.lit(j)) for j in range(p)]
    joined = joined.withColumns({f"__z{j}": z[j] for j in range(p)})

    def one(i: int) -> Column:
        b, v = F.get("__b", F.lit(i)), F.get("__v", F.lit(i))
        fitted, leverage = F.col("__my"), F.lit(1.0)
        for j in range(p):
            fitted = fitted + F.get(b, F.lit(j)) * F.col(f"__z{j}")
            for k in range(p):
                leverage = leverage + F.get(v, F.lit(j * p + k)) * F.col(f"__z{j}") * F.col(f"__z{k}")
        free = 1 - leverage / F.col("__n")
        return F.when(free > 1e-9, as_col(y) - (F.col(about[-1]) - fitted) / free)

    kept = joined.withColumn(out, F.array(*[one(i) for i in range(len(penalties))]))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns], out)


def left_out_errors(predicted: DataFrame, y: str, by: list[str], penalties: list[float], column: str = "left_out") -> DataFrame:
    """Per group and penalty: mean squared left-out error, rows without one, and whether it is the least.

    Of equal errors the greatest penalty is chosen; a penalty that leaves a row open is never chosen before one that does not.
    """
    gaps = [as_col(y) - F.get(column, F.lit(i)) for i in range(len(penalties))]
    whole = predicted.groupBy(*by).agg(F.array(*[F.struct(
        F.lit(float(lam)).alias("penalty"), F.avg(g * g).alias("error"), F.count_if(g.isNull()).alias("n_open"))
        for lam, g in zip(penalties, gaps)]).alias("__all"))
    parts = [F.get("__all", F.lit(i)) for i in range(len(penalties))]
    best = F.array_min(F.array(*[F.named_struct(F.lit("o"), e["n_open"], F.lit("e"), F.coalesce(e["error"], F.lit(float("inf"))),
                                                F.lit("p"), F.lit(-float(lam))) for e, lam in zip(parts, penalties)]))
    long = whole.select(*by, (-best["p"]).alias("__best"), F.explode("__all").alias("e"))
    return long.select(*by, "e.penalty", "e.error", "e.n_open", (F.col("e.penalty") == F.col("__best")).alias("chosen"))


def predict(df: DataFrame, fits: DataFrame, xs: list[str], by: list[str], which: str = "coef_min",
            out: str = "prediction") -> DataFrame:
    """Linear prediction with each group's own coefficients."""
    beta = fits.select(*by, F.col(which).alias("__beta"))
    joined = left_on(df, beta, by) if by else df.withColumn("__beta", beta.scalar())
    value = F.get("__beta", F.lit(0))
    for i, c in enumerate(xs, 1):
        value = value + F.get("__beta", F.lit(i)) * as_col(c)
    return joined.withColumn(out, value).drop("__beta")


def optimality(df: DataFrame, fits: DataFrame, y: str, xs: list[str], by: list[str], which: str = "coef_1se",
               penalty: str = "lambda_1se", alpha: float = 1.0) -> DataFrame:
    """(by, term, estimate, pull, off): does each coefficient of a penalised fit meet its condition of optimality?

    ``pull`` is the covariance of the scaled term with the residual, from a pass over the rows that
    shares nothing with the solver's moment matrices. At the optimum it equals the penalty with the sign
    of the coefficient where that is not zero, and is at most the penalty where it is; ``off`` is by how
    much it is not so, for the intercept the mean residual. The problem is convex, so ``off`` of zero
    for all terms of a group proves the fit. A group without rows or spread has no pull and is not off.
    """
    complete = df.dropna(subset=[y, *xs])
    names = ["(Intercept)", *xs]
    residual = as_col(y) - F.col("__fitted")
    rows = predict(complete, fits, xs, by, which, "__fitted").withColumn("__r", residual)
    parts = [F.struct(F.lit(names[0]).alias("term"), F.avg("__r").alias("pull"), F.lit(1.0).alias("sd"))]
    parts += [F.struct(F.lit(c).alias("term"), F.try_divide(F.covar_pop(as_col(c).cast("double"), F.col("__r")), F.stddev_pop(as_col(c).cast("double"))).alias("pull"),
                       F.stddev_pop(as_col(c).cast("double")).alias("sd")) for c in xs]
    sums = rows.groupBy(*by).agg(F.array(*parts).alias("__parts"))
    found = sums.select(*by, F.posexplode("__parts").alias("__i", "__t"))
    known = cut_lineage(fits.select(*by, F.col(which).alias("__beta"), F.col(penalty).alias("__lambda")))
    joined = left_on(found, known, by) if by else found.withColumns(
        {"__beta": known.select("__beta").scalar(), "__lambda": known.select("__lambda").scalar()})
    b, pull, lam = F.get("__beta", F.col("__i")), F.col("__t.pull"), F.col("__lambda")
    wanted = lam * (alpha * F.signum(b) + (1 - alpha) * b * F.col("__t.sd"))
    off = F.when(F.col("__i") == 0, F.abs(pull)).when(b != 0, F.abs(pull - wanted)).otherwise(F.greatest(F.abs(pull) - lam * alpha, F.lit(0.0)))
    return joined.select(*by, "__t.term", b.alias("estimate"), pull.alias("pull"), F.coalesce(off, F.lit(0.0)).alias("off"))


def coefficient_table(fits: DataFrame, xs: list[str], by: list[str], which: str = "coef_1se") -> DataFrame:
    """One row per term, largest estimate first."""
    names = F.array(*[F.lit(n) for n in ["(Intercept)", *xs]])
    pairs = fits.select(*by, F.explode(F.arrays_zip(names.alias("term"), F.col(which).alias("estimate"))).alias("p"))
    return pairs.select(*by, "p.term", "p.estimate").orderBy(*by, F.desc("estimate"), "term")


def within_group_residual(df: DataFrame, y: str, x: str, by: list[str], out: str) -> DataFrame:
    """Residual of a per-group straight line, without an ML design."""
    fitted = attach(df, by, __b=slope(y, x), __a=intercept(y, x))
    return fitted.withColumn(out, as_col(y) - F.col("__a") - F.col("__b") * as_col(x)).drop("__a", "__b")
