"""Covariance between traits, its composition from parts, and its eigenvalues."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.functions.missing import all_present, as_col, correlation
from scoreframe.operators.joins import left_on


def trait_pairs(traits: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(traits) for b in traits[i:]]


def pair_statistics(wide: DataFrame, traits: list[str], by: list[str], stat=F.covar_samp,
                    out: str = "value") -> DataFrame:
    """(by, trait_i, trait_j, value) for i <= j, all pairs in one aggregation.

    A group with a missing score of either trait has no value for the pair.
    """
    pairs = trait_pairs(traits)
    cells = [
        F.when(all_present(a) & all_present(b), stat(as_col(a), as_col(b))).alias(f"p{i}")
        for i, (a, b) in enumerate(pairs)
    ]
    wide_cells = wide.groupBy(*by).agg(*cells)
    entries = F.array(*[
        F.struct(F.lit(a).alias("trait_i"), F.lit(b).alias("trait_j"), F.col(f"p{i}").alias(out))
        for i, (a, b) in enumerate(pairs)
    ])
    return wide_cells.select(*by, F.explode(entries).alias("e")).select(*by, "e.*")


def trait_correlations(wide: DataFrame, traits: list[str], shrink: float = 0.1) -> np.ndarray:
    """Correlations over the rows that have both traits, drawn towards 0 by ``shrink``.

    One aggregation and one row of k (k - 1) / 2 numbers. Pairs without two different values on both
    sides count as 0. The result serves as the prior of the correlated fits.
    """
    k = len(traits)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    out = np.eye(k)
    if pairs:
        row = wide.agg(*[correlation(as_col(traits[i]), as_col(traits[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
        for i, j in pairs:
            value = row[f"c{i}_{j}"]
            out[i, j] = out[j, i] = 0.0 if value is None or np.isnan(value) else (1.0 - shrink) * value
    return out


def compose(common: DataFrame, specific: DataFrame, scales: DataFrame, rho: float) -> DataFrame:
    """diag(tau) (rho Omega + (1 - rho) Omega_g) diag(tau) per group, as a long table.

    ``common``: (trait_i, trait_j, omega); ``specific``: (grp, trait_i, trait_j,
    omega_g); ``scales``: (grp, trait, tau).
    """
    cells = left_on(specific, common, ["trait_i", "trait_j"])
    for side in ("i", "j"):
        tau = scales.withColumnRenamed("tau", f"tau_{side}")
        cells = left_on(cells, tau, ["grp", (f"trait_{side}", "trait")])
    mix = F.lit(rho) * F.col("omega") + F.lit(1.0 - rho) * F.col("omega_g")
    return cells.select("grp", "trait_i", "trait_j", (F.col("tau_i") * F.col("tau_j") * mix).alias("sigma"))


def variance_explained(pairs: DataFrame, traits: list[str], by: list[str], value: str = "value") -> DataFrame:
    """Eigenvalues per group, largest first, with their cumulative share.

    A group arrives as one row holding its k (k + 1) / 2 numbers.
    """
    k = len(traits)
    cells = [
        F.max(F.when((F.col("trait_i") == a) & (F.col("trait_j") == b), as_col(value)))
        for a, b in trait_pairs(traits)
    ]
    packed = pairs.groupBy(*by).agg(F.array(*cells).alias("cells"))

    @F.pandas_udf("array<double>")
    def eigenvalues(flat: pd.Series) -> pd.Series:
        upper = np.triu_indices(k)

        def solve(v):
            m = np.zeros((k, k))
            m[upper] = v
            if not np.isfinite(m).all():
                return None
            return np.linalg.eigvalsh(m + np.triu(m, 1).T)[::-1].tolist()

        return flat.map(lambda v: solve(np.array([np.nan if x is None else x for x in v], dtype=float)))

    values = packed.withColumn("ev", eigenvalues("cells")).filter("ev IS NOT NULL")
    long = values.select(*by, "ev", F.posexplode("ev").alias("pos", "eigenvalue"))

    def add(part):
        return F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x)

    share = F.try_divide(add(F.slice("ev", F.lit(1), F.col("pos") + 1)), add(F.col("ev")))
    return long.select(*by, (F.col("pos") + 1).alias("component"), "eigenvalue", share.alias("cum_share"))
