"""Least squares with one factor of any number of levels, absorbed instead of coded.

The matrix of a coded factor has a column per level. Projecting on the deviations from each level's mean gives the same
coefficients for all other terms: their cross products within levels are one grouped aggregation, and the sums of those over the
levels are all that reaches the driver. Level effects stay a table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.models.cells import independent_columns
from panelweave.models.design import Design, coded
from panelweave.models.distributions import t_two_sided


@dataclass
class AbsorbedFit:
    """Coefficients of the other terms in design order (NaN where a term is redundant), fit within levels, level means."""

    terms: list[str]
    beta: np.ndarray
    cov: np.ndarray
    measures: dict[str, float]
    df_residual: int
    factor: str
    means: DataFrame

    def rows(self, model: str) -> list[tuple]:
        out = []
        for i, term in enumerate(self.terms):
            b, variance = float(self.beta[i]), float(self.cov[i, i])
            se = math.sqrt(variance) if variance >= 0 else math.nan
            t = b / se if se else math.nan
            known = self.df_residual > 0 and not math.isnan(t)
            out.append((model, term, b, se, t, t_two_sided(t, self.df_residual) if known else math.nan))
        return out

    def effects(self) -> DataFrame:
        """A row per level: its rows ``n`` and its ``effect``, the mean outcome less what the other terms explain."""
        explained = F.lit(0.0)
        for i, b in enumerate(self.beta):
            if not math.isnan(b):
                explained = explained + F.lit(float(b)) * F.col(f"_m{i}")
        return self.means.select(self.factor, F.col("_n").alias("n"), (F.col("_my") - explained).alias("effect"))


def fit_absorbed(df: DataFrame, y: str, design: Design, factor: str) -> AbsorbedFit:
    """Regress ``y`` on the terms of ``design`` and on every level of ``factor``, without a column per level.

    Rows with a NULL in the outcome, the factor or a term are left out. A term that does not vary within levels, or that
    earlier terms determine there, is redundant. Without a complete row everything is NaN. Runs one job, an aggregation that
    combines before its shuffle, so a level with a third of all rows costs one row per task.
    """
    columns = [c for c in design.columns if c.levels or c.numeric]
    names = [f"_x{i}" for i in range(len(columns))]
    rows = coded(df.withColumns({"_y": F.col(y).cast("double"), "_level": F.col(factor)}), design)
    rows = rows.select("_level", "_y", *[F.col(f"`{c.label}`").alias(x) for c, x in zip(columns, names, strict=True)]).dropna()
    pairs = list(combinations_with_replacement([*names, "_y"], 2))
    levels = rows.groupBy("_level").agg(
        F.count("*").alias("_n"),
        F.avg("_y").alias("_my"),
        *[F.avg(x).alias(f"_m{i}") for i, x in enumerate(names)],
        *[(F.covar_pop(a, b) * F.count("*")).alias(f"_c{i}") for i, (a, b) in enumerate(pairs)],
        *[F.sum(F.col(x) * F.col(x)).alias(f"_s{i}") for i, x in enumerate(names)],
    )
    total = levels.agg(
        F.count("*").alias("levels"), F.sum("_n").alias("n"),
        *[F.sum(f"_c{i}").alias(f"c{i}") for i in range(len(pairs))],
        *[F.sum(f"_s{i}").alias(f"s{i}") for i in range(len(names))],
    ).first()

    p, n = len(names), int(total["n"] or 0)
    gram = np.zeros((p + 1, p + 1))
    place = {x: i for i, x in enumerate([*names, "_y"])}
    for i, (a, b) in enumerate(pairs):
        gram[place[a], place[b]] = gram[place[b], place[a]] = total[f"c{i}"] or 0.0
    for i in range(p):
        if gram[i, i] <= 1e-12 * (total[f"s{i}"] or 0.0):  # rounding noise of a term that is constant within levels
            gram[i, :] = gram[:, i] = 0.0
    kept = independent_columns(gram[:p, :p])
    beta, cov = np.full(p, np.nan), np.full((p, p), np.nan)
    df_residual = n - int(total["levels"]) - len(kept)
    tss, rss = float(gram[p, p]), float(gram[p, p])
    sigma2 = math.nan
    if kept:
        inner = np.ix_(kept, kept)
        solved = np.linalg.solve(gram[inner], gram[kept, p])
        rss = max(0.0, tss - float(gram[kept, p] @ solved))
        beta[kept] = solved
    if df_residual > 0:
        sigma2 = rss / df_residual
        if kept:
            cov[inner] = sigma2 * np.linalg.inv(gram[inner])
    measures = {
        "nobs": float(n), "levels": float(total["levels"]), "df_residual": float(df_residual),
        "r2_within": 1 - rss / tss if tss > 0 else math.nan,
        "sigma": math.sqrt(sigma2) if df_residual > 0 else math.nan,
    }
    means = levels.select(F.col("_level").alias(factor), "_n", "_my", *[f"_m{i}" for i in range(p)])
    return AbsorbedFit([c.label for c in columns], beta, cov, measures, df_residual, factor, means)
