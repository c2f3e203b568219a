"""Least squares from cells."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from panelweave.models.cells import Cells, Moments
from panelweave.models.design import Design
from panelweave.models.distributions import f_tail, t_two_sided

COEFFICIENTS = "model string, term string, estimate double, std_error double, statistic double, p_value double"
FIT = "model string, measure string, value double"


@dataclass
class OlsFit:
    """Coefficients in design order (NaN where a column is redundant) and goodness of fit."""

    design: Design
    terms: list[str]
    beta: np.ndarray
    cov: np.ndarray
    measures: dict[str, float]
    df_residual: int

    def rows(self, model: str) -> list[tuple]:
        out = []
        for i, term in enumerate(self.terms):
            b, se = float(self.beta[i]), math.sqrt(self.cov[i, i]) if self.cov[i, i] >= 0 else math.nan
            t = b / se if se else math.nan
            out.append((model, term, b, se, t, t_two_sided(t, self.df_residual) if not math.isnan(t) else math.nan))
        return out


def fit_ols(cells: Cells, design: Design) -> OlsFit:
    """Least squares with the usual measures: R2, adjusted R2, AIC, BIC, log-likelihood, F and RMSE."""
    m = Moments(cells, design)
    a = m.xtx[np.ix_(m.kept, m.kept)]
    inverse = np.linalg.inv(a)
    beta = np.linalg.solve(a, m.xty[m.kept])
    p, n = len(m.kept), m.n
    rss = m.yty - float(m.xty[m.kept] @ beta)
    tss = m.yty  # the outcome is centred
    df = n - p
    variance = rss / df
    loglik = -0.5 * n * (math.log(2 * math.pi) + math.log(rss / n) + 1)
    f = ((tss - rss) / (p - 1)) / variance if p > 1 else math.nan
    measures = {
        "nobs": float(n),
        "r2": 1 - rss / tss,
        "r2_adjusted": 1 - (rss / df) / (tss / (n - 1)),
        "aic": -2 * loglik + 2 * (p + 1),
        "bic": -2 * loglik + math.log(n) * (p + 1),
        "loglik": loglik,
        "f": f,
        "f_p_value": f_tail(f, p - 1, df) if p > 1 else math.nan,
        "rmse": math.sqrt(rss / n),
        "sigma": math.sqrt(variance),
    }
    measures = {k: float(v) for k, v in measures.items()}
    full, cov = m.original(beta, variance * inverse)
    return OlsFit(design, [c.label for c in m.columns], full, cov, measures, df)


def fit_nested(cells: Cells, designs: Mapping[str, Design]) -> dict[str, OlsFit]:
    """A growing list of models over one set of cells: the data are read once and summed once for all of them."""
    cells.prepare(designs.values())
    return {name: fit_ols(cells, design) for name, design in designs.items()}


def coefficient_table(spark: SparkSession, fits: Mapping[str, object]) -> DataFrame:
    """Long coefficient table (model, term, estimate, ...) of any fits with ``rows``."""
    return spark.createDataFrame([r for name, fit in fits.items() for r in fit.rows(name)], COEFFICIENTS)


def measure_table(spark: SparkSession, fits: Mapping[str, object]) -> DataFrame:
    """Long table of goodness-of-fit measures."""
    rows = [(name, k, float(v)) for name, fit in fits.items() for k, v in fit.measures.items()]
    return spark.createDataFrame(rows, FIT)
