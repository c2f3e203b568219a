"""Average comparisons and mean predictions of a fitted model."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column as SqlColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.models.cells import Cells
from panelweave.models.design import Column, Factor
from panelweave.models.distributions import normal_two_sided
from panelweave.models.mixed import MixedFit

_Z95 = 1.959963984540054  # 97.5 % point of the normal distribution


def _value(cells: Cells, column: Column, without: str | None = None) -> SqlColumn:
    """Value of a design column for a cell, covariates at the cell mean; ``without`` leaves one factor's test out."""
    out = F.lit(1.0)
    for name, level in column.levels:
        if name != without:
            out = out * F.when(F.col(name) == F.lit(level), 1.0).otherwise(0.0)
    return out if column.numeric is None else out * F.col(f"m_{cells.value_index(column.numeric)}")


def average_comparisons(spark: SparkSession, fit, cells: Cells, variable: Factor, by: Sequence[str] = ()) -> DataFrame:
    """Effect of moving every row from the reference to each other level, averaged within ``by``.

    The model is linear, so the average over rows is the row-weighted average over cells: exact, and
    without another pass over the data. Moving a row changes only the columns that test the variable for
    the new level, so one grouping of the cells gives the mean change of each such column. Errors follow
    from the coefficient covariance. ``s_value`` is minus the base-2 logarithm of the p-value. Effects of
    group deviations cancel as long as the variable's coefficients do not vary by group.
    """
    columns = fit.design.columns
    beta, cov = np.nan_to_num(fit.beta), np.nan_to_num(fit.cov)
    base, n = variable.levels[0], F.col("n")
    places = {level: [j for j, c in enumerate(columns) if (variable.name, level) in c.levels] for level in variable.levels[1:]}
    means = [(F.sum(n * _value(cells, columns[j], variable.name)) / F.sum(n)).alias(f"_c{j}") for own in places.values() for j in own]
    kinds = {f.name: f.dataType.simpleString() for f in cells.table.schema.fields}
    shown = [(F.initcap(F.col(b).cast("string")) if kinds[b] == "boolean" else F.col(b).cast("string")).alias(b) for b in by]
    averaged = cells.table.groupBy(*by).agg(F.sum("n").alias("_n"), *means).select(*shown, *[f"_c{j}" for own in places.values() for j in own])
    names = list(by)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for level, own in places.items():
                c = pdf[[f"_c{j}" for j in own]].to_numpy(dtype=float).reshape(len(pdf), len(own))
                estimate = c @ beta[own]
                se = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", c, cov[np.ix_(own, own)], c), 0.0))
                z = np.divide(estimate, se, out=np.full(len(pdf), np.nan), where=se > 0)
                p = np.array([normal_two_sided(v) if not math.isnan(v) else math.nan for v in z])
                s = np.array([-math.log2(v) if v > 0 else math.inf for v in p])
                head = {"term": variable.name, "contrast": f"{level} - {base}", **{b: pdf[b] for b in names}}
                yield pd.DataFrame({
                    **head, "estimate": estimate, "std_error": se, "statistic": z, "p_value": p, "s_value": s,
                    "conf_low": estimate - _Z95 * se, "conf_high": estimate + _Z95 * se,
                }, index=pdf.index)

    keys = "".join(f", `{b}` string" for b in by)
    schema = (
        f"term string, contrast string{keys}, estimate double, std_error double, statistic double, p_value double, "
        "s_value double, conf_low double, conf_high double"
    )
    return averaged.mapInPandas(compare, schema)


def mean_predictions(fit: MixedFit, by: Sequence[str]) -> DataFrame:
    """Mean prediction (fixed part plus group deviations) per combination of ``by``.

    Runs over the per-group cells: the prediction of a cell is linear in its covariate means, and
    each group's deviations join on the group key.
    """
    cells, m = fit.cells, fit.moments
    beta = np.nan_to_num(fit.beta)

    value = lambda column: _value(cells, column)
    fixed = sum((value(c) * float(b) for c, b in zip(m.columns, beta, strict=True)), F.lit(0.0))
    random = [m.columns[r] for r in fit.random]
    wide = fit.random_effects().groupBy(cells.group).agg(
        *[F.max(F.when(F.col("term") == c.label, F.col("value"))).alias(f"_b{i}") for i, c in enumerate(random)]
    )
    deviation = sum((value(c) * F.col(f"_b{i}") for i, c in enumerate(random)), F.lit(0.0))
    rows = cells.by_group.join(wide, cells.group)
    weight = F.sum("n")
    return rows.groupBy(*by).agg(
        weight.alias("n"), (F.sum(F.col("n") * (fixed + deviation)) / weight).alias("mean_prediction")
    )
