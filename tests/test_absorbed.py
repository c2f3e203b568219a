"""Absorbed factors against the dense matrix with a column per level."""

import numpy as np
import pandas as pd

from panelweave.models.absorbed import fit_absorbed
from panelweave.models.design import Design, Factor, Numeric, crossed, main

SEX = Factor("sex", ("M", "F"))


def _data(n=800, levels=40, seed=2):
    rng = np.random.default_rng(seed)
    firm = np.where(rng.random(n) < 0.34, 0, rng.integers(0, levels, n))  # one level holds a third
    sex, z = rng.choice(SEX.levels, n), rng.normal(1000.0, 2.0, n) + firm
    y = 2 + 0.4 * (sex == "F") - 0.3 * (z - 1000) + 0.1 * (sex == "F") * z + rng.normal(0, 3, levels)[firm] + rng.normal(0, 1, n)
    return pd.DataFrame({"firm": firm.astype(int), "sex": sex, "z": z, "y": y, "size": firm * 2.0})


def test_equal_to_a_column_per_level(spark):
    pdf = _data()
    fit = fit_absorbed(spark.createDataFrame(pdf), "y", Design.of(crossed(SEX, Numeric("z"))), "firm")
    female = (pdf.sex == "F").to_numpy(float)
    levels = sorted(pdf.firm.unique())
    x = np.column_stack([female, pdf.z, female * pdf.z, *[(pdf.firm == k).to_numpy(float) for k in levels]])
    beta, *_ = np.linalg.lstsq(x, pdf.y.to_numpy(), rcond=None)
    rest = pdf.y.to_numpy() - x @ beta
    df = len(pdf) - x.shape[1]
    errors = np.sqrt(rest @ rest / df * np.diag(np.linalg.pinv(x.T @ x)))
    assert fit.terms == ["sexF", "z", "sexF:z"] and fit.df_residual == df
    assert np.allclose(fit.beta, beta[:3], rtol=1e-6)
    assert np.allclose([r[3] for r in fit.rows("m")], errors[:3], rtol=1e-4)
    assert abs(fit.measures["sigma"] - np.sqrt(rest @ rest / df)) < 1e-8
    effects = {r["firm"]: (r["n"], r["effect"]) for r in fit.effects().collect()}
    assert {k: n for k, (n, _) in effects.items()} == pdf.firm.value_counts().to_dict()
    assert np.allclose([effects[k][1] for k in levels], beta[3:], rtol=1e-5, atol=1e-4)


def test_redundant_terms_nulls_and_empty_tables(spark):
    pdf = _data()
    rows = spark.createDataFrame(pdf).selectExpr("*", "2 * z AS twice")
    extra = rows.limit(20).selectExpr("CAST(NULL AS BIGINT) AS firm", "sex", "z", "y", "size", "twice").unionByName(
        rows.limit(20).selectExpr("firm", "sex", "CAST(NULL AS DOUBLE) AS z", "y", "size", "twice"))
    design = Design.of(main(SEX, Numeric("z"), Numeric("size"), Numeric("twice")))
    fit = fit_absorbed(rows.unionByName(extra), "y", design, "firm")
    plain = fit_absorbed(rows, "y", Design.of(main(SEX, Numeric("z"))), "firm")
    assert fit.terms == ["sexF", "z", "size", "twice"]
    assert np.allclose(fit.beta[:2], plain.beta, rtol=1e-9) and np.isnan(fit.beta[2:]).all()
    assert fit.df_residual == plain.df_residual and fit.measures["nobs"] == len(pdf)
    empty = fit_absorbed(rows.limit(0), "y", design, "firm")
    assert np.isnan(empty.beta).all() and empty.measures["nobs"] == 0 and empty.effects().count() == 0


def test_a_level_for_every_other_row(spark):
    """100,000 levels: only cross products of the terms leave the executors."""
    df = spark.range(200_000).selectExpr("id % 100000 AS firm", "CAST(hash(id) % 1000 AS DOUBLE) / 100 AS z", "CAST(hash(id, 1) % 100 AS DOUBLE) AS e")
    rows = df.selectExpr("firm", "z", "firm % 977 + 0.25 * z + e / 1000 AS y")
    fit = fit_absorbed(rows, "y", Design.of(main(Numeric("z"))), "firm")
    assert fit.measures["levels"] == 100_000 and fit.df_residual == 99_999
    assert abs(fit.beta[0] - 0.25) < 1e-3
    off = fit.effects().selectExpr("max(abs(effect - firm % 977)) AS d").first()["d"]
    assert off < 0.2
