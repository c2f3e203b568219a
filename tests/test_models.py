"""Model fits against dense-matrix computations and known special cases."""

import math

import numpy as np
import pandas as pd
import pytest

from panelweave.models.cells import collect_cells, independent_columns
from panelweave.models.contrasts import average_comparisons, mean_predictions
from panelweave.models.design import Design, Factor, Numeric, crossed, main
from panelweave.models.distributions import chi_square_tail, f_tail, normal_two_sided, t_two_sided
from panelweave.models.mixed import Groups, fit_mixed, fit_mixed_many, group_blocks, likelihood_ratio_table
from panelweave.models.ols import coefficient_table, fit_nested, fit_ols

OCC = Factor("occ", ("manager", "engineer", "other"))
SEX = Factor("sex", ("M", "F"))
TECH = Factor("tech", (False, True))
Z = Numeric("z")


def _data(n=900, groups=12, seed=5, balanced=False):
    rng = np.random.default_rng(seed)
    g = np.arange(n) % groups if balanced else rng.choice(groups, n, p=rng.dirichlet(np.ones(groups) * 3))
    occ, sex = rng.choice(OCC.levels, n), rng.choice(SEX.levels, n)
    tech = rng.random(n) < 0.4
    z = rng.normal(1000.0, 2.0, n)  # far from zero on purpose
    u = rng.normal(0, 0.7, groups)
    slope = rng.normal(0, 0.5, groups)
    y = (
        3 + 0.5 * (occ == "engineer") - 0.8 * (occ == "other") + 0.3 * (sex == "F") + 0.2 * (z - 1000)
        + 0.4 * tech * (occ == "other") + u[g] + slope[g] * (occ == "engineer") + rng.normal(0, 1.1, n)
    )
    return pd.DataFrame({"g": g.astype(int), "occ": occ, "sex": sex, "tech": tech, "z": z, "y": y})


@pytest.fixture(scope="module")
def data():
    return _data()


@pytest.fixture(scope="module")
def cells(spark, data):
    return collect_cells(spark.createDataFrame(data), "y", [OCC, SEX, TECH], ["z"], group="g")


def _matrix(pdf, design):
    cols = []
    for c in design.columns:
        x = np.ones(len(pdf))
        for name, level in c.levels:
            x = x * (pdf[name] == level)
        cols.append(x * pdf[c.numeric] if c.numeric else x)
    return np.column_stack(cols).astype(float)


FULL = Design.of([*crossed(TECH, OCC), *main(SEX, Z)])


def test_labels_and_order():
    labels = [c.label for c in Design.of(crossed(TECH, OCC)).columns]
    assert labels == [
        "(Intercept)", "techTRUE", "occengineer", "occother", "techTRUE:occengineer", "techTRUE:occother",
    ]
    assert len(crossed(TECH, OCC, SEX, order=2)) == 6


def test_least_squares_equals_dense(cells, data):
    fit = fit_ols(cells, FULL)
    x, y = _matrix(data, FULL), data["y"].to_numpy()
    xc = x.copy()
    beta, *_ = np.linalg.lstsq(xc, y, rcond=None)
    resid = y - x @ beta
    s2 = resid @ resid / (len(y) - x.shape[1])
    assert np.allclose(fit.beta, beta, rtol=1e-6, atol=1e-6)
    assert np.allclose(np.diag(fit.cov), s2 * np.diag(np.linalg.inv(x.T @ x)), rtol=1e-4)
    assert math.isclose(fit.measures["r2"], 1 - resid @ resid / ((y - y.mean()) ** 2).sum(), rel_tol=1e-9)
    assert np.abs(x.T @ (y - x @ fit.beta)).max() < 1e-3


def test_interaction_with_covariate(cells, data):
    design = Design.of(crossed(OCC, Z))
    fit = fit_ols(cells, design)
    beta, *_ = np.linalg.lstsq(_matrix(data, design), data["y"].to_numpy(), rcond=None)
    assert np.allclose(fit.beta, beta, rtol=1e-5, atol=1e-4)


def test_nested_models_share_cells(spark, cells):
    fits = fit_nested(cells, {"a": Design.of(main(OCC)), "b": Design.of(main(OCC, SEX)), "c": FULL})
    r2 = [f.measures["r2"] for f in fits.values()]
    assert r2 == sorted(r2)
    table = coefficient_table(spark, fits)
    assert table.where("model = 'a'").count() == 3


def test_redundant_column_is_dropped(spark):
    pdf = _data(200)
    pdf["copy"] = pdf["sex"]
    twin = Factor("copy", ("M", "F"))
    cells = collect_cells(spark.createDataFrame(pdf), "y", [SEX, twin])
    fit = fit_ols(cells, Design.of(main(SEX, twin)))
    assert math.isnan(fit.beta[2]) and not math.isnan(fit.beta[1])
    assert independent_columns(np.array([[1.0, 1.0], [1.0, 1.0]])) == [0]


def _dense_deviance(pdf, design, zcols, lam, reml):
    x, y = _matrix(pdf, design), pdf["y"].to_numpy() - pdf["y"].mean()
    z = x[:, zcols]
    n, p = x.shape
    v = np.eye(n)
    for g in pdf["g"].unique():
        i = np.flatnonzero(pdf["g"] == g)
        v[np.ix_(i, i)] += z[i] @ lam @ lam.T @ z[i].T
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    beta = np.linalg.solve(a, x.T @ vi @ y)
    r = y - x @ beta
    r2 = r @ vi @ r
    free = n - p if reml else n
    dev = np.linalg.slogdet(v)[1] + free * (1 + math.log(2 * math.pi * r2 / free))
    return dev + (np.linalg.slogdet(a)[1] if reml else 0.0), r2 / free


@pytest.mark.parametrize("reml", [False, True])
@pytest.mark.parametrize("random", [("(Intercept)",), ("(Intercept)", "occengineer", "occother")])
def test_mixed_likelihood_equals_dense(spark, reml, random):
    pdf = _data(160, 6)
    pdf["z"] -= 1000
    design = Design.of(main(OCC, SEX, Z))
    cells = collect_cells(spark.createDataFrame(pdf), "y", [OCC, SEX], ["z"], group="g")
    fit = fit_mixed(cells, design, random, reml=reml)
    dev, s2 = _dense_deviance(pdf, design, design.positions(random), fit.lam, reml)
    # the restricted criterion depends on the covariate origin only through a constant of zero here
    assert math.isclose(fit.measures["deviance"], dev, rel_tol=1e-7)
    assert math.isclose(fit.sigma**2, s2, rel_tol=1e-6)
    # no nearby variance does better
    rng = np.random.default_rng(0)
    for _ in range(10):
        lam = np.tril(fit.lam + rng.normal(0, 0.05, fit.lam.shape))
        assert _dense_deviance(pdf, design, design.positions(random), lam, reml)[0] >= dev - 1e-6


def test_totals_equal_sums_over_collected_blocks(spark, cells):
    from panelweave.models.mixed import _sum_terms

    design = Design.of(main(OCC, SEX, Z))
    columns = design.columns
    groups = Groups(group_blocks(cells, columns, [0]).repartition(5), 1, len(columns) + 1)
    blocks = np.array([r["block"] for r in groups.frame.collect()]).reshape(12, 1, -1)
    factors = [np.array([[x]]) for x in (0.0, 0.3, 2.0)]
    part = lambda b, lam: _sum_terms(b, lam, [0])
    assert np.allclose(groups.totals(part, factors), [part(blocks, lam) for lam in factors])


def test_a_fit_takes_few_jobs(spark, cells, monkeypatch):
    calls = []
    plain = Groups.totals
    monkeypatch.setattr(Groups, "totals", lambda self, part, factors: calls.append(len(factors)) or plain(self, part, factors))
    fit_mixed(cells, Design.of(main(OCC, SEX, Z)))
    assert len(calls) == 5
    calls.clear()
    fit_mixed(cells, Design.of(main(OCC, SEX, Z)), ("(Intercept)", "occengineer"))
    assert len(calls) <= 60
    calls.clear()
    many = fit_mixed_many(cells, {k: (Design.of(main(*v)), r) for k, v, r in (("a", [OCC], False), ("b", [SEX, Z], False), ("c", [OCC, SEX], True))})
    assert len(calls) == 5
    alone = fit_mixed(cells, Design.of(main(SEX, Z)))
    assert np.allclose(many["b"].beta, alone.beta) and math.isclose(many["b"].theta[0], alone.theta[0], rel_tol=1e-6)


def test_more_cells_than_rows_fit(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.integers(0, 60, 4000).astype(str), "b": rng.integers(0, 50, 4000).astype(str), "y": rng.normal(size=4000)})
    a, b = (Factor(c, tuple(sorted(pdf[c].unique()))) for c in "ab")
    cells = collect_cells(spark.createDataFrame(pdf), "y", [a, b])
    design = Design.of(main(a, b))
    x = _matrix(pdf, design)
    want = np.linalg.lstsq(x, pdf["y"].to_numpy(), rcond=None)[0]
    assert np.allclose(fit_ols(cells, design).beta, want, atol=1e-8)


def test_balanced_one_way_equals_anova(spark):
    pdf = _data(600, 10, balanced=True)
    cells = collect_cells(spark.createDataFrame(pdf), "y", [], [], group="g")
    fit = fit_mixed(cells, Design.of([]), reml=True)
    means = pdf.groupby("g")["y"].mean()
    within = pdf["y"] - pdf["g"].map(means)
    n_g, k = 60, 10
    msw = (within**2).sum() / (600 - k)
    msb = n_g * ((means - pdf["y"].mean()) ** 2).sum() / (k - 1)
    assert math.isclose(fit.sigma**2, msw, rel_tol=1e-6)
    assert math.isclose(fit.random_sd["(Intercept)"] ** 2, (msb - msw) / n_g, rel_tol=1e-5)


def test_no_group_variance_equals_least_squares(spark):
    rng = np.random.default_rng(3)
    pdf = _data(400, 8)
    pdf["y"] = rng.normal(0, 1, 400)
    pdf["y"] -= pdf["g"].map(pdf.groupby("g")["y"].mean())
    cells = collect_cells(spark.createDataFrame(pdf), "y", [SEX], [], group="g")
    mixed, plain = fit_mixed(cells, Design.of(main(SEX))), fit_ols(cells, Design.of(main(SEX)))
    assert mixed.theta[0] == 0.0
    assert np.allclose(mixed.beta, plain.beta)
    assert math.isclose(mixed.measures["loglik"], plain.measures["loglik"], rel_tol=1e-9)


def test_group_coefficients_and_rmse(spark, cells, data):
    design = Design.of(main(OCC, SEX, Z))
    fit = fit_mixed(cells, design, ("(Intercept)", "occengineer"))
    wide = fit.group_coefficients().toPandas().pivot(index="g", columns="term", values="value")
    x = _matrix(data, design)
    beta = wide.loc[data["g"], fit.terms].to_numpy()
    resid = data["y"].to_numpy() - (x * beta).sum(axis=1)
    assert math.isclose(math.sqrt((resid**2).mean()), fit.measures["rmse"], rel_tol=1e-6)
    pred = mean_predictions(fit, ["occ"]).toPandas().set_index("occ")["mean_prediction"]
    direct = pd.Series((x * beta).sum(axis=1)).groupby(data["occ"]).mean()
    assert np.allclose(pred[direct.index], direct, rtol=1e-9)


def test_comparisons_of_saturated_model_are_cell_mean_differences(spark, cells, data):
    fit = fit_ols(cells, Design.of(crossed(TECH, OCC)))
    out = average_comparisons(spark, fit, cells, OCC, ["tech"]).toPandas()
    means = data.groupby(["tech", "occ"])["y"].mean()
    for row in out.itertuples():
        tech = row.tech == "True"
        level = row.contrast.split(" - ")[0]
        assert math.isclose(row.estimate, means[tech, level] - means[tech, "manager"], abs_tol=1e-9)


def test_likelihood_ratio_table(spark, cells):
    small, large = fit_mixed(cells, Design.of(main(SEX))), fit_mixed(cells, Design.of(main(OCC, SEX)))
    rows = likelihood_ratio_table(spark, {"small": small, "large": large}).collect()
    assert rows[0]["chisq"] is None and rows[1]["df"] == 2
    assert math.isclose(rows[1]["chisq"], 2 * (large.measures["loglik"] - small.measures["loglik"]), rel_tol=1e-9)
    with pytest.raises(ValueError):
        likelihood_ratio_table(spark, {"a": fit_mixed(cells, Design.of(main(SEX)), reml=True)})


def test_planted_parameters_are_recovered(spark):
    pdf = _data(6000, 40, seed=11)
    cells = collect_cells(spark.createDataFrame(pdf), "y", [OCC, SEX, TECH], ["z"], group="g")
    fit = fit_mixed(cells, FULL, ("(Intercept)", "occengineer"))
    got = dict(zip(fit.terms, fit.beta, strict=True))
    assert abs(got["occother"] + 0.8) < 0.15 and abs(got["z"] - 0.2) < 0.03 and abs(got["sexF"] - 0.3) < 0.1
    assert abs(fit.sigma - 1.1) < 0.05


def test_tail_probabilities():
    assert math.isclose(normal_two_sided(1.959963984540054), 0.05, rel_tol=1e-9)
    assert math.isclose(chi_square_tail(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(chi_square_tail(20.0, 4), math.exp(-10) * 11, rel_tol=1e-9)
    assert math.isclose(t_two_sided(12.706204736432095, 1), 0.05, rel_tol=1e-8)
    assert math.isclose(f_tail(161.44763879758827, 1, 1), 0.05, rel_tol=1e-8)


def test_registered_whole_table_fits_equal_dense(spark, tmp_path):
    """Unbalanced suppliers, some without every cell, all line numbers: every line counts."""
    from panelweave.plans import registry
    from panelweave.plans.entries_models import FLAG, QTY, STATUS

    rng, n = np.random.default_rng(8), 90
    pdf = pd.DataFrame({
        "l_suppkey": rng.choice(9, n, p=rng.dirichlet(np.ones(9))) + 1, "l_linenumber": np.arange(n) % 7 + 1,
        "l_returnflag": rng.choice(FLAG.levels, n, p=[0.2, 0.5, 0.3]), "l_linestatus": rng.choice(STATUS.levels, n, p=[0.3, 0.7]),
        "l_quantity": rng.integers(1, 51, n).astype(float),
    })
    pdf["l_extendedprice"] = pdf["l_quantity"] * 900 + 8000 * (pdf["l_returnflag"] == "R") + rng.normal(0, 9000, n)
    spark.createDataFrame(pdf).write.parquet(f"{tmp_path}/lineitem.parquet")
    pdf["g"], pdf["y"] = pdf["l_suppkey"], pdf["l_extendedprice"] / 10000 + pdf["l_suppkey"] % 7 * 0.8
    design = Design.of([*crossed(FLAG, STATUS), *main(QTY)])
    low, high = 0.0, 20.0
    for _ in range(36):  # golden section
        a, b = high - 0.618034 * (high - low), low + 0.618034 * (high - low)
        less = _dense_deviance(pdf, design, [0], np.array([[a]]), True)[0] < _dense_deviance(pdf, design, [0], np.array([[b]]), True)[0]
        low, high = (low, b) if less else (a, high)
    x, y, same = _matrix(pdf, design), pdf["y"].to_numpy(), pdf["g"].to_numpy()[:, None] == pdf["g"].to_numpy()
    v = np.eye(n) + low * low * same
    cov = np.linalg.inv(x.T @ np.linalg.solve(v, x))
    beta = cov @ x.T @ np.linalg.solve(v, y)
    r = y - x @ beta
    cov *= r @ np.linalg.solve(v, r) / (n - len(beta))
    labels = [c.label for c in design.columns]
    queries, _ = registry.load()
    got = {(r["contrast"][0], r["l_linestatus"]): r for r in queries["mdl_contrasts_mixed_whole"](spark, str(tmp_path)).collect()}
    assert set(got) == {(f, s) for f in "NR" for s in "FO"}
    for (flag, status), row in got.items():
        c = np.array([float(t in (f"l_returnflag{flag}", *([f"l_returnflag{flag}:l_linestatusO"] if status == "O" else []))) for t in labels])
        assert math.isclose(row["estimate"], c @ beta, rel_tol=1e-4, abs_tol=1e-6)
        assert math.isclose(row["std_error"], math.sqrt(c @ cov @ c), rel_tol=1e-3)
    fitted = pd.Series(x @ beta + low * low * same @ np.linalg.solve(v, r)).groupby([pdf["l_returnflag"], pdf["l_linestatus"]]).agg(["size", "mean"])
    found = queries["mdl_predictions_factors_whole"](spark, str(tmp_path)).collect()
    assert sum(p["n"] for p in found) == n and len(found) == len(fitted)
    for p in found:
        assert math.isclose(p["mean_prediction"], fitted.loc[(p["l_returnflag"], p["l_linestatus"]), "mean"], rel_tol=1e-4)
