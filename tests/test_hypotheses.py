"""The model catalogue on a made-up panel, against dense-matrix computations."""

import math

import numpy as np
import pandas as pd
import pytest

from panelweave.models.design import Design, Factor, main
from panelweave.plans import hypotheses
from tests.test_models import _dense_deviance, _matrix


def _panel(n=900, insiders=True, seed=4):
    rng = np.random.default_rng(seed)
    industry = rng.choice(["Chips", "Softw", "Food", "Banks", "Rtail"], n)
    rows = pd.DataFrame({
        "cid": np.arange(n) // 3, "cycle": np.array([2016, 2018, 2020])[np.arange(n) % 3], "ff49_abbr": industry,
        "employer_matched": [f"{i}{k}" for i, k in zip(industry, rng.integers(0, 4, n), strict=True)],
        "occupation_std": rng.choice(["manager", "engineer", "other"], n), "gender": rng.choice(["M", "F", "U"], n),
        "is_sec_insider": rng.random(n) < 0.3 if insiders else np.zeros(n, dtype=bool), "ff49_is_tech": False,
    })
    shift = rows["ff49_abbr"].map({"Chips": -0.5, "Softw": -0.3, "Food": 0.4, "Banks": 0.6, "Rtail": 0.1})
    for name in ("mean_score_zipcode_wo_i", "mean_dyn_score_zipcode_cycle_wo_i"):
        rows[name] = rng.normal(0, 0.3, n)
    rows["contributor_score"] = shift + 0.2 * (rows["occupation_std"] == "engineer") + rng.normal(0, 0.5, n)
    rows["score_dyn"] = shift + 0.05 * (rows["cycle"] - 2016) + rng.normal(0, 0.5, n)
    return rows


@pytest.fixture(scope="module")
def rows():
    return _panel()


@pytest.fixture(scope="module")
def found(spark, rows):
    df = spark.createDataFrame(rows)
    return hypotheses.all_models(df, df)


def test_every_model_is_fitted_or_listed(spark, found):
    assert found.skipped == {}
    assert len(found.fits) == 2 * 4 + 4 * 3 + 2 * (4 + 2) + 2 * (4 + 2) + 2 * (5 + 1) + 2 * (7 + 1)
    assert [n.split(": ")[1] for n in found.fits if n.startswith("h4 managers")] == ["null", "+ cycle", "+ gender", "+ zip mean", "slopes", "slopes REML"]
    assert hypotheses.skipped_models(spark, found).count() == 0


def test_least_squares_of_the_first_hypothesis(found, rows):
    tech = rows.assign(ff49_is_tech=rows["ff49_abbr"].isin(["Softw", "Chips"]))
    fit = found.fits["h1 tech: + zip mean"]
    want, *_ = np.linalg.lstsq(_matrix(tech, fit.design), tech["contributor_score"].to_numpy(), rcond=None)
    assert np.allclose(fit.beta, want, atol=1e-8)


def test_mixed_model_of_the_fourth_hypothesis(found, rows):
    managers = rows[rows["occupation_std"] == "manager"].rename(columns={"ff49_abbr": "g", "score_dyn": "y"})
    fit = found.fits["h4 managers: + cycle"]
    assert fit.design == Design.of(main(Factor("cycle", (2016, 2018, 2020))))
    deviance, _ = _dense_deviance(managers, fit.design, [0], fit.lam, False)
    assert math.isclose(fit.measures["deviance"], deviance, rel_tol=1e-7)


def test_likelihood_ratios(spark, found):
    table = hypotheses.likelihood_ratio_tables(spark, found).toPandas()
    own = table[table["family"] == "h4 insiders"].sort_values("npar")
    assert own["model"].tolist() == ["null", "+ cycle", "+ gender", "+ zip mean", "slopes"]
    assert own["chisq"].isna().tolist() == [True, False, False, False, False]
    fits = found.families()["h4 insiders"]
    assert math.isclose(own["chisq"].iloc[1], 2 * (fits["+ cycle"].measures["loglik"] - fits["null"].measures["loglik"]), rel_tol=1e-9)


def test_group_coefficients(spark, found):
    table = hypotheses.group_coefficient_tables(spark, found).toPandas()
    own = table[table["model"] == "h2 occupation_std: slopes"]
    assert set(own["group"]) == {"Chips", "Softw", "Food", "Banks", "Rtail"}
    fixed = dict(zip(found.fits["h2 occupation_std: slopes"].terms, found.fits["h2 occupation_std: slopes"].beta, strict=True))
    spread = own[own["term"] == "occupation_stdengineer"]["value"]
    assert abs(spread.mean() - fixed["occupation_stdengineer"]) < 0.05
    assert own[own["term"] == "mean_score_zipcode_wo_i"]["value"].nunique() == 1


def test_contrasts_and_predictions(spark, found, rows):
    contrasts = hypotheses.contrast_tables(spark, found).toPandas()
    assert set(contrasts["model"]) == {f"h56 {part} {who}" for part in ("tech", "all") for who in ("occupation_std", "is_sec_insider")}
    own = contrasts[(contrasts["model"] == "h56 all occupation_std") & (contrasts["term"] == "occupation_std")]
    assert len(own) == 2 * 3 * 2 and (own["conf_low"] < own["estimate"]).all()
    fit = found.fits["h56 tech occupation_std: REML"]
    beta = dict(zip(fit.terms, fit.beta, strict=True))
    one = contrasts[(contrasts["model"] == "h56 tech occupation_std") & (contrasts["within"] == "cycle=2018") & (contrasts["contrast"] == "engineer - manager")]
    assert math.isclose(one["estimate"].iloc[0], beta["occupation_stdengineer"] + beta["cycle2018:occupation_stdengineer"], rel_tol=1e-9)
    predictions = hypotheses.prediction_tables(spark, found).toPandas()
    whole = predictions[predictions["model"] == "h56 all is_sec_insider"]
    assert len(whole) == 3 * 2 * 2 and whole["n"].sum() == len(rows)
    assert abs((whole["mean_prediction"] * whole["n"]).sum() / len(rows) - rows["score_dyn"].mean()) < 0.05


def test_models_that_cannot_be_fitted_are_listed(spark):
    df = spark.createDataFrame(_panel(300, insiders=False))
    found = hypotheses.all_models(df, df)
    assert found.skipped["h3 insiders tech: baseline"] == "no rows"
    assert found.skipped["h4 insiders: slopes"] == "no rows"
    assert found.skipped["h2 is_sec_insider: slopes"] == "no variation in is_sec_insiderTRUE"
    assert "h2 is_sec_insider: + who" in found.fits
