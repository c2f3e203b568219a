"""Radix selection against numpy, over values of every size, and the way taken for very many groups."""

import math
import random
import struct

import numpy as np
import pytest

from panelweave.operators import describe, selection

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)


def _any_double(rng):
    while True:
        x = struct.unpack("<d", rng.randbytes(8))[0]
        if math.isfinite(x):
            return x


def _groups():
    rng = random.Random(11)
    near = [1.0 + i * 2.0**-52 for i in range(3000)]  # neighbours, all of one code
    return {
        "bits": [_any_double(rng) / 4 for _ in range(2001)],
        "near": near,
        "ties": [0.5] * 900 + [-0.0, 0.0, 1e-300, -1e-300, 5e-324, -5e-324] * 3,
        "one": [3.25],
        "two": [-1.0, 4.0],
        "prices": [round(rng.uniform(900, 100_000), 2) for _ in range(5000)],
        None: [rng.gauss(0, 1) for _ in range(1000)],
    }


@pytest.mark.parametrize("most", [selection.MOST_GROUPS, 1])
def test_quantiles_and_boxes(spark, monkeypatch, most):
    monkeypatch.setattr(selection, "MOST_GROUPS", most)
    groups = _groups()
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("unknown", None), ("one", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    assert (selection.selected_quantiles(df, ["g"], "x", PROBS) is None) == (most == 1)
    found = {r["g"]: r for r in describe.quantiles(df, ["g"], "x", PROBS).collect()}
    assert set(found) == set(groups)
    for g, xs in groups.items():
        ordered = sorted(xs)
        assert found[g]["n"] == len(xs)
        for i, p in enumerate(PROBS):
            place = (len(xs) - 1) * p
            low, high = ordered[math.floor(place)], ordered[math.ceil(place)]
            assert found[g][f"q{i}"] == low + (high - low) * (place - math.floor(place)), (g, p)
    boxes = {r["g"]: r for r in describe.box_stats(df, ["g"], "x").collect()}
    for g, xs in groups.items():
        q1, q3 = found[g]["q2"], found[g]["q4"]
        inside = [x for x in xs if q1 - 1.5 * (q3 - q1) <= x <= q3 + 1.5 * (q3 - q1)]
        assert (boxes[g]["whisker_lo"], boxes[g]["whisker_hi"]) == (min(inside), max(inside))
        assert boxes[g]["n_outliers"] == len(xs) - len(inside) and boxes[g]["n"] == len(xs)


def test_codes_never_fall_and_seldom_meet(spark):
    rng = random.Random(5)
    xs = sorted({0.0, math.inf, -math.inf, 5e-324, -5e-324, 1.7976931348623157e308, *[_any_double(rng) for _ in range(4000)]}) + [math.nan]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    codes = [r["c"] for r in df.select("i", selection._code(df["x"]).alias("c")).orderBy("i").collect()]
    assert codes == sorted(codes) and len(set(codes)) == len(codes)
    assert max(map(abs, codes)) < 2**42


def test_no_groups_and_no_rows(spark):
    xs = [float(v) for v in np.random.default_rng(0).normal(size=501)]
    whole = describe.quantiles(spark.createDataFrame([(x,) for x in xs], "x double"), [], "x", [0.25]).collect()
    assert len(whole) == 1 and abs(whole[0]["q0"] - np.quantile(xs, 0.25)) < 1e-12
    empty = spark.createDataFrame([], "g string, x double")
    assert describe.quantiles(empty, ["g"], "x", [0.5]).count() == describe.box_stats(empty, [], "x").count() == 0
