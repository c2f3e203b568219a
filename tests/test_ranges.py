"""Narrowest ranges over open domains against all pairs."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from panelweave.operators import ordered, ranges

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _expected(points, rows):
    out = []
    for p in sorted({p for p in points if p is not None}):
        held = [((MOST if b is None else b) - (LEAST if a is None else a), n, i) for i, (a, b, n) in enumerate(rows) if (a is None or a <= p) and (b is None or p <= b)]
        if held:
            out.append((p, rows[min(held)[2]][2]))
    return out


def _check(spark, points, rows):
    p = spark.createDataFrame([(x,) for x in points], "p long")
    r = spark.createDataFrame(rows, "low long, high long, name string")
    got = ranges.narrowest_ranges(p, "p", r, "low", "high", ["name"]).select("p", "name").collect()
    assert sorted(map(tuple, got)) == _expected(points, rows)


@pytest.mark.parametrize("seed", range(3))
def test_ranges_of_all_lengths(spark, seed):
    rng = random.Random(seed)
    edge = [0, -1, 1, LEAST, MOST, LEAST + 1, MOST - 1, 1 << 40, -(1 << 40)]
    points = edge + [rng.randrange(-500, 500) for _ in range(200)] + [rng.randrange(LEAST, MOST) for _ in range(100)] + [None, 7, 7]
    rows = []
    for i in range(150):
        a = rng.choice([rng.randrange(-500, 500), rng.randrange(LEAST, MOST), rng.choice(edge), None])
        b = rng.choice([a, None, rng.randrange(-500, 500), rng.randrange(LEAST, MOST)]) if a is None else rng.choice([a, min(MOST, a + rng.randrange(0, 900)), min(MOST, a + rng.randrange(1, 1 << 62)), a - 1 if a > LEAST else a, None])
        rows.append((a, b, f"r{i % 90}"))
    _check(spark, points, rows)


def test_bins_are_disjoint_and_few(spark):
    rng = random.Random(2)
    rows = [(0, 0), (0, 7), (1, 6), (-8, 7), (-3, 12), (LEAST, MOST), (LEAST, -1), (5, MOST), (3, 2)]
    rows += [tuple(sorted((rng.randrange(-2000, 2000), rng.randrange(-2000, 2000)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", ranges.bins(F.col("a"), F.col("b")).alias("x"))
    for r in df.collect():
        assert len(r["x"]) <= 128
        covered = sorted((x["bin"] << x["k"], ((x["bin"] + 1) << x["k"]) - 1) for x in r["x"])
        if r["a"] > r["b"]:
            assert not covered
            continue
        assert covered[0][0] == r["a"] and covered[-1][1] == r["b"]
        assert all(e + 1 == s for (_, e), (s, _) in zip(covered, covered[1:], strict=False))


def test_dates_and_frequent_points(spark):
    day = lambda n: datetime.date(2000, 1, 1) + datetime.timedelta(n)
    p = spark.createDataFrame([(day(i % 40),) for i in range(4000)], "day date")
    r = spark.createDataFrame([(day(0), day(365), "year"), (day(10), day(19), "spell"), (day(15), None, "open"), (day(30), day(31), "two")], "low date, high date, name string")
    got = {x["day"]: (x["name"], x["low"]) for x in ranges.narrowest_ranges(p, "day", r, "low", "high").collect()}
    assert got == {day(i): ("spell", day(10)) if 10 <= i < 20 else ("two", day(30)) if i in (30, 31) else ("year", day(0)) for i in range(40)}


def test_no_ranges_and_no_points(spark):
    p, r = spark.createDataFrame([(1,)], "p long"), spark.createDataFrame([(5, 4, "x")], "low long, high long, name string")
    assert ranges.narrowest_ranges(p, "p", r, "low", "high").collect() == []
    assert ranges.narrowest_ranges(p.limit(0), "p", r.selectExpr("low", "high + 9 AS high", "name"), "low", "high").collect() == []
    plan = ranges.narrowest_ranges(p, "p", r.selectExpr("low", "high + 9 AS high", "name"), "low", "high")
    assert plan.columns == ["p", "low", "high", "name"]


def test_points_are_not_multiplied_by_widths(spark, monkeypatch):
    sizes = {}

    def counted(df, name, written=ranges.written):
        out = written(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    for module in (ranges, ordered):
        monkeypatch.setattr(module, "written", counted)
    wide = 1_000_000_000_000
    points = [(i % 700 * wide + i,) for i in range(5000)]
    rows = [(3 * i * wide, (3 * i + 1 + i % 50) * wide, f"r{i}") for i in range(200)]
    p, r = spark.createDataFrame(points, "p long"), spark.createDataFrame(rows, "low long, high long, name string")
    got = ranges.narrowest_ranges(p, "p", r, "low", "high", ["name"]).select("p", "name").collect()
    assert sorted(map(tuple, got)) == _expected([x for x, in points], rows)
    # a row per point and segment; a range has some 2 log2 of its segments, however long it is
    assert max(sizes.values()) <= len(points) + 2 * len(rows)
