"""Distinct counts over several groupings against sets, and the shuffles they take."""

import itertools
import random

from panelweave.operators.distinct import distinct_counts

SETS = [["area", "cycle"], ["area"], ["cycle"], [], ["cycle", "area"]]


def _brute(rows, sets):
    out = {}
    for i, group in enumerate(sets):
        for key, area, cycle in rows:
            if key is not None:
                at = (i, area if "area" in group else None, cycle if "cycle" in group else None)
                out.setdefault(at, set()).add(key)
    return {k: len(v) for k, v in out.items()}


def test_equal_to_sets_with_hot_keys_nulls_and_repeats(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(60)]), rng.choice(["a", "b", None]), rng.choice([2016, 2020, None])) for _ in range(1500)]
    rows += [(7, rng.choice("abcdefghij"), rng.choice([2016, 2020])) for _ in range(900)]  # one key holds a third
    found = distinct_counts(spark.createDataFrame(rows, "cid int, area string, cycle int").repartition(5), "cid", SETS).collect()
    assert {(r["grouping"], r["area"], r["cycle"]): r["n"] for r in found} == _brute(rows, SETS)
    assert len(found) == len(_brute(rows, SETS))


def test_empty_table_has_a_total_only(spark):
    found = distinct_counts(spark.createDataFrame([], "cid int, area string, cycle int"), "cid", SETS).collect()
    assert [(r["grouping"], r["area"], r["cycle"], r["n"]) for r in found] == [(3, None, None, 0)]


def test_columns_named_like_the_key_or_the_result(spark):
    rows = [(k, k % 3) for k in range(30)]
    df = spark.createDataFrame(rows, "n int, grouping_ int").withColumnRenamed("grouping_", "_key")
    found = distinct_counts(df, "n", [["_key"], ["n"]], "people").collect()
    assert sorted((r["grouping"], r["people"]) for r in found) == sorted(itertools.chain([(0, 10)] * 3, [(1, 1)] * 30))


def test_rows_of_a_key_are_shuffled_once_for_all_groupings(spark):
    df = spark.range(1000).selectExpr("id % 50 AS cid", "id % 7 AS area", "id % 3 AS cycle")
    plans = [distinct_counts(df, "cid", SETS[:n])._jdf.queryExecution().executedPlan().toString() for n in (1, 3)]
    assert len({p.count("Exchange") for p in plans}) == 1, plans[1]
