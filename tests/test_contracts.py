"""Semantic contracts on rows built by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelweave.functions.names import company_key, looks_like_entity, with_person_parts
from panelweave.functions.occupation import occupation_flags
from panelweave.functions.picks import first_by, last_by, longest
from panelweave.functions.scores import amount_weight, clean_ticker, even_cycle, filing_date, insider_now, tech_flag
from panelweave.operators import describe, industry, insiders, local_means, ordered, panel, sampling
from panelweave.operators.skew import hot_split_join

D = dt.date


def one(df):
    return df.first()


def test_first_by_skips_null_values_and_null_dates(spark):
    df = spark.createDataFrame(
        [(None, D(2020, 1, 1), 1), ("p", D(2020, 1, 2), 2), ("q", D(2020, 1, 3), 3), ("r", None, 4)], "x string, d date, id long"
    )
    assert one(df.agg(first_by(F.col("x"), F.col("d"), F.col("id"))))[0] == "p"
    assert one(df.agg(last_by(F.col("x"), F.col("d"), F.col("id"))))[0] == "q"
    only_null = spark.createDataFrame([(None, D(2020, 1, 1)), ("x", None)], "x string, d date")
    assert one(only_null.agg(first_by(F.col("x"), F.col("d"))))[0] is None


def test_first_by_breaks_ties_by_id(spark):
    df = spark.createDataFrame([("b", D(2020, 1, 1), 2), ("a", D(2020, 1, 1), 9)], "x string, d date, id long")
    assert one(df.agg(first_by(F.col("x"), F.col("d"), F.col("id"))))[0] == "b"


def test_longest(spark):
    df = spark.createDataFrame([("ab",), (None,), ("abc",), ("abd",)], "x string")
    assert one(df.agg(longest(F.col("x"))))[0] == "abd"


@pytest.mark.parametrize(
    "amount,weight", [(None, None), (-1.0, 0), (0.0, 0), (1.0, 1), (100.0, 1), (100.01, 2), (101.0, 2), (4999.99, 50), (5000.0, 50), (9000.0, 50)]
)
def test_amount_weight(spark, amount, weight):
    df = spark.createDataFrame([(amount,)], "a double")
    assert one(df.select(amount_weight(F.col("a"))))[0] == weight


def test_pooled_scores(spark):
    sums = spark.createDataFrame([(1, 2014, 1.0, 1.0), (1, 2016, 0.0, 3.0)], "cid long, cycle long, num double, den double")
    got = {r["cycle"]: r["score_dyn"] for r in panel.pooled_scores(sums).collect()}
    assert got == {2014: 1.0, 2016: 0.25, 2018: 0.0}


TXN = (
    "txn_id long, cid long, cycle long, amount double, date date, contributor_type string, txn_type string, "
    "candidate_score double, employer string, contributor_score double"
)


def _txn(spark, rows):
    return spark.createDataFrame(rows, TXN)


def test_panel_pools_exactly_the_cycle_before(spark):
    rows = [
        (1, 7, 2014, 100.0, D(2014, 3, 1), "I", "15", 1.0, "old", 0.1),
        (2, 7, 2016, 300.0, D(2016, 3, 1), "I", "15", 0.0, None, 0.1),
        (3, 7, 2016, 50.0, D(2016, 4, 1), "I", "10", 9.0, "new", 0.1),  # type outside the list
        (4, 7, 2016, 50.0, D(2016, 2, 1), "C", "15", 9.0, "firm", 0.1),  # not an individual
        (5, None, 2016, 50.0, D(2016, 2, 1), "I", "15", 1.0, "nobody", 0.1),
        (6, 8, 2016, None, D(2016, 2, 1), "I", "15", 1.0, "x", None),
        (7, 9, 2014, 100.0, D(2014, 2, 1), "I", "15", 1.0, "only before", None),
    ]
    out = panel.person_cycle_panel(_txn(spark, rows), [2016], attributes=["employer", "contributor_score"])
    got = {r["cid"]: r for r in out.collect()}
    assert set(got) == {7, 8, None}
    assert got[7]["score_dyn"] == 0.25 and got[7]["employer"] == "new" and got[7]["n_transactions_per_cycle"] == 2
    assert got[8]["score_dyn"] is None and got[8]["total_amount"] is None
    assert got[None]["score_dyn"] is None


def test_panel_deals_known_persons_once(spark):
    """Grouping and look-back of a person share one shuffle; only rows without a person are dealt again, by their aggregates."""
    rows = [(i, cid, c, 100.0, D(2016, 3, i), "I", "15", s, e, 0.1) for i, (cid, c, s, e) in enumerate(
        [(7, 2014, 1.0, "a"), (7, 2016, 0.0, None), (7, 2016, 1.0, "b"), (None, 2016, 1.0, "x"), (None, 2014, 1.0, "y"), (None, 2016, 0.0, "z")], 1)]
    out = panel.person_cycle_panel(_txn(spark, rows), [2016], attributes=["employer"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    dealt = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning(cid" in line]
    known, *unknown = dealt
    assert ", cycle" not in known and len(unknown) == 2
    assert sorted(map(str, out.select("cid", "employer", "n_transactions_per_cycle", "score_dyn").collect())) == [
        "Row(cid=7, employer='b', n_transactions_per_cycle=2, score_dyn=0.6666666666666666)",
        "Row(cid=None, employer='x', n_transactions_per_cycle=2, score_dyn=None)",
    ]


def test_panel_ignores_odd_cycles_between(spark):
    rows = [(i, 7, c, 100.0, D(2014, 3, 1), "I", "15", s, "e", 0.1) for i, (c, s) in enumerate([(2014, 1.0), (2015, 50.0), (2016, 0.0)])]
    scores = panel.pooled_scores(panel.weighted_sums(_txn(spark, rows))).where("cycle = 2016").first()["score_dyn"]
    assert scores == 0.5


def test_latest_by_key_is_per_column(spark):
    df = spark.createDataFrame([(1, 2016, "a", "M"), (1, 2020, None, "F"), (1, 2024, "c", None)], "cid long, cycle long, x string, g string")
    r = one(panel.latest_by_key(df, "cid", "cycle", ["cycle", "x", "g"]))
    assert (r["cycle"], r["x"], r["g"]) == (2024, "c", "F")


def test_leave_one_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("b", 5.0), (None, 1.0), (None, 3.0)], "k string, x double")
    rows = local_means.attach_group_stats(df, ["k"], "x", loo="l", size="n").collect()
    got = sorted((str(r["k"]), str(r["x"]), r["l"], r["n"]) for r in rows)
    assert got == [
        ("None", "1.0", 3.0, 2), ("None", "3.0", 1.0, 2), ("a", "1.0", 1.0, 3), ("a", "2.0", 0.5, 3), ("a", "None", None, 3), ("b", "5.0", None, 1),
    ]
    values = local_means.attach_group_stats(df, ["k"], "x", loo="l", denominator="non_null").where("k = 'a' and x = 1.0").first()
    assert values["l"] == 2.0


@pytest.mark.parametrize("task_rows", [1, 7, 40, 10**6])
def test_hot_split_join_equals_plain_join(spark, task_rows):
    left = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("k"))
    left = left.withColumn("k", F.when(F.col("id") % 50 == 0, None).otherwise(F.col("k")))
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    for null_safe in (False, True):
        got = hot_split_join(left, right, ["k"], count="n", null_safe=null_safe, task_rows=task_rows)
        other = right.withColumnRenamed("k", "k2")
        on = F.col("k").eqNullSafe(F.col("k2")) if null_safe else F.col("k") == F.col("k2")
        want = left.join(other, on, "left").select("id", "k", "n", "s")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_every_large_key_is_spread(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        left = spark.range(60_000).select("id", (F.col("id") % 600).alias("k"))
        right = left.groupBy("k").agg(F.count("*").alias("n"))
        joined = hot_split_join(left, right, ["k"], count="n", task_rows=10).withColumn("place", F.spark_partition_id())
        places = joined.groupBy("k").agg(F.countDistinct("place").alias("places")).agg(F.min("places")).first()[0]
        assert places >= 5
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_occupation(spark):
    df = spark.createDataFrame([(None,), ("software manager",), ("data entry",), ("retired",), ("Manager",)], "o string")
    got = [r["occupation_std"] for r in df.withColumns(occupation_flags(F.col("o"))).collect()]
    assert got == [None, "manager", "engineer", "other", "other"]
    flags = df.withColumns(occupation_flags(F.col("o"))).where("o is null").first()
    assert flags["engineer"] is None and flags["manager"] is None and flags["other"] is None


@pytest.mark.parametrize(
    "raw,surname_first,parts",
    [
        ("O'BRIEN, PATRICK J JR", False, ("OBRIEN", "PATRICK", "J")),
        ("O'Brien Patrick J", True, ("OBRIEN", "PATRICK", "J")),
        ("SMITH-JONES, ANN", False, ("SMITHJONES", "ANN", None)),
        ("Smith", True, ("SMITH", None, None)),
        ("", False, (None, None, None)),
        ("SMITH, DR. JOHN ALAN", False, ("SMITH", "JOHN", "A")),
        (None, False, (None, None, None)),
    ],
)
def test_person_names(spark, raw, surname_first, parts):
    df = spark.createDataFrame([(raw,)], "n string")
    assert tuple(one(with_person_parts(df, "n", surname_first).drop("n"))) == parts


@pytest.mark.parametrize(
    "raw,key",
    [("Acme, Inc.", "acme"), ("A+B Co", "a+b"), ("The  Company LLC", "the"), ("Cointreau Co.", "cointreau"), ("Éco Corp", "éco"),
     ("$Cash | Limited", "$cash |"), ("INC.", ""), (None, None)],
)
def test_company_key(spark, raw, key):
    assert one(spark.createDataFrame([(raw,)], "n string").select(company_key(F.col("n"))))[0] == key


def test_entities(spark):
    df = spark.createDataFrame([("Acorn Fund L.P.",), ("Trusty John",), ("Smith Family Trust",), ("Doe Jane",)], "n string")
    assert [r[0] for r in df.select(looks_like_entity(F.col("n"))).collect()] == [True, False, True, False]


def test_dates_tickers_cycles(spark):
    df = spark.createDataFrame([("31-Jan-2020", "none", 2015), ("05-MAY-2021", " abc", 2016), ("junk", None, 2017)], "d string, t string, y int")
    rows = df.select(filing_date(F.col("d")), clean_ticker(F.col("t")), even_cycle(F.col("y"))).collect()
    assert [tuple(r) for r in rows] == [(D(2020, 1, 31), None, 2016), (D(2021, 5, 5), "ABC", 2016), (None, None, 2018)]


def test_insider_now_and_tech(spark):
    df = spark.createDataFrame([(True, 2018, 2012, 2016), (True, 2020, 2012, 2016), (False, 2018, None, None)], "f boolean, c int, a int, b int")
    assert [r[0] for r in df.select(insider_now(F.col("f"), F.col("c"), F.col("a"), F.col("b"))).collect()] == [True, False, False]
    codes = spark.createDataFrame([("Softw",), ("Banks",), (None,)], "i string")
    assert [r[0] for r in codes.select(tech_flag(F.col("i"))).collect()] == [True, False, False]


SPELL = (
    "owner_cik string, cik string, owner_name_raw string, issuer_name string, title_label string, ever_officer boolean, "
    "ever_director boolean, cycle_from int, cycle_to int"
)


def test_insider_linkage(spark):
    ref = spark.createDataFrame(
        [
            ("1", "320", "Smith John J", "A", None, True, True, 2012, 2016),
            ("2", "320", "Jones Mary", "A", None, True, False, 2012, 2016),
            ("3", "320", "Lee Ann B", "A", None, False, True, 2012, 2016),
            ("4", "320", "Lee Ann C", "A", None, False, True, 2012, 2016),
            ("5", "999", "Park Sue", "B", None, False, True, 2012, 2016),
        ],
        SPELL,
    )
    people = spark.createDataFrame(
        [
            (10, 2016, 320, "SMITH, JOHN J"), (11, 2016, 320, "SMITH, JOHN"), (12, 2016, 320, "SMITH, JOHN K"),
            (13, 2016, 320, "JONES, MARY Q"), (14, 2016, 320, "LEE, ANN"), (15, 2016, 320, "LEE, ANN B"), (16, 2016, 320, "PARK, SUE"),
        ],
        "cid long, cycle long, cik long, name string",
    )
    got = {r["cid"]: (r["owner_cik"], r["insider_role"]) for r in insiders.link_insiders(people, ref).collect()}
    assert got == {10: ("1", "officer_director"), 11: ("1", "officer_director"), 13: ("2", "officer"), 15: ("3", "director")}


YEAR = (
    "owner_cik string, cik string, year int, owner_name_raw string, issuer_name string, ticker string, is_officer boolean, "
    "is_director boolean, has_form3 boolean, title_label string, first_event date, last_event date, n_filings long"
)


def test_spells_of_years_parse_a_name_once(spark):
    """Folding the years of a name before it is parsed gives the spells of the parsed years, also when a name changes."""
    def year(owner, y, name, ticker=None, title=None, n=1):
        return (owner, "320", y, name, f"FIRM {y}", ticker, y % 2 == 0, y % 3 == 0, False, title, D(y, 1, 2), D(y, 5, 6), n)

    years = spark.createDataFrame([
        year("1", 2012, "Smith John J"), year("1", 2013, "Smith John J", "B", "CEO", 3), year("1", 2015, "Smith-Hall John", "A", "EVP, Sales", 3),
        year("1", 2016, "Smith John J", "C", None, 1), year("2", 2012, "Acorn Growth Fund L.P.", "T", "Trustee", 9),
        year("2", 2014, "Jones Mary", None, "CFO"), year("3", 2014, "Acorn Growth Fund L.P."), year("4", 2014, "Mononym"),
    ], YEAR)
    got = insiders.person_spells(years)
    assert sorted(map(str, got.collect())) == sorted(map(str, insiders.spells(insiders.persons_only(years)).select(*got.columns).collect()))
    found = {r["owner_cik"]: r for r in got.collect()}
    assert set(found) == {"1", "2"}
    first = found["1"]
    assert (first["owner_name_raw"], first["last"], first["ticker"], first["title_label"]) == ("Smith John J", "SMITH", "B", "EVP, Sales")
    assert (first["issuer_name"], first["cycle_from"], first["cycle_to"], first["n_filings"]) == ("FIRM 2012", 2012, 2016, 8)
    assert (found["2"]["n_filings"], found["2"]["insider_from"], found["2"]["ticker"]) == (1, D(2014, 1, 2), None)


def test_filings_are_dealt_by_owner_and_issuer_once(spark):
    head = spark.createDataFrame([("a", "3", "02-Jan-2014", "02-Jan-2014", "320", "Acme", "T")],
                                 "ACCESSION_NUMBER string, DOCUMENT_TYPE string, FILING_DATE string, PERIOD_OF_REPORT string, ISSUERCIK string, ISSUERNAME string, ISSUERTRADINGSYMBOL string")
    owner = spark.createDataFrame([("a", "1", "Smith John", "Officer", "CEO")],
                                  "ACCESSION_NUMBER string, RPTOWNERCIK string, RPTOWNERNAME string, RPTOWNER_RELATIONSHIP string, RPTOWNER_TITLE string")
    out = insiders.person_spells(insiders.person_years(head, owner))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(owner_cik" in line for line in plan.splitlines()) == 1
    assert [r["last"] for r in out.collect()] == ["SMITH"]


def test_complete_cases_and_outliers(spark):
    df = spark.createDataFrame([("", 1.0), ("M", None), ("F", 2.0)], "g string, x double")
    assert describe.complete_cases(df, ["g", "x"]).count() == 2
    assert describe.complete_cases(df, ["g", "x"], drop_blank=True).count() == 1
    r = one(describe.omitted_rows(df, ["g", "x"], drop_blank=True))
    assert (r["n_total"], r["n_omitted"]) == (3, 2)
    x = spark.createDataFrame([(-5.0,), (-4.99,), (5.0,), (None,)], "x double")
    assert [r[0] for r in describe.within(x, "x").collect()] == [-4.99]


def test_narrowest_range_and_residual(spark):
    defs = spark.createDataFrame(
        [(9, 1, "A", "Alpha", 100, 900, None), (9, 2, "B", "Beta", 200, 210, "b"), (9, 3, "O", "Other", None, None, None)],
        "scheme int, ff_num int, ff_abbr string, ff_name string, sic_from int, sic_to int, range_desc string",
    )
    codes = spark.createDataFrame([(150,), (205,), (950,)], "sic_int int")
    got = {r["sic_int"]: (r["ff9"], r["ff9_explicit"]) for r in industry.assign_scheme(codes, defs, 9).collect()}
    assert got == {150: (1, True), 205: (2, True), 950: (3, False)}


def test_crosswalk_invariants(spark):
    from panelweave.plans.bind import range_definitions

    sic = spark.createDataFrame([(100, "x", "one"), (100, "a", "two"), (None, "x", "y")], "sic_int int, sec_office string, sec_title string")
    look = industry.crosswalk(range_definitions(spark), sic)
    assert all(one(industry.check_crosswalk(look)))
    assert look.where("in_sec").select("sic", "sec_title").collect() == [("0100", "two")]


@pytest.mark.parametrize("n", [0, 1, 17, 500, 2000])
def test_sample_has_exact_size_and_is_stable(spark, n):
    df = spark.range(1000).select(F.col("id").alias("k"))
    a = {r[0] for r in sampling.sample_rows(df, n, "k", 1).collect()}
    b = {r[0] for r in sampling.sample_rows(df.repartition(7), n, "k", 1).collect()}
    assert a == b and len(a) == min(n, 1000)


def test_running_count_and_row_numbers(spark):
    df = spark.createDataFrame([("a", t, t % 4 == 0) for t in range(40)] + [("b", t, t % 7 == 0) for t in range(20)], "k string, t int, m boolean")
    out = ordered.running_count(df.repartition(6), ["k"], ["t"], F.col("m")).collect()
    for r in out:
        step = 4 if r["k"] == "a" else 7
        assert r["grp"] == r["t"] // step + 1
    ids = ordered.row_numbers(df.where("k = 'a'"), ["t"]).collect()
    assert all(r["row_id"] == r["t"] + 1 for r in ids)


def test_quantiles_equal_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [("a", float(v)) for v in np.round(rng.normal(0, 1, 4001), 3)] + [("b", 1.0), ("b", 4.0)] + [(None, float(v)) for v in rng.exponential(1, 997)]
    rows += [("a", 0.5)] * 2000  # a heavy tie
    df = spark.createDataFrame(rows, "g string, x double")
    out = {r["g"]: r for r in describe.quantiles(df, ["g"], "x", (0.0, 0.25, 0.5, 0.75, 1.0)).collect()}
    for g in ("a", "b", None):
        want = np.quantile([x for k, x in rows if k == g], [0.0, 0.25, 0.5, 0.75, 1.0])
        assert np.allclose([out[g][f"q{i}"] for i in range(5)], want)


def test_kernel_density_integrates_to_one(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(0, 1, 3000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    out = describe.kernel_density(df, [], "x", -6.0, 6.0, grid=121).toPandas().sort_values("x")
    assert abs(np.trapezoid(out["density"], out["x"]) - 1) < 1e-3
    bw = 0.9 * min(x.std(ddof=1), np.subtract(*np.quantile(x, [0.75, 0.25])) / 1.34) * len(x) ** -0.2
    exact = [np.exp(-0.5 * ((g - x) / bw) ** 2).sum() / (len(x) * bw * np.sqrt(2 * np.pi)) for g in out["x"]]
    assert np.abs(out["density"] - exact).max() < 1e-4
