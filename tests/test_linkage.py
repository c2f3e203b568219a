"""Jaro and the lossless blocking against brute force."""

import random
import time

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelweave.functions.jaro import jaro_batch, nearest_of
from panelweave.operators import linkage, validate

WORDS = "red widget blue anvil economy standard large gizmo plate acme north star zinc quartz holdings".split()


def _typos(rng, text, n):
    s = list(text)
    for _ in range(n):
        i, r = rng.randrange(len(s)), rng.random()
        if r < 0.3:
            s[i] = rng.choice("abcdexyz")
        elif r < 0.6 and i + 1 < len(s):
            s[i], s[i + 1] = s[i + 1], s[i]
        elif r < 0.8 and len(s) > 1:
            del s[i]
        else:
            s.insert(i, rng.choice("abcdexyz"))
    return "".join(s).strip() or "x"


def _names(rng, n, longest=4):
    base = [" ".join(rng.sample(WORDS, rng.randint(1, longest))) for _ in range(n)]
    return base, [_typos(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(n)]


def test_known_values():
    pairs = {("martha", "marhta"): 0.944444, ("dixon", "dicksonx"): 0.766667, ("abcvwxyz", "cabvwxyz"): 0.958333}
    for (a, b), want in pairs.items():
        assert abs(jaro_batch(pd.Series([a]), pd.Series([b]))[0] - want) < 1e-6


@settings(max_examples=200, deadline=None)
@given(st.text("abcd é漢", max_size=12), st.text("abcd é漢", max_size=12))
def test_range_and_identity(a, b):
    forward = jaro_batch(pd.Series([a]), pd.Series([b]))[0]
    assert 0.0 <= forward <= 1.0
    assert jaro_batch(pd.Series([a]), pd.Series([a]))[0] == 1.0
    assert (forward == 0) == (jaro_batch(pd.Series([b]), pd.Series([a]))[0] == 0)


def test_equals_other_implementation():
    rng = random.Random(2)
    left, right = _names(rng, 3000)
    con = duckdb.connect()
    con.register("pairs", pd.DataFrame({"a": left, "b": right}))
    want = [r[0] for r in con.execute("SELECT jaro_similarity(a, b) FROM pairs").fetchall()]
    assert abs(jaro_batch(pd.Series(left), pd.Series(right)) - want).max() < 1e-12


@pytest.mark.parametrize("distance", [0.02, 0.06, 0.1, 0.2])
@pytest.mark.parametrize("kind", ["names", "short", "long", "longer", "unicode"])
def test_blocking_loses_no_pair(spark, distance, kind):
    rng = random.Random(hash((kind, distance)) % 1000)
    if kind == "short":
        pool = ["".join(rng.choice("abc1") for _ in range(rng.randint(1, 6))) for _ in range(120)]
        left, right = pool[:60], pool[60:]
    elif kind == "long":
        left = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(12, 22))) for _ in range(12)]
        right = [_typos(rng, rng.choice(left), rng.randint(1, 12)) for _ in range(30)]
    elif kind == "longer":
        left = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(36, 105))) for _ in range(8)]
        right = [_typos(rng, rng.choice(left), rng.randint(1, 60)) for _ in range(16)]
    else:
        left, right = _names(rng, 120)
        if kind == "unicode":
            right = [r.replace("a", "é").replace("o", "漢") for r in right[:60]] + right[60:]
            left = left + right[:30]
    left, right = sorted(set(left)), sorted(set(right))
    q = spark.createDataFrame([(s,) for s in left], "query_norm string")
    r = spark.createDataFrame([(s,) for s in right], "ref_norm string")
    got = {(x[0], x[1]) for x in linkage.candidate_pairs(q, r, distance).select("query_norm", "ref_norm").distinct().collect()}
    every = [(a, b) for a in left for b in right]
    score = jaro_batch(pd.Series([a for a, _ in every]), pd.Series([b for _, b in every]))
    want = {p for p, s in zip(every, score, strict=True) if round(1 - s, 12) <= distance}
    assert got == want
    assert want or kind in ("short", "unicode", "long", "longer")


@pytest.mark.parametrize("distance", [0.0, 0.03, 0.06, 0.1, 0.2])
def test_pairs_come_once_without_a_shuffle_of_pairs(spark, distance):
    rng = random.Random(12)
    left, right = _names(rng, 150)
    left += [_typos(rng, rng.choice(left), 2) for _ in range(80)] + [" ".join(rng.choice(WORDS) for _ in range(20))]
    right += [_typos(rng, x, 3) for x in left[-60:]]
    q = spark.createDataFrame([(s,) for s in sorted(set(left))], "query_norm string")
    r = spark.createDataFrame([(s,) for s in sorted(set(right))], "ref_norm string")
    pairs = linkage.candidate_pairs(q, r, distance)
    rows = [(x[0], x[1]) for x in pairs.collect()]
    assert len(rows) == len(set(rows))
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "ArrowEvalPython" in plan and "HashAggregate" not in plan
    assert plan.count("Exchange hashpartitioning(query_norm") == plan.count("Exchange hashpartitioning(ref_norm") == 0


def test_blocking_keys_grow_with_the_length_only(spark):
    from panelweave.functions.signatures import with_signatures

    rng = random.Random(7)
    rows = [(n, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))) for n in (20, 80, 320, 640, 2000)]
    keys = with_signatures(spark.createDataFrame(rows, "n int, query_norm string"), "query_norm", 0.1, "query")
    for r in keys.groupBy("n").agg(F.countDistinct("sig").alias("keys")).collect():
        assert r["keys"] <= 20 * r["n"], (r["n"], r["keys"])


def test_large_blocking_keys_are_cut_into_blocks(spark):
    rng = random.Random(3)
    left, right = (sorted({_typos(rng, "red widget blue anvil", 2) for _ in range(80)}) for _ in range(2))
    q = spark.createDataFrame([(s,) for s in left], "query_norm string")
    r = spark.createDataFrame([(s,) for s in right], "ref_norm string")
    whole = linkage.candidate_pairs(q, r, 0.1).collect()
    assert sorted(map(str, linkage.candidate_pairs(q, r, 0.1, block=7).collect())) == sorted(map(str, whole))
    assert len({(x[0], x[1]) for x in whole}) == len(whole)


@settings(max_examples=200, deadline=None)
@given(st.text("abcd é漢", max_size=30), st.text("abcd é漢", max_size=30))
def test_a_pair_alone_equals_a_batch(a, b):
    from panelweave.functions.jaro import jaro_pair

    assert abs(jaro_pair(a, b) - jaro_batch(pd.Series([a]), pd.Series([b]))[0]) < 1e-12


def test_a_long_text_does_not_set_the_cost_of_the_others():
    from panelweave.functions.jaro import jaro_by_length

    rng = random.Random(5)
    left, right = _names(rng, 2000)
    left.append("".join(rng.choice("abcdefgh ") for _ in range(20_000)))
    right.append(left[-1][5:] + "tail")
    start = time.time()
    got = jaro_by_length(pd.Series(left), pd.Series(right))
    assert time.time() - start < 5
    assert abs(got[:2000] - jaro_batch(pd.Series(left[:2000]), pd.Series(right[:2000]))).max() < 1e-12
    assert 0.6 < got[-1] < 1.0


def test_blocking_is_selective(spark):
    rng = random.Random(4)
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    weights = [12.7, 9.1, 8.2, 7.5, 7, 6.7, 6.3, 6.1, 6, 4.3, 4, 2.8, 2.8, 2.4, 2.2, 2.4, 2, 1.9, 1, 1.5, 2, 0.8, 0.15, 0.1, 0.15, 0.07]
    word = lambda: "".join(rng.choices(letters, weights, k=rng.randint(3, 8)))
    names = sorted({" ".join(word() for _ in range(rng.randint(2, 4))) for _ in range(1500)})
    from panelweave.functions.signatures import letter_order, with_signatures

    refs = spark.createDataFrame([(s,) for s in names], "ref_norm string")
    order = letter_order(refs, "ref_norm")
    assert set("etaoin") < set(order[-10:])
    q = with_signatures(spark.createDataFrame([(s,) for s in names], "query_norm string"), "query_norm", 0.06, "query", order)
    r = with_signatures(refs, "ref_norm", 0.06, "reference", order)
    met = q.join(r, "sig").select("query_norm", "ref_norm").distinct().count()
    assert met / len(names) ** 2 < 0.005


REGISTER = [
    (5, "Acme Inc.", "1000", "x"), (3, "ACME Corp", "2000", "y"), (9, "North Star Holdings", "3000", "z"),
    (8, "North Star Holding", "3100", "z"), (1, "No Code", None, "z"), (2, "Inc.", "4000", "z"),
]


def _register(spark):
    return spark.createDataFrame(REGISTER, "cik long, real_name string, sic string, sic_description string")


def test_reference_keeps_first_row_per_key(spark):
    ref = linkage.company_reference(_register(spark)).collect()
    assert {r["ref_norm"]: r["cik"] for r in ref} == {"acme": 3, "north star holdings": 9, "north star holding": 8}


def test_tiers_status_and_expansion(spark):
    raw = ["acme", "ACME, LLC", "north star holdinsg", "nroth satr hlodings", "zzz", "", None, "acme"]
    rows = spark.createDataFrame([(i, e) for i, e in enumerate(raw)], "id long, employer string")
    ref = linkage.company_reference(_register(spark))
    matches = linkage.link_companies(rows, ref)
    got = {r["employer_raw"]: (r["match_type"], r["status"], r["cik"], r["n_rows"]) for r in matches.collect()}
    assert got["acme"] == ("exact", "auto_accept", 3, 2)
    assert got["ACME, LLC"] == ("exact", "auto_accept", 3, 1)
    assert got["north star holdinsg"][:3] == ("fuzzy", "auto_accept", 8)  # both names are equally near
    assert got["nroth satr hlodings"][1] == "needs_review"
    assert got["zzz"][:2] == ("none", "no_match") and got[""][:2] == ("none", "no_match")
    assert None not in got
    assert linkage.attach_matches(rows, matches).count() == len(raw)
    assert {r["id"] for r in linkage.attach_matches(rows, matches, how="inner").collect()} == {0, 1, 2, 7}
    share = linkage.match_propensity(rows, matches).first()
    assert (share["n_matched"], share["n_total"]) == (4, 8)


def test_equal_distances_go_to_the_first_reference_row(spark):
    q = spark.createDataFrame([("abcdefghijklmnopqrsx",)], "query_norm string")
    ref = spark.createDataFrame([("abcdefghijklmnopqrsz", 2), ("abcdefghijklmnopqrsy", 1)], "ref_norm string, cik long")
    best = linkage.nearest(linkage.candidate_pairs(q, ref, 0.06), ref).collect()
    assert [r["ref_norm"] for r in best] == ["abcdefghijklmnopqrsy"]


def test_thresholds_must_be_ordered(spark):
    rows = spark.createDataFrame([("a",)], "employer string")
    with pytest.raises(ValueError):
        linkage.link_companies(rows, linkage.company_reference(_register(spark)), strict=0.1, loose=0.05)
    with pytest.raises(ValueError):
        linkage.candidate_pairs(rows.withColumnRenamed("employer", "query_norm"), rows.withColumnRenamed("employer", "ref_norm"), 0.4)


def test_sweep_is_monotone(spark):
    rng = random.Random(9)
    left, right = _names(rng, 80)
    ref = spark.createDataFrame([(i, n, "1", "d") for i, n in enumerate(sorted(set(left)))], "cik long, real_name string, sic string, sic_description string")
    rows = spark.createDataFrame([(s,) for s in right], "employer string")
    scored = validate.score_once(rows, linkage.company_reference(ref))
    sweep = {r["strict_dist"]: r["match_propensity"] for r in validate.threshold_sweep(scored).collect()}
    values = [sweep[t] for t in sorted(sweep)]
    assert values == sorted(values) and len(values) == 5
    # each threshold equals a separate run with that threshold
    for t in (0.02, 0.04):
        single = linkage.link_companies(rows, linkage.company_reference(ref), strict=t, loose=0.06)
        n = single.count()
        assert abs(single.where("status = 'auto_accept'").count() / n - sweep[t]) < 1e-12


def test_a_register_is_read_once(spark):
    """Keys of a register cost regular expressions over all rows; tiers, letters and blocking keys share one pass."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    register = _register(spark)
    lazy = linkage.company_reference(register.mapInArrow(seen, register.schema))
    rows = spark.createDataFrame([("Acme Corp",), ("acmee inc",), ("nothing like it",)], "employer string")
    got = linkage.link_companies(rows, lazy)
    expected = linkage.link_companies(rows, linkage.build_matcher(register))
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    assert read.value == register.count()


def test_repeated_names_become_keys_once(spark):
    rows = [(3, "Acme, Inc.", "100"), (1, "Acme, Inc.", "200"), (2, "ACME", "300"), (4, None, "1"), (5, "", "1"), (6, "Beta", None)]
    register = spark.createDataFrame(rows, "cik long, real_name string, sic string")
    got = linkage.company_reference(register).select("ref_norm", "cik", "real_name", "sic").collect()
    assert list(map(tuple, got)) == [("acme", 1, "Acme, Inc.", "200")]


def test_samples_share_blocking_keys(spark, monkeypatch):
    names = []

    def noted(df, name, write=linkage.written):
        names.append(name)
        return write(df, name)

    register = _register(spark)
    rows = spark.createDataFrame([("acmee inc",), ("north star holdinsg",), ("zzz",)], "employer string")
    matcher = linkage.build_matcher(register)
    matches = linkage.link_companies(rows, matcher)
    alone = [sorted(map(str, validate.review_sample(matches, kind, 5, reference=matcher.reference).collect())) for kind in ("accepted", "rejected")]
    wide = linkage.matcher_of(matcher.reference, 0.2)
    monkeypatch.setattr(linkage, "written", noted)
    shared = [sorted(map(str, validate.review_sample(matches, kind, 5, reference=wide).collect())) for kind in ("accepted", "rejected")]
    assert shared == alone and "reference-index" not in names


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz 0123", "é漢😀xyz" + "".join(map(chr, range(0x4E00, 0x4E80)))])
def test_bounds_hide_no_nearest_text(letters):
    rng = random.Random(4)
    texts, others = (["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(n)] for n in (60, 150))
    others += others[:20] + ["####"]
    texts += [_typos(rng, t, 1) for t in others[:20]]
    for many in (others, others[:3], []):
        want = []
        for t in texts if many else ():
            apart = 1 - jaro_batch(pd.Series([t] * len(many)), pd.Series(many))
            want.append((apart.min(), int(apart.argmin())))
        assert [found[0] for found in nearest_of(texts, many) if found] == want


def test_the_closest_key_is_found_at_any_distance(spark):
    rng = random.Random(6)
    left, right = _names(rng, 60)
    queries = sorted({*right, "qqqq jjjj", "漢字", "x", *["".join(rng.choice("abcdnorst") for _ in range(9)) for _ in range(20)]})
    ref = [(t, 1000 - i) for i, t in enumerate(sorted(set(left)))]
    reference = spark.createDataFrame(ref, "ref_norm string, cik long").cache()
    want = {}
    for q in queries:
        apart = (1 - jaro_batch(pd.Series([q] * len(ref)), pd.Series([t for t, _ in ref]))).round(12)
        want[q] = min((float(d), cik, t) for d, (t, cik) in zip(apart, ref, strict=True))
    rows = spark.createDataFrame([(q,) for q in [*queries, ""]], "query_norm string")
    matchers = [linkage.matcher_of(reference, d) for d in (0.06, 0.1)]
    for used, block in ((matchers, 7), (matchers[:1], 2000)):
        got = linkage.closest(rows, *used, block=block).collect()
        assert len(got) == len(queries) and max(r["distance"] for r in got) == 1.0
        assert all((round(r["distance"], 9), r["ref_norm"]) == (round(want[r["query_norm"]][0], 9), want[r["query_norm"]][2]) for r in got)
    empty = linkage.matcher_of(reference.where("cik < 0"), 0.06)
    assert linkage.closest(rows, empty).count() == 0


def test_all_pairs_are_reviewed_and_the_sample_is_marked(spark):
    rows = spark.createDataFrame([(t,) for t in ("north star holdinsg", "acmee inc", "retired", "zzz", "self employed", "", "Inc.")], "employer string")
    matcher = linkage.build_matcher(_register(spark))
    matches = linkage.link_companies(rows, matcher, strict=0.06)
    accepted, rejected = ({r["employer_raw"]: r for r in validate.review_sample(matches, k, 2, reference=matcher).collect()} for k in ("accepted", "rejected"))
    assert {*accepted, *rejected} == {r["employer"] for r in rows.collect()}
    assert [(t, r["nearest"], r["sampled"]) for t, r in accepted.items()] == [("north star holdinsg", "north star holding", True)]
    for text, r in rejected.items():
        assert (r["nearest"] is None) == (text in ("", "Inc."))
    assert rejected["retired"]["nearest_distance"] > 0.2
    drawn = spark.createDataFrame([(t,) for t in rejected], "t string").orderBy(F.md5(F.concat(F.lit("123:"), "t")), "t").limit(2)
    assert {t for t, r in rejected.items() if r["sampled"]} == {r["t"] for r in drawn.collect()}
    # rows that are repeated or have no string stay, and no more than n of them are marked
    odd = matches.where("status <> 'auto_accept'").unionByName(matches.where("employer_raw = 'zzz'")).withColumn(
        "employer_raw", F.when(F.col("employer_raw") != "retired", F.col("employer_raw")))
    plain = validate.review_sample(odd, "rejected", 3)
    assert plain.count() == len(rejected) + 1 and plain.where("sampled").count() == 3
    assert plain.columns == [*matches.columns, "sampled"]
