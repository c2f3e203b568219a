import math
import random
from collections import defaultdict

import pytest

from panelweave.llm import mixing
from tests.llm.rows import ODD, WORDS, odd, table


def shares(spark, sizes):
    rows = [(i, s, n) for i, (s, n) in enumerate(sizes.items())]
    return mixing.source_totals(spark.createDataFrame(rows, "doc_id long, source string, n_tokens long"))


def test_exponent_meets_the_repetition_limit(spark):
    totals = shares(spark, {"a": 8000, "b": 1000, "c": 500})
    a = mixing.exponent(totals, repetition=2.0)
    got = {r["source"]: r for r in mixing.weights(totals, a).collect()}
    assert max(r["passes"] for r in got.values()) == pytest.approx(2.0, abs=1e-4)
    assert min(r["passes"] for r in got.values()) == pytest.approx(1.0)
    assert sum(r["weight"] for r in got.values()) == pytest.approx(1.0)
    assert got["b"]["weight"] / got["c"]["weight"] == pytest.approx(2.0**a)


def test_exponent_meets_an_entropy(spark):
    totals = shares(spark, {"a": 8000, "b": 1000, "c": 500})
    a = mixing.exponent(totals, repetition=None, entropy=0.9)
    weights = [r["weight"] for r in mixing.weights(totals, a).collect()]
    assert -sum(w * math.log(w) for w in weights) == pytest.approx(0.9, abs=1e-4)


def test_limit_that_allows_everything_or_nothing(spark):
    totals = shares(spark, {"a": 8000, "b": 1000})
    assert mixing.exponent(totals, repetition=100.0) == 0.0
    assert mixing.exponent(totals, repetition=1.0) == 1.0


def test_every_document_is_shown_and_shares_follow_the_weights(spark):
    docs = table(spark, "0.01")
    counts = {r["doc_id"]: (r["source"], len(WORDS.findall(r["text"]))) for r in docs.collect()}
    rows = mixing.mix(docs, block_tokens=4000).collect()
    shown, copies, epochs = defaultdict(int), defaultdict(int), defaultdict(set)
    weight = {r["source"]: (r["weight"], r["passes"]) for r in rows}
    places = defaultdict(list)
    for r in rows:
        assert (r["source"], r["n_tokens"]) == counts[r["doc_id"]]
        shown[r["source"]] += r["n_tokens"]
        copies[r["doc_id"]] += 1
        epochs[r["doc_id"]].add(r["epoch"])
        places[r["source"], r["block"], r["epoch"]].append(r["position"])
    assert set(copies) == set(counts)
    assert all(epochs[i] == set(range(n)) for i, n in copies.items())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    total = sum(shown.values())
    for source, (w, passes) in weight.items():
        assert shown[source] / total == pytest.approx(w, rel=0.2)
        assert all(math.floor(passes) <= copies[i] <= math.floor(passes) + 1 for i, (s, _) in counts.items() if s == source)


@pytest.mark.parametrize("seed", range(4))
def test_no_source_falls_short_of_a_pass(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"s{i % 7}", " ".join(["w"] * rng.randrange(1, 90))) for i in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert {r["doc_id"] for r in got} == set(range(200))
    assert min(r["passes"] for r in got) == 1.0


def test_a_budget_shows_less(spark):
    docs = table(spark, "0.01")
    whole = sum(len(WORDS.findall(r["text"])) for r in docs.collect())
    rows = mixing.mix(docs, budget=whole / 4, block_tokens=20_000).collect()
    assert 0.1 * whole < sum(r["n_tokens"] for r in rows) <= 0.25 * whole * 1.001


def test_awkward_rows(spark):
    df = odd(spark)
    rows = mixing.mix(df).collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in ODD}
    assert {r["source"] for r in rows} == {r[3] or "" for r in ODD}
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    assert {r["doc_id"] for r in mixed.collect()} == {r[0] for r in ODD}
    assert mixing.mix(df.limit(0)).collect() == []
    assert mixing.mixed_documents(df.limit(0)).collect() == []
    blank = df.filter("doc_id in (1, 2, 3)")
    assert sorted(r["doc_id"] for r in mixing.mix(blank).collect()) == [1, 2, 3]


def test_shares_of_sources_with_documents_longer_than_a_block(spark):
    rng = random.Random(4)
    sizes = {"short": [rng.randrange(20, 400) for _ in range(6000)], "mid": [20_000 + rng.randrange(900) for _ in range(30)], "long": [60_000 - rng.randrange(500) for _ in range(6)], "tiny": [90] * 50}
    rows = [(i, s, n) for i, (s, n) in enumerate((s, n) for s, found in sizes.items() for n in found)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long").selectExpr("doc_id", "source", "repeat('w ', int(n)) AS text")
    for how in ({}, {"repetition": 3.5}, {"block_tokens": 4000, "repetition": 1.7}):
        shown, copies, told = defaultdict(int), defaultdict(int), {}
        for r in mixing.mix(df, **how).collect():
            shown[r["source"]] += r["n_tokens"]
            copies[r["doc_id"]] += 1
            told[r["source"]] = (r["weight"], r["passes"])
        assert set(copies) == {r[0] for r in rows}
        for source, found in sizes.items():
            weight, passes = told[source]
            assert abs(shown[source] - passes * sum(found)) <= max(found) / 2 + 1
            if source in ("short", "mid"):
                assert shown[source] / sum(shown.values()) == pytest.approx(weight, rel=0.02)
        if not how:
            assert told["tiny"][1] == 2.0 and shown["tiny"] == 2 * 90 * 50  # the limit is met as a whole number


def test_running_totals_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_BLOCKS", 3)
    rows = [("a", b, 10 * b + k) for b in range(20) for k in range(3) if b != 7] + [("b", 0, 5)]
    got = {(r[0], r[1]): r[2] for r in mixing._before_blocks(spark.createDataFrame(rows, "source string, block long, n_tokens long")).collect()}
    assert got == {(s, b): sum(n for t, c, n in rows if t == s and c < b) for s, b, _ in rows}


def test_a_source_of_empty_documents_has_blocks(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "'e' AS source", "'' AS text")
    rows = mixing.mix(df, block_tokens=100).collect()
    assert len(rows) == 3000 and len({r["block"] for r in rows}) >= 25
