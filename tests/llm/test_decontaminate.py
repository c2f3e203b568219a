import hashlib
import re

import pytest
from pyspark.sql import functions as F

from panelweave.llm import decontaminate
from tests.llm.rows import LONG, LOWER, ODD, odd, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [
    (1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "one TWO three"), (2, "one TWO three"), (3, None), (4, " .. "),
    (None, "kappa lambda mu nu xi omicron pi rho sigma tau"), (10, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (5, "x"),
]
DOCS = [
    (50, "So: alpha BETA gamma-delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau. The end of one, two! Three four"),
    (51, "alpha beta gamma delta epsilon zeta eta theta iota"), (52, "one two three one two three"), (53, "one two one two three"), (54, "İ ONE\nTWO\tTHREE é"),
    (50, "another text with the same id and one two three"), (None, "one two three"),
]


def expected(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        for i in range(max(len(w) - n, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for width in {len(x) for x in windows}:
            for i in range(len(w) - width + 1):
                if tuple(w[i : i + width]) in windows:
                    hit |= set(range(i, i + width))
                    found |= windows[tuple(w[i : i + width])]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string").withColumn("items", F.lit("other"))


def test_table(spark):
    docs, items = table(spark, "0.01"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = expected(rows_of(docs), [(r["item_id"], r["text"]) for r in items.collect()])
    assert sorted(map(tuple, decontaminate.digests(docs, items).collect()), key=str) == want
    assert any(r[-1] for r in want)


@pytest.mark.parametrize("slice_grams", [500_000, 2])
def test_awkward_rows(spark, slice_grams):
    docs = odd(spark, ODD + [(*d, None, None, None) for d in DOCS])
    got = decontaminate.digests(docs, bench(spark), slice_grams=slice_grams)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows_of(docs), ITEMS)


def test_empty_tables(spark):
    docs = odd(spark)
    assert decontaminate.digests(docs.limit(0), bench(spark)).collect() == []
    none = decontaminate.digests(docs, bench(spark).limit(0))
    assert sorted(map(tuple, none.collect()), key=str) == expected(rows_of(docs), [])


def test_a_frequent_passage(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(i, f"start{i} {passage} end") for i in range(2000)] + [(5000, LONG + " " + passage)], "doc_id long, text string")
    items = [(i, f"{passage} and item{i}") for i in range(50)]
    want = expected(rows_of(docs), items)
    assert sorted(map(tuple, decontaminate.digests(docs, bench(spark, items)).collect()), key=str) == want


def test_spans_and_documents_are_removed(spark):
    docs = odd(spark, ODD + [(*d, None, None, None) for d in DOCS])
    clean = decontaminate.decontaminated(docs, bench(spark))
    assert clean.columns == docs.columns and clean.count() == docs.count()
    texts = {}
    for i, t in rows_of(clean):
        texts.setdefault(i, set()).add(t)
    assert texts[50] == {"So: . The end of  four", "another text with the same id and "}
    before = {i: t for i, t in rows_of(docs)}
    hit = {r["doc_id"] for r in decontaminate.contamination(docs, bench(spark)).filter("contaminated").collect()}
    assert all(texts[i] == {before[i]} for i in before if i not in hit and i != 7)
    left = rows_of(decontaminate.decontaminated(docs, bench(spark), remove="documents"))
    assert len(left) == docs.count() - len([1 for i, n, h, *_ in expected(rows_of(docs), ITEMS) if h])
    some = decontaminate.decontaminated(docs, bench(spark), remove="documents", share=0.5)
    assert len(left) < some.count() < docs.count()
    with pytest.raises(ValueError):
        decontaminate.decontaminated(docs, bench(spark), remove="lines")


def test_one_pass_over_the_text(spark):
    held = decontaminate.written(decontaminate.grams(spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")), "grams")
    hits = decontaminate._hits(table(spark, "0.01"), held, [3, 10])
    assert hits.collect()
    plan = hits._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    part = [line.split("*(")[1].split(")")[0] for line in plan.splitlines() if "*(" in line and any(x in line for x in ("Generate explode", "BroadcastHashJoin", "Project [coalesce"))]
    assert len(part) >= 4 and len(set(part)) == 1  # texts, windows and lookup in one generated loop: words are never copied per window
