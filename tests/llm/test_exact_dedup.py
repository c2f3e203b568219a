import hashlib
from collections import defaultdict

from panelweave.llm import exact_dedup
from tests.llm.rows import ODD, SPACE, odd, table


def expected(rows):
    classes = defaultdict(list)
    for doc_id, text in rows:
        classes[SPACE.sub(" ", text or "")].append(doc_id)
    out = []
    for text, ids in classes.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), keep is None or i == keep, sha) for i in ids]
    return sorted(out, key=str)


def test_awkward_rows(spark):
    for runs, bits in ((256, 4), (5, 1), (1, 4)):
        got = exact_dedup.exact_duplicates(odd(spark), runs, bits).collect()
        assert sorted(map(tuple, got), key=str) == expected([r[:2] for r in ODD])


def test_one_large_class(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.exact_duplicates(df).collect()), key=str) == expected(rows)


def test_keep_first(spark):
    df = odd(spark)
    kept = exact_dedup.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 7, 8, 9, 10, 11, None, 12]))


def test_empty_table(spark):
    empty = table(spark).limit(0)
    assert exact_dedup.exact_duplicates(empty).collect() == []
    assert exact_dedup.keep_first(empty).collect() == []


def test_every_level_consumes_sorted_runs(spark):
    rows = exact_dedup.digest_runs(table(spark, "0.01")).withColumnRenamed("doc_id", "keep_id").selectExpr("*", "1L AS group_size")
    level, levels = exact_dedup._merge(rows), 1
    for shift in (4, 4):
        level, levels = exact_dedup._merge(level.selectExpr(f"shiftright(run, {shift}) AS run", "* EXCEPT (run)")), levels + 1
    level.collect()
    plan = level._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    folds = [i for i, line in enumerate(plan) if "SortAggregate(key=[run" in line]
    assert len(folds) == 2 * levels and not any("HashAggregate" in line for line in plan)
    # the input of every fold is sorted by run and digest
    for i in folds:
        below = next(line for line in plan[i + 1 :] if "Sort [run" in line or "SortAggregate(" in line or "Exchange" in line)
        assert "Sort [run" in below, plan[i : i + 4]
