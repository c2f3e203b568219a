"""The pipeline against a brute-force version of its stages, and the registered queries on the smallest tables."""

import hashlib
from collections import defaultdict

import corpus_pipeline
import pytest

import __spark_entry__ as contract
from panelweave.llm import language_id
from tests.compare import check_engine, differences
from tests.llm import test_near_dedup
from tests.llm.rows import SPACE, odd

SF_DIR = "/root/testdata/sf0.001"
OPERATORS = [f"op{n}_" for n in range(1, 11)]


def test_stages():
    assert len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.ORACLE_SQL is None


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    judged = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    left = {i: r for i, r in rows.items() if judged[i]["lang_pred"] != "und" and judged[i]["score"] >= language_id.LEAST_SCORE}
    first = {}
    for i in sorted(left):
        first.setdefault(hashlib.sha256(SPACE.sub(" ", left[i]["text"]).encode()).digest(), i)
    left = {i: left[i] for i in first.values()}
    near = test_near_dedup.expected([(i, r["text"]) for i, r in left.items()], 5, 80)
    left = {i: r for i, r in left.items() if near[i][2]}
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r["doc_id"] for r in got} == set(left)
    covered = defaultdict(int)
    for r in got:
        covered[r["doc_id"]] += r["length"]
    tokens = {r["doc_id"]: r["doc_tokens"] for r in got}
    assert all(covered[i] % tokens[i] == 0 and 1 <= covered[i] // tokens[i] <= 2 for i in left)


def test_stages_keep_the_columns(spark):
    docs = odd(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() > 0


@pytest.mark.parametrize("prefix", OPERATORS)
def test_queries(spark, prefix):
    queries, checks = contract.queries(), contract.oracle_sql()
    name = next(q for q in queries if q.startswith(prefix))
    if name in checks:
        assert differences(spark, check_engine(SF_DIR), SF_DIR, queries[name], checks[name]) is None
    else:
        source = "pages" if prefix == "op8_" else "documents"
        n = spark.read.parquet(f"{SF_DIR}/{source}.parquet").count()
        assert queries[name](spark, SF_DIR).count() >= n
