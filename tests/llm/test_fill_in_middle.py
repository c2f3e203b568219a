import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from panelweave.llm import fill_in_middle as fim
from tests.llm.rows import ODD, odd, table

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def expected(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    if text == "" or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def compare(df):
    want = sorted(((r["doc_id"], *expected(r["doc_id"], r["text"]), r["text"] or "") for r in df.select("doc_id", "text").collect()), key=str)
    got = fim.fill_in_middle(df).withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()
    assert sorted(map(tuple, got), key=str) == want
    return got


def test_table(spark):
    got = compare(table(spark, "0.01"))
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_awkward_rows(spark):
    more = ["a<P>b", "<S", "<M>", "<<S<P", "x<S" * 50, "P>S>M>", "a" * 50_000, "é😀z" * 9_000, "𝒜b𝒞", "İıſK", "\x00\x01  ", "A" + "\n" * 40]
    df = odd(spark, ODD + [(200 + 40 * k + i, t, None, None, None) for i, t in enumerate(more) for k in range(12)])
    compare(df)
    assert fim.fill_in_middle(df.limit(0)).collect() == []
    assert fim.digests(df).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def test_every_rank_of_the_skip_list():
    rng = np.random.default_rng(3)
    for count in (0, 1, 2, 3, 17, 400, 5000):
        lengths = rng.integers(1, 40, count)
        ranks = fim.WidthList(lengths)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        assert [ranks.points_before(u) for u in range(count + 1)] == sums.tolist()
    assert len(ranks.lanes) > 3 and sum(len(w) for w, _, _ in ranks.lanes) < 1.5 * count


def test_other_rates(spark):
    df = table(spark)
    assert {r["form"] for r in fim.fill_in_middle(df, seed=2, plain_percent=0, spm_percent=100).filter("n > 0").collect()} == {"spm"}
