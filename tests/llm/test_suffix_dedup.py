import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelweave.llm import suffix_dedup
from tests.llm.rows import ODD, odd, table

N = suffix_dedup.LENGTH


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60).map(lambda b: bytes(97 + x % 2 for x in b)), st.integers(2, 20), st.data())
def test_longest_previous_factors(data, limit, more):
    starts = np.asarray(sorted(more.draw(st.sets(st.integers(0, max(len(data) - 1, 0)), max_size=len(data)))), dtype=np.int64)
    starts = starts[starts < len(data)]
    got = suffix_dedup.longest_previous_factors(np.frombuffer(data, dtype=np.uint8), starts, limit)
    for k, i in enumerate(starts):
        longest = 0
        for j in starts[:k]:
            n = 0
            while n < limit and i + n < len(data) and data[i + n] == data[j + n]:
                n += 1
            longest = max(longest, n)
        assert got[k] == longest


def expected(rows):
    seen, out = {}, {}
    keyed = [(i is None, i or 0, zlib.crc32((t or "").encode()), (t or "").encode(), i) for i, t in rows]
    for _, _, _, data, doc_id in sorted(set(keyed), key=lambda r: r[:4]):
        hit = np.zeros(len(data), dtype=bool)
        for i in range(len(data) - N + 1):
            w = data[i : i + N]
            if w in seen:
                hit[i : i + N] = True
            seen.setdefault(w, doc_id)
        kept = bytes(np.frombuffer(data, dtype=np.uint8)[~hit])
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        out[doc_id, data] = (doc_id, len(data), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted((out[i, (t or "").encode()] for i, t in rows), key=str)


def compare(df, **how):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = suffix_dedup.remove_repeats(df, **how).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_tables(spark):
    compare(table(spark, "0.01"))
    compare(table(spark, "0.01"), wide=2)  # the path of very common anchors
    compare(table(spark).limit(0))


def test_awkward_rows(spark):
    rows = [r for r in ODD if r[0] not in (8, 9)]
    p = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(400))
    more = [p, "x" + p[100:350] + "y", p[:99] + "z", "é" * 60, "é" * 120, "q " * 400, p[50:149], "zz" + p[10:110] + "ww" + p[200:310]]
    rows += [(100 + i, t, None, None, None) for i, t in enumerate(more)]
    for how in ({}, {"wide": 1}):
        compare(odd(spark, rows), **how)


def test_texts_longer_than_a_slice(spark):
    rng = np.random.default_rng(0)
    text = "".join(map(chr, rng.integers(97, 123, suffix_dedup._SLICE_BYTES + 5000)))
    at = suffix_dedup._SLICE_BYTES
    rows = [(1, text), (2, "0" * 10 + text[at - 200 : at + 300] + "1" * 10), (3, text[-150:])]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0
    assert (got[2]["n_removed"], got[2]["n_spans"]) == (500, 1)
    assert got[3]["n_removed"] == 150


def test_whole_result(spark):
    p = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(400))
    df = spark.createDataFrame([(1, p), (2, "x" + p[100:300] + "y")], "doc_id long, text string")
    second = suffix_dedup.remove_repeats(df, whole=True).filter("doc_id = 2").first()
    assert bytes(second["kept"]) == b"xy"
    assert [tuple(s) for s in second["removed"]] == [(1, 201)]


def test_repeated_rows_lose_nothing_by_each_other(spark):
    rng = np.random.default_rng(11)
    t = "".join(chr(97 + int(x)) for x in rng.integers(0, 26, 500))
    u = "".join(chr(97 + int(x)) for x in rng.integers(0, 26, 300))
    rows = [(1, t), (1, t), (1, t), (2, u[:90] + t[150:420] + u[90:]), (2, u[:90] + t[150:420] + u[90:]), (3, t[300:] + u), (None, t), (None, t)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for wide in (suffix_dedup.WIDE, 1):
        compare(df, wide=wide)
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(df).collect()}
    assert got[1] == 0 and got[2] == 270


def test_buckets_follow_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_BUCKET_BYTES", 50_000)
    df = table(spark, "0.01")
    assert suffix_dedup._bucket_count(df) >= 2 * 24
    compare(df)
