import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelweave.llm import packing
from tests.llm.rows import odd, table

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, got):
    """Every id in exactly one piece with its checksum, sequences without gaps; returns the share of filled places."""
    tokenizer = Tokenizer.from_file(PATH)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for doc_id, copies in rows.items():
        assert len(set(copies)) == 1
        ids = np.asarray(tokenizer.encode(copies[0] or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want = defaultdict(int)
        for r in pieces[doc_id]:
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
            for i in range(r["start"], r["start"] + r["length"]):
                want[i] += 1
        assert want == dict.fromkeys(range(len(ids)), len(copies))
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
    return sum(r["length"] for r in got) / (len(sequences) * packing.CAPACITY)


def test_table(spark):
    docs = table(spark, "0.01").coalesce(1)
    rows = {r["doc_id"]: [r["text"]] for r in docs.collect()}
    assert check(rows, packing.pack_documents(docs, PATH).collect()) > 0.99


def test_awkward_rows(spark):
    rows = defaultdict(list)
    df = odd(spark).filter("doc_id IS NOT NULL")
    for r in df.collect():
        rows[r["doc_id"]].append(r["text"])
    check(rows, packing.pack_documents(df, PATH).collect())
    assert packing.pack_documents(odd(spark).filter("doc_id IS NULL"), PATH).count() == 2
    assert packing.pack_documents(df.limit(0), PATH).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aAéİß'sT19½ \n\t,.|<>-_漢😀́ Σς")) , max_size=40), max_size=8))
def test_word_tokens_equal_whole_texts(texts):
    texts = [*texts, "<|endoftext|> a<|startoftext|>b", "they'll it's DON'T"]
    tokenizer = packing.WordTokenizer(PATH)
    ids, counts = tokenizer.texts(pa.array(texts, pa.string()))
    want = [tokenizer.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=30))
def test_pieces(lengths):
    pieces = packing.pack(lengths, 16)
    for i, n in enumerate(lengths):
        own = sorted((s, length) for d, s, length, _, _ in pieces if d == i)
        assert sum(length for _, length in own) == n
        assert all(a + b == c for (a, b), (c, _) in zip(own, own[1:], strict=False))
    fill = defaultdict(int)
    for _, _, length, k, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert offset == fill[k]
        fill[k] += length
    assert all(0 < n <= 16 for n in fill.values())
    assert len(fill) <= -(-sum(lengths) // 16) + sum(n // 16 > 0 for n in lengths)


def test_costs_are_balanced():
    rng = np.random.default_rng(1)
    lengths = rng.integers(20, 900, 1000).tolist()
    cost = defaultdict(float)
    for _, _, length, k, _ in packing.pack(lengths):
        cost[k] += packing.LINEAR * length + packing.QUADRATIC * length**2
    spread = np.asarray(sorted(cost.values())[1:])
    assert spread.std() < 0.1 * spread.mean()
