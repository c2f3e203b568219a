import random

import numpy as np
import pyarrow as pa

from panelweave.llm import near_dedup
from tests.llm.rows import LOWER, ODD, WORDS, odd, table


def expected(rows, width, threshold):
    """Components by comparing every pair of distinct sets."""
    sets = {}
    for doc_id, text in rows:
        words = WORDS.findall((text or "").translate(LOWER))
        n = min(width, len(words))
        if doc_id is not None:
            sets[doc_id] = frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else frozenset()
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    first = {}
    for i in sorted(sets):
        if sets[i]:
            label[i] = find(first.setdefault(sets[i], i))
    distinct = sorted(first.items(), key=lambda x: len(x[0]))
    for a, (s, i) in enumerate(distinct):
        for t, j in distinct[a + 1 :]:
            if len(t) * threshold > 100 * len(s):
                break
            both = len(s & t)
            if 100 * both >= threshold * (len(s) + len(t) - both):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def compare(df, rows, width, threshold):
    want = expected(rows, width, threshold)
    got = near_dedup.near_duplicates(df, width, threshold).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == want[r["doc_id"]]


def test_table(spark):
    df = table(spark, "0.01")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    for width, threshold in ((3, 85), (5, 80)):
        compare(df, rows, width, threshold)


def test_awkward_rows(spark):
    compare(odd(spark), [r[:2] for r in ODD], 3, 85)
    assert near_dedup.near_duplicates(table(spark).limit(0)).collect() == []
    kept = near_dedup.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 7, 7, 8, 10, 11, None, None, 12]))


def copies(n, words=150, most=0.2, seed=5):
    """Near copies of one text with growing numbers of changed words, some of them linked only to each other."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        own = list(base)
        for _ in range(int(words * most * i / n)):
            own[rng.randrange(words)] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
        if i % 40 == 0:
            own[3] = "twin"
            rows.append((10_000 + i, " ".join(own)))
    return rows


def test_one_large_group_of_near_copies(spark, monkeypatch):
    rows = copies(400)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    compare(df, rows, 3, 85)
    monkeypatch.setattr(near_dedup, "GROUP", 16)  # several salts and blocks for one star
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    compare(df, rows, 3, 85)


def test_estimate_by_likelihood():
    rng = np.random.default_rng(0)
    for n, m, both in ((500, 500, 400), (300, 600, 290), (2000, 1500, 700)):
        found = []
        for _ in range(30):
            x = rng.integers(0, 2**63, n + m - both, dtype=np.uint64)
            r = near_dedup.registers([np.sort(x[:n]), np.sort(x[n - both :])])
            found.append(near_dedup.likeness(r[:1], r[1:], np.asarray([n]), np.asarray([m]))[0])
        assert abs(np.mean(found) - both / (n + m - both)) < 0.03


def test_shingle_sets():
    sets = near_dedup.shingle_sets(pa.array(["A b c", "a  B\tc\x0b", "a b", "", "a b c d a b c"]), 3)
    assert [len(s) for s in sets] == [1, 1, 1, 0, 4]
    assert sets[0].tolist() == sets[1].tolist() != sets[2].tolist()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 0, -1)] + [(500, 400)], "a long, b long")
    got = {r["id"]: r["label"] for r in near_dedup.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 102)}, 400: 400, 500: 400}


def test_a_star_is_copied_only_to_blocks_with_open_members(spark):
    star = 3000
    rows = spark.range(star).selectExpr(
        "1L AS hub", "id + 10 AS member", f"{star}L AS star", "id IN (5, 6, 2000) AS rest", "9L AS n_member", "unhex('00') AS bits", "unhex('') AS outside"
    )
    whole = spark.range(400).selectExpr("2L AS hub", "id + 9000 AS member", "400L AS star", "false AS rest", "9L AS n_member", "unhex('00') AS bits", "unhex('') AS outside")
    made = near_dedup._star_blocks(rows.unionByName(whole)).collect()
    blocks = -(-star // near_dedup.BLOCK)
    second = [r for r in made if not r["rest"]]
    assert len({r["i"] for r in second}) <= 3 and len(second) == star * len({r["i"] for r in second})
    assert len(made) - len(second) == 3 * blocks
    met = {(a["member"], b["member"]) for a in made if a["rest"] for b in second if (a["i"], a["j"]) == (b["i"], b["j"])}
    assert met == {(a + 10, b + 10) for a in (5, 6, 2000) for b in range(star)}
