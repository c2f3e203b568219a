import re
from collections import Counter

import pyarrow as pa
import pytest

from panelweave.llm import phrases
from tests.llm.rows import LOWER, ODD, odd, table

PIECES, WORDS = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def counted(rows):
    f = Counter()
    for lang, text in rows:
        for piece in PIECES.split((text or "").translate(LOWER)):
            w = WORDS.findall(piece)
            f.update((lang or "und", *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    return f


def expected(rows, least=10, top=2000):
    f = counted(rows)
    n = Counter()
    for g, c in f.items():
        if len(g) == 2:
            n[g[0]] += c
    out = {}
    for g, a in f.items():
        lang, w = g[0], g[1:]
        if len(w) < 2 or a < least:
            continue
        cuts = [(1_000_000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right, w))
    final = []
    for lang, found in out.items():
        longer = {}
        for _, c, _, _, _, w in found:
            if len(w) == 3:
                for part in (w[:2], w[1:]):
                    longer[part] = max(longer.get(part, 0), -c)
        kept = sorted(x for x in found if 100 * longer.get(x[5], 0) < 50 * -x[1])
        final += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(kept[:top])]
    return sorted(final)


def rows_of(df):
    return [(r["lang"], r["text"]) for r in df.select("lang", "text").collect()]


def test_table(spark):
    df = table(spark, "0.01")
    assert sorted(map(tuple, phrases.collocations(df).collect())) == expected(rows_of(df))


MORE = [
    "New York, new york! NEW YORK; new\tyork: new york new york new york", "of the new york times " * 30, "of the " * 200, "a b. a b? a\nb a  b a\t\tb " * 9,
    "é😀 漢字 é😀 漢字 é😀 漢字 " * 8, "the new york times\x0bthe new york times\rthe new york times " * 11, "ĞĞ İ ğğ ſ K " * 14, "\x00 \x01 " * 12,
]


@pytest.mark.parametrize("sample_of", [1, 3, 1000])
def test_awkward_rows(spark, sample_of):
    df = odd(spark, ODD + [(100 + i, t, ("en", None, "und", "fr")[i % 4], None, None) for i, t in enumerate(MORE)])
    got = phrases.collocations(df, least=4, top=5, sample_of=sample_of)
    assert sorted(map(tuple, got.collect())) == expected(rows_of(df), 4, 5)
    assert phrases.collocations(df.limit(0)).collect() == []


def test_full_filters_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_BITS", 15)
    monkeypatch.setattr(phrases, "BITS_A_PHRASE", 1)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 3000)
    df = table(spark, "0.01")
    assert sorted(map(tuple, phrases.collocations(df, least=6).collect())) == expected(rows_of(df), 6)


def test_counts_of_all_phrases_after_border_failures(spark):
    df = table(spark)
    f = counted(rows_of(df))
    want = sorted((g[0], " ".join(g[1:]), len(g) - 1, c) for g, c in f.items() if c >= 3)
    got = phrases.frequent_phrases(df, least=3, sample_of=40).filter("k > 0").collect()
    assert sorted(map(tuple, got)) == want


def test_passes_partition_what_is_counted():
    lang, text = pa.array(["en"]), pa.array(["a b c d a b c"])
    every = (15, b"\xff" * 4096)
    none = (15, bytes(4096))
    first = [(p.to_pylist(), k) for _, p, k, _ in phrases.count_block(lang, text, [(none, none)])]
    assert [k for _, k in first] == [1, 0]
    second = {k: sorted(p.to_pylist()) for _, p, k, _ in phrases.count_block(lang, text, [(none, none), (every, every)])}
    assert second == {2: ["a b", "b c", "c d", "d a"], 3: ["a b c", "b c d", "c d a", "d a b"]}
    assert list(phrases.count_block(lang, text, [(every, every), (every, every)])) == []


def test_products_beyond_64_bits(spark):
    big = 9_000_000_000_000
    rows = [("en", "x", 1, big + 5), ("en", "y", 1, big + 7), ("en", "x y", 2, big), ("en", "y x", 2, 11), ("en", "x y x", 3, 10)]
    got = {r["phrase"]: tuple(r)[2:] for r in phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, k int, c long")).collect()}
    assert got["x y"] == (big, big + 5, big + 7, 10**6 * big * big // ((big + 5) * (big + 7)))
    assert "y x" not in got and got["x y x"] == (10, big + 5, 11, 10**6 * 100 // ((big + 5) * 11))


def test_frequent_words_and_one_language(spark):
    rows = [(i, "en", " ".join(f"the w{i % 40} of x{j % 25}" for j in range(30))) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert sorted(map(tuple, phrases.collocations(df, top=50).collect())) == expected(rows_of(df), top=50)
