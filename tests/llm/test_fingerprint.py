import hashlib

import numpy as np

from panelweave.llm import fingerprint
from tests.llm.rows import odd, table

MASK = (1 << 64) - 1


def mixed(h):
    h ^= h >> 31
    h = (h * 0xBF58476D1CE4E5B9) & MASK
    return h ^ (h >> 29)


def syncmers(text, s):
    """Positions of closed syncmers by their definition."""
    hashes = []
    for i in range(len(text) - s + 1):
        values, base = [ord(c) + 1 for c in text[i : i + s]], 0x9E3779B97F4A7C15
        while len(values) > 1:
            values = [(values[j] * base + values[j + 1]) & MASK for j in range(0, len(values), 2)]
            base = base * base & MASK
        hashes.append(mixed(values[0]))
    span = 2 * s + 1
    return [i for i in range(len(text) - 3 * s + 1) if min(hashes[i : i + span]) in (hashes[i], hashes[i + span - 1])]


def test_anchors_by_definition():
    text = "Of all the things that were said in the morning, few were remembered at night; é😀 and none by day. " * 3
    for t in (text, text[:80], text[10:200], "aaaa" * 40):
        n, coarse, fine = fingerprint.prints(["abc", t, "x" * 70, t[:30]])[1]
        assert n == len(t) and coarse[1].tolist() == syncmers(t, fingerprint.S)
        assert (fine is None) == (n >= fingerprint.BOTH)
        assert fine is None or fine[1].tolist() == syncmers(t, fingerprint.S_FINE)


def test_anchors_do_not_depend_on_context():
    rng = np.random.default_rng(0)
    middle = "".join(rng.choice(list("abcdefgh "), 400))
    names = lambda t: set(fingerprint.prints([t])[0][1][0].tolist())
    assert names(middle) <= names("z" * 200 + middle + "y" * 200)


def test_likeness():
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("abcdefghijkl "), 3000))
    other = "".join(rng.choice(list("abcdefghijkl "), 3000))
    edited = text[:2000] + other[:1000]
    a, b, c, none = fingerprint.prints([text, edited, other, ""])
    assert fingerprint.likeness(a, a) == 1.0
    assert 0.6 < fingerprint.likeness(a, b) < 0.72
    assert fingerprint.likeness(a, c) < 0.05
    assert fingerprint.likeness(none, none) == 1.0
    assert fingerprint.likeness(none, a) == 0.0


def brute(one, other):
    """Likeness by the definition, from lists of (hash, position)."""
    fine = max(len(one), len(other)) < fingerprint.BOTH and min(len(one), len(other)) < fingerprint.SHORT

    def listed(t):
        _, coarse, short = fingerprint.prints([t])[0]
        seen, out = {}, []
        for name, at in zip(*(x.tolist() for x in (short if fine else coarse)), strict=True):
            seen[name] = seen.get(name, 0) + 1
            out.append(((name, seen[name]), at))
        return out

    a, b = listed(one), listed(other)
    if not a or not b:
        return float(one == other == "")
    at = dict(b)
    moved = [at[k] - p if k in at else None for k, p in a]
    alone = len(a) == 1 or len(b) == 1
    good = [i for i, d in enumerate(moved) if d is not None and (alone or i and moved[i - 1] == d or i + 1 < len(moved) and moved[i + 1] == d)]
    return 2 * len(good) / (len(a) + len(b))


def test_likeness_at_every_length_around_the_scales():
    rng = np.random.default_rng(5)
    draw = lambda n: "".join(rng.choice(list("abcdefghijkl "), n))
    for n in [0, 1, 2, 3, 5, 9, 20, 23, 24, 30, *range(90, 146), *range(186, 200), *range(280, 292), *range(380, 390), 500]:
        text = draw(n)
        for following in ("", "x", draw(7), draw(400), text[:-1], text + "z"):
            changed = fingerprint.edited_text(text, following)
            for other in (changed, following):
                got = fingerprint.likeness(*fingerprint.prints([text, other]))
                assert got == brute(text, other)
            if n >= 60:
                assert fingerprint.likeness(*fingerprint.prints([text, changed])) > 0.4, (n, len(following))
            if n >= 24:
                assert n < 60 or fingerprint.likeness(*fingerprint.prints([text, text[:-1]])) > 0.7


def test_near_columns_against_brute_force(spark):
    df = odd(spark)
    order = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        want.append((i, len(t), brute(t, fingerprint.edited_text(t, following)), brute(t, following)))
    got = [(r["doc_id"], r["n_chars"], r["near_edited"], r["near_next"]) for r in fingerprint.fingerprints(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def expected(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + following[:n]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out, key=str)


def test_edited_texts(spark):
    for df in (odd(spark), table(spark), table(spark).limit(1), table(spark).limit(0)):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = fingerprint.fingerprints(df).collect()
        assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == expected(rows)


def test_columns(spark):
    got = fingerprint.fingerprints(table(spark)).collect()
    texts = {r["doc_id"]: r["text"] for r in table(spark).collect()}
    prints = {}
    for r in got:
        assert prints.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    long = [r for r in got if r["n_chars"] >= 400]
    assert np.mean([r["near_edited"] for r in long]) > 0.6
    assert np.median([r["near_next"] for r in got]) < 0.05
