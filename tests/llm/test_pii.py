import hashlib
import re

from panelweave.llm import pii
from tests.llm.rows import ODD, odd, table

# the patterns as the contract words them
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), k, m.end(), kind))
    return sorted(found)


def compare(df):
    source = sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())
    got = sorted(((str(r["doc_id"]), r) for r in pii.personal_data(df).collect()), key=lambda x: x[0])
    assert [i for i, _ in source] == [i for i, _ in got]
    texts = {}
    for i, t in source:
        texts.setdefault(i, []).append(t)
    for i, r in got:
        options = []
        for t in texts[i]:
            want = base(t)
            joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
            counts = tuple(sum(k == kind for _, _, _, k in want) for kind in PATTERNS)
            options.append((counts, hashlib.sha256(joined.encode()).hexdigest(), joined))
        own = ",".join(s for s in r["spans"].split(",") if not s.startswith("term"))
        assert ((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]), r["base_sha256"], own) in options


def test_table(spark):
    compare(table(spark, "0.01"))


def test_awkward_rows(spark):
    more = [
        "a@b.c_d@e.f x@y a@b@c.d ..@-.-", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4 " + "9" * 60 + ".1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1112",
        "é😀 x@y.zé +49 (0)30 123456 .", "+1......2 +1 234 567 8901- ++12 345 678 90 1", "1" * 5000 + " 4111111111111111", "a" * 100_000,
        "x@y.zz " * 500, "+1" + " " * 50_000, "😀4111111111111111😀", "1 " * 20_000,
    ]
    compare(odd(spark, ODD + [(100 + i, t, None, None, None) for i, t in enumerate(more)]))
    assert pii.personal_data(odd(spark).limit(0)).collect() == []


def test_terms_that_give_an_entity_away(spark):
    rows = [(i, f"note {i} by Mortimer q{i}x bob@corp.example r{i}y.\nlater mortimer went") for i in range(5)]
    rows += [(100 + i, f"the usual note number {i} by the usual people went out later " * 40) for i in range(40)]
    rows += [(200, "alice@corp.example wrote once with Zebedee"), (201, "a note by Mortimer alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    for i in range(5):
        text = rows[i][1]
        spans = [s.split(":") for s in got[i]["spans"].split(",")]
        terms = [text[int(a) : int(b)] for k, a, b in spans if k == "term"]
        assert terms.count("Mortimer") == 1 and terms.count("mortimer") == 1
        assert "the" not in terms and f"q{i}x" not in terms
    assert got[200]["spans"] == "email:0:18"  # seen once, so nothing is known of its company
    assert got[201]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert "bob@" not in clean[1] and "ortimer" not in clean[1] and "[EMAIL]" in clean[1]
    assert clean[200] == "[EMAIL] wrote once with Zebedee"
    assert set(clean) == {0, 1, 2, 3, 4, 200}


def test_copies_of_a_context_count_once(spark):
    rows = [(i, "call Mortimer at bob@corp.example please") for i in range(6)] + [(100, "other words here " * 200)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["n_term"] for r in got) == 0


BREAK = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def shares(rows):
    """(key, term) -> share, by the definitions."""
    import math
    from collections import Counter

    words, contexts = Counter(), set()
    for _, text in rows:
        words.update(w.lower() for w in BREAK.split(text) if w)
        for kind, pattern in PATTERNS.items():
            hits = [m for m in pattern.finditer(text)]
            good = {(a, e) for a, _, e, k in base(text) if k == kind}
            for i, m in enumerate(hits):
                if m.span() not in good:
                    continue
                before = [w for w in BREAK.split(text[hits[i - 1].end() if i else 0 : m.start()]) if w][-pii.REACH :]
                after = [w for w in BREAK.split(text[m.end() : hits[i + 1].start() if i + 1 < len(hits) else len(text)]) if w][: pii.REACH]
                terms = tuple(sorted({w.lower() for w in before + after if len(w) >= pii.LEAST_LETTERS}))
                digits = re.sub("[^0-9]", "", m[0])
                group = {"email": m[0].split("@")[-1].lower(), "ip": ".".join(m[0].split(".")[:3]), "card": digits[:6], "phone": digits[:5]}[kind]
                contexts |= {(f"{kind}={m[0]}", terms), (f"{kind}~{group}", terms)}
    n_key = Counter(k for k, _ in contexts)
    joint = Counter((k, t) for k, terms in contexts for t in terms)
    per_word = 2 * pii.REACH / sum(words.values())
    out = {}
    for (k, t), n in joint.items():
        p_t, p_k = min(1, words[t] * per_word), min(1, n_key[k] * per_word)
        chance = n_key[k] * p_t
        if n <= chance or n - chance + n * math.log(chance / n) + math.log(len(joint)) > math.log(pii.CHANCE) or p_k >= 1:
            continue
        share = min(1.0, math.log2((n + p_t) / (n_key[k] + 1) / p_t) / -math.log2(p_k))
        if share >= pii.GENERALISE:
            out[k, t] = round(share, 9)
    return out


def planted():
    """Entities that occur once each, with a term that gives their group away, in ordinary text."""
    rows = [(i, f"report file{i} from Zorgomat staff, person{i}.x{i}@zorg.example said more on day {i}. " + "plain words follow here " * 20) for i in range(12)]
    rows += [(50 + i, f"host rack{i} Quibblenet{'' if i % 2 else ' node'} at 10.77.3.{i} answered\nquibblenet again later " + "plain words follow here " * 20) for i in range(10)]
    rows += [(100 + i, f"someone{i} wrote from some{i}.one@mail{i}.example about topic{i} " + "plain words follow here " * 30) for i in range(30)]
    rows += [(200 + i, "plain words follow here and a report of the day from staff " * 12) for i in range(40)]
    return rows


def test_shares_against_brute_force(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.disclosing_terms(pii.texts(df), pii.scan(pii.texts(df))).collect()
    want = shares(rows)
    assert {(r["key"], r["term"]): round(r["share"], 9) for r in found} == want
    assert {("email~zorg.example", "zorgomat"), ("ip~10.77.3", "quibblenet")} <= set(want)


def test_terms_of_groups_whose_entities_occur_once(spark):
    rows = planted()
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    for i in got:
        terms = {texts[i][int(s.split(":")[1]) : int(s.split(":")[2])].lower() for s in got[i]["spans"].split(",") if s.startswith("term")}
        if i < 12:
            assert "zorgomat" in terms
        elif 50 <= i < 60:
            assert "quibblenet" in terms and got[i]["n_term"] >= 2
        else:
            assert not terms, (i, terms)
        assert not terms & {"plain", "words", "follow", "here", "day"}


def test_thousands_of_spans_take_time_in_proportion(spark):
    import time

    texts = {n: " ".join(f"user{i}@host{i}.example.com writes" for i in range(n)) for n in (300, 20_000)}
    took = {}
    for n, text in texts.items():
        start = time.time()
        (got,) = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
        took[n] = time.time() - start
        want = ",".join(f"{k}:{s}:{e}" for s, _, e, k in base(text))
        assert got["n_email"] == n and got["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert took[20_000] < took[300] + 8


def test_terms_at_the_edges_of_base_spans(spark):
    rows = [(i, f"Zorgomat person{i}@zorg.example Zorgomat{i}@zorg.example,zorgomat-4.3.2.{i} item{i}") for i in range(9)] + [(50 + i, "plain words follow here " * 40) for i in range(30)]
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(9):
        spans = [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in got[i]]
        own = [s for s in spans if s[0] != "term"]
        for _, a, b in (s for s in spans if s[0] == "term"):
            assert rows[i][1][a:b].lower() == "zorgomat" and not any(x < b and a < y for _, x, y in own)
        assert sum(s[0] == "term" for s in spans) == 2
