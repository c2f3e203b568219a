"""Secrets in text: fixed patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a run of at least ``WINDOW`` characters of the base64 and URL alphabets. A window moves over
it one character at a time; the counts of its characters and the sum of ``c * log2(c)`` are updated for the
character that enters and the one that leaves, so a run costs time in proportion to its length. Windows are
judged by the class of their characters: hexadecimal ones against a lower threshold than base64 ones, since
sixteen symbols carry at most four bits. Overlapping windows above the threshold merge into one span of kind
``entropy``, which extends to the edges of its tokens of letters and digits. What looks random and is none is cut
out of a run and the parts beside it are scanned each: alphabets in order, placeholders, and spans the fixed
patterns have already named. Spans without a digit or without a letter are no secrets.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re

from pyspark.sql import DataFrame

from panelweave.llm.common import by_batch, texts

WINDOW = 20
#: Bits a character, by class of the window's characters.
HEX_BITS, BASE64_BITS = 3.0, 3.85

# The patterns of the contract and their least lengths.
ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
_HEX_WINDOW = frozenset("0123456789abcdefABCDEF")
#: Placeholders and alphabets that are no secrets (compared in lower case).
ALLOWED = re.compile(r"example|placeholder|changeme|dummy|x{6,}|0{8,}|abcdefghij|0123456789|123456789|qwertyuiop|your[_-]")


def _base(text: str) -> list[tuple[int, int, int]]:
    """Spans of the fixed patterns as (start, kind, end)."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def window_spans(run: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged windows of a candidate whose entropy reaches the threshold of their class."""
    if len(run) < window:
        return []
    weigh = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]
    counts: dict[str, int] = {}
    weight, others, found = 0.0, 0, []
    whole = math.log2(window)
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        weight += weigh[n + 1] - weigh[n]
        others += c not in _HEX_WINDOW
        if i >= window:
            gone = run[i - window]
            n = counts[gone]
            counts[gone] = n - 1
            weight -= weigh[n] - weigh[n - 1]
            others -= gone not in _HEX_WINDOW
        if i >= window - 1 and whole - weight / window >= (BASE64_BITS if others else HEX_BITS) - 1e-9:
            start = i - window + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


def allowed(span: str) -> bool:
    """Whether a span of high entropy is on the allow-list: without a letter or without a digit."""
    return not any(c.isalpha() for c in span) or not any(c.isdigit() for c in span)


def _rest(start: int, end: int, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the cuts (in order of their starts) leave of a stretch, in parts of at least a window."""
    parts = []
    for s, e in cuts:
        if s < end and e > start:
            parts.append((start, s))
            start = max(start, e)
    return [(a, b) for a, b in [*parts, (start, end)] if b - a >= WINDOW]


def _token_edges(run: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans extended to the edges of the letters and digits they begin and end in, merged where they meet."""
    found: list[tuple[int, int]] = []
    for a, b in spans:
        while a and run[a - 1].isalnum() and run[a].isalnum():
            a -= 1
        while b < len(run) and run[b].isalnum() and run[b - 1].isalnum():
            b += 1
        if found and a <= found[-1][1]:
            found[-1] = (found[-1][0], max(b, found[-1][1]))
        else:
            found.append((a, b))
    return found


def _entropy(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    found, named, at = [], [(s, e) for s, _, e in taken], 0
    for m in CANDIDATE.finditer(text):
        while at < len(named) and named[at][1] <= m.start():
            at += 1
        near = []
        for s, e in itertools.islice(named, at, None):
            if s >= m.end():
                break
            near.append((s, e))
        whole = m.group()
        # inside a token, with letters or digits on both sides, it is a part of the token
        own = [p.span() for p in ALLOWED.finditer(whole.lower()) if not (whole[p.start() - 1 : p.start()].isalnum() and whole[p.end() : p.end() + 1].isalnum())]
        placeholders = [(m.start() + s, m.start() + e) for s, e in own]
        for a, b in _rest(m.start(), m.end(), sorted(near + placeholders)):
            run = text[a:b]
            if not run.isalpha() and not run.isdigit():
                found += [(a + s, 3, a + e) for s, e in _token_edges(run, window_spans(run)) if not allowed(run[s:e])]
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    """Spans as kind:start:end, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(rows: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans")}
    for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
        base = _base(text)
        more = _entropy(text, base)
        out["doc_id"].append(doc_id)
        for i, name in enumerate(("n_assign", "n_access", "n_hex")):
            out[name].append(sum(k == i for _, k, _ in base))
        out["n_entropy"].append(len(more))
        out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
        out["spans"].append(joined(sorted(base + more)))
    return out


def secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts per kind, the digest of the base spans and all spans.

    Positions count code points, ends are exclusive, spans are ordered by start and then kind. Null and empty
    texts have no spans (an empty string, and the digest of one). Whole texts are scanned in one pass each;
    repeated rows repeat, an empty table gives no rows, and other columns are ignored. Spans of different kinds may begin at the
    same place; all are told, in the order of the kinds. A text of any length is scanned in time proportional to it.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"
    return by_batch(texts(docs), _scan, schema)
