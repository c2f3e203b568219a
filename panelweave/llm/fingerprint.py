"""Document fingerprints from closed syncmers, compared by position.

A run of ``3 * S`` characters is an anchor when, of the ``2 * S + 1`` runs of ``S`` characters inside it, one with
the smallest hash is the first or the last. Whether a run is an anchor depends on its own characters alone,
so an edit changes only anchors that overlap it, and neighbouring anchors are at most ``2 * S + 1`` characters
apart. The fingerprint lists all anchors in order: a 32-bit hash and the distance from the one before. Texts of
fewer than ``BOTH`` characters also list the anchors of a finer scale, behind a dot; one too short for that has one fine
anchor, the hash of all of it.

Two fingerprints are always compared at one scale: the finer if both have it and one of the texts is shorter than ``SHORT``, else the
coarse one. Two texts that share their first two thirds, as a text and its edited one, so meet at every length; a text
of fewer than 24 characters has nothing in common with one of ``BOTH`` or more. Equal hashes are paired in order of
occurrence, and a pair counts when the pair before or after it has the same displacement; a lone anchor has none beside it and counts
by itself. The likeness is twice the pairs that count over the anchors of both.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from panelweave.llm.common import in_arrow, texts

S = 8
#: Texts of fewer characters than ``SHORT`` are compared at the finer scale, where both have it: those below ``BOTH``.
SHORT, BOTH, S_FINE = 192, 384, 2
#: Text of a range of ids, and ranges at most (their bounds are part of the plan); larger ranges only take longer to sort.
_RANGE_BYTES, _MOST_RANGES = 16 << 20, 20_000
_BASE, _WORD = 0x9E3779B97F4A7C15, (1 << 64) - 1
_COARSE = 64
_STEP_ROWS, _STEP_CHARS = 512, 1_000_000
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
Anchors = tuple[np.ndarray, np.ndarray]
Print = tuple[int, Anchors, Anchors | None]  # characters, coarse anchors, fine ones of a text below BOTH


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _syncmers(strings: Sequence[str], s: int) -> list[Anchors]:
    """Hashes and positions of the closed syncmers of each text; all texts are worked on as one array."""
    k, span = 3 * s, 2 * s + 1
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter((len(t) for t in strings), dtype=np.int64, count=len(strings))
    ends = np.cumsum(sizes)
    if len(points) < k:
        return [(np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)) for _ in strings]
    h, base, width = points, _BASE, 1
    while width < s:  # polynomial hashes of twice the width, s being a power of two
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base & _WORD, width * 2
    h = _mix(h)
    low, width = h, 1
    while width * 2 <= span:
        low, width = np.minimum(low[:-width], low[width:]), width * 2
    low = np.minimum(low[: len(h) - span + 1], low[span - width : len(h) - width + 1])
    at = np.flatnonzero((low == h[: len(low)]) | (low == h[span - 1 :]))
    of = np.searchsorted(ends, at, side="right")
    inside = at + k <= ends[of]
    at, of = at[inside], of[inside]
    names = _mix(h[at] + _mix(h[at + s]) * np.uint64(_BASE) + h[at + 2 * s] * np.uint64(0x94D049BB133111EB)).astype(np.uint32)
    cut = np.searchsorted(of, np.arange(len(strings) + 1))
    return [(names[a:b], at[a:b] - (e - n)) for a, b, e, n in zip(cut[:-1], cut[1:], ends, sizes, strict=True)]


def prints(strings: Sequence[str]) -> list[Print]:
    """Length and anchors of each text."""
    some = [i for i, t in enumerate(strings) if len(t) < BOTH]
    fine: dict[int, Anchors] = dict(zip(some, _syncmers([strings[i] for i in some], S_FINE), strict=True))
    for i in some:
        if strings[i] and not len(fine[i][0]):
            whole = int.from_bytes(hashlib.blake2b(strings[i].encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little")
            fine[i] = (np.asarray([whole], dtype=np.uint32), np.zeros(1, dtype=np.int64))
    return [(len(t), a, fine.get(i)) for i, (t, a) in enumerate(zip(strings, _syncmers(strings, S), strict=True))]


def _listed(found: Anchors) -> str:
    names, at = found
    rows = np.empty(len(names), dtype=[("name", "<u4"), ("gap", "u1")])
    rows["name"] = names
    rows["gap"] = np.minimum(np.diff(at, prepend=0), 255)
    return base64.b64encode(rows.tobytes()).decode()


def encoded(found: Print) -> str:
    """Anchors as text: five bytes each (hash, distance from the anchor before), in base 64; fine ones behind a dot."""
    return _listed(found[1]) + (f".{_listed(found[2])}" if found[2] is not None and found[0] else "")


def _numbered(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the anchors by (hash, occurrence) and the key hash * 2**32 + occurrence in that order."""
    order = np.argsort(names, kind="stable")
    ranked = names[order]
    first = np.flatnonzero(np.diff(ranked, prepend=ranked[0] - np.uint32(1) if len(ranked) else 0) != 0)
    number = np.arange(len(ranked)) - np.repeat(first, np.diff(np.append(first, len(ranked))))
    return order, (ranked.astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64)


def likeness(one: Print, other: Print) -> float:
    """Positional likeness of two fingerprints, 0 to 1; two empty texts are alike, an empty one is like no other."""
    fine = one[2] is not None and other[2] is not None and min(one[0], other[0]) < SHORT
    a, b = (one[2], other[2]) if fine else (one[1], other[1])
    n, m = len(a[0]), len(b[0])
    if not n or not m:
        return 1.0 if one[0] == other[0] == 0 else 0.0
    (order_a, key_a), (order_b, key_b) = _numbered(a[0]), _numbered(b[0])
    _, in_a, in_b = np.intersect1d(key_a, key_b, assume_unique=True, return_indices=True)
    if not len(in_a):
        return 0.0
    if min(n, m) == 1:
        return 2.0 * len(in_a) / (n + m)
    moved = np.full(n, np.iinfo(np.int64).min)
    moved[order_a[in_a]] = b[1][order_b[in_b]] - a[1][order_a[in_a]]
    same = (moved[1:] == moved[:-1]) & (moved[1:] != np.iinfo(np.int64).min)
    counts = np.append(same, False) | np.append(False, same)
    return 2.0 * int(counts.sum()) / (n + m)


def edited_text(text: str, following: str) -> str:
    """The text with its last third replaced by as many first characters of the following one (or all)."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _work(rows: list[tuple[int, str]], following: list[str]) -> dict[str, list]:
    """Output columns of consecutive rows; ``following`` holds the text after each row."""
    own = [t for _, t in rows]
    changed = [edited_text(a, b) for a, b in zip(own, following, strict=True)]
    found = prints([*own, following[-1]])
    after = prints(changed)
    return {
        "doc_id": [i for i, _ in rows], "n_chars": [len(t) for t in own],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        "fingerprint": [encoded(p) for p in found[:-1]], "edited_fingerprint": [encoded(p) for p in after],
        "near_edited": [likeness(a, b) for a, b in zip(found[:-1], after, strict=True)],
        "near_next": [likeness(a, b) for a, b in zip(found[:-1], found[1:], strict=True)],
    }


def _bucket(bounds: list[float]) -> Column:
    """Number of bounds above doc_id, by a coarse and a fine step; rows without an id come last."""
    coarse = F.array(*[F.lit(b) for b in bounds[::_COARSE]])
    every = F.array(*[F.lit(b) for b in bounds])
    value = F.col("doc_id").cast("double")
    block = F.greatest(F.size(F.filter(coarse, lambda b: b > value)) - 1, F.lit(0)) * _COARSE
    fine = block + F.size(F.filter(F.slice(every, block + 1, _COARSE), lambda b: b > value))
    return F.when(value.isNull(), F.lit(len(bounds))).otherwise(fine).cast("int")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next.

    Documents follow each other in descending doc_id (rows with equal ids by text, rows without an id last; the
    last is followed by the first). They are dealt into ranges of ids of some ``_RANGE_BYTES`` of text,
    each sorted, and each range also gets the first row of the range that follows it; so the texts are shuffled
    once and a task reads its rows one batch after another. Null counts as empty; an empty text has an empty
    fingerprint, like only to another empty one. A single document is followed by itself. An empty table gives no rows; other
    columns are ignored. A text of any length is fingerprinted whole; its task holds a few numbers for each character.
    """
    spark = docs.sparkSession
    source = texts(docs)
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(spark.sparkContext.defaultParallelism, min(_MOST_RANGES, -(-size // _RANGE_BYTES)))
    probs = [i / n for i in range(n - 1, 0, -1)]
    bounds = sorted(set(source.filter("doc_id is not null").approxQuantile("doc_id", probs, 0.25 / n)) if n > 1 else [], reverse=True)
    dealt = source.withColumn("bucket", _bucket(bounds) if bounds else F.lit(0))
    tops = dealt.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    heads = dealt.join(F.broadcast(tops), "bucket").filter(F.col("doc_id").eqNullSafe(F.col("top")))  # a row per range
    heads = heads.groupBy("bucket").agg(F.first("top").alias("doc_id"), F.min("text").alias("text"))
    present = sorted(r["bucket"] for r in tops.select("bucket").collect())  # at most as many as ranges
    before = {b: present[i - 1] for i, b in enumerate(present)}
    ends = heads.withColumn("bucket", F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("bucket"))) if before else heads
    rows = dealt.withColumn("own", F.lit(True)).unionByName(ends.withColumn("own", F.lit(False)))
    streams = rows.repartition(n, "bucket").sortWithinPartitions("bucket", F.desc("own"), F.desc_nulls_last("doc_id"), "text")
    kind = spark.createDataFrame([], SCHEMA).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        held: list[tuple[int, str]] = []
        following: list[str] = []
        chars = 0

        def made() -> pa.RecordBatch:
            columns = _work(held, following)
            return pa.RecordBatch.from_pydict({f.name: pa.array(columns[f.name], f.type) for f in out}, schema=out)

        last: tuple[int, str] | None = None
        for batch in batches:
            for doc_id, text, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "own")), strict=True):
                if last is not None:
                    held.append(last)
                    following.append(text)
                    chars += len(last[1])
                if held and (not own or len(held) >= _STEP_ROWS or chars >= _STEP_CHARS):
                    yield made()
                    held, following, chars = [], [], 0
                last = (doc_id, text) if own else None

    return in_arrow(streams.select("doc_id", "text", "own"), run, kind)
