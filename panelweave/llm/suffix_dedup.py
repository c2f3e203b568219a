"""Repeated passages by longest-previous-factor arrays, whatever documents they are in.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts earlier: in a document of smaller id,
or earlier in the same one. A suffix array of the whole corpus would be one sort of every position, so the
corpus is first cut into segments such that equal strings meet:

1. Every window of ``LENGTH`` bytes has an anchor, the leftmost of its ``GRAM``-byte strings with the smallest
   hash. It depends on the window's bytes alone. Neighbouring windows with the same anchor form a segment.
   Tasks send (anchor, hash of the segment, place) to the anchor's bucket, one row for equal segments of a
   batch; later copies are marked at once. A passage in a third of all documents is so one row per batch.
2. A bucket keeps the first of equal segments and marks the others. Segments that differ but share an anchor
   may share windows: their bytes are asked for.
3. The texts, dealt by document, send the bytes asked for to the anchor's bucket.
4. Such a bucket orders its segments by place and builds the suffix array of their bytes. For every window the
   previous and next smaller positions in suffix order give the longest previous factor; windows where it
   reaches ``LENGTH`` are marked.
5. The marks meet the texts once more and are cut out.

An anchor with more than ``WIDE`` different segments is not sent as bytes to one task: its windows are sent as
128-bit hashes dealt by hash, one row per distinct window and task, and the first place of each stays. Rows
travel as packed arrays, so a bucket is a handful of rows with numpy columns inside.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from panelweave.llm.common import in_arrow, texts
from panelweave.session import written

LENGTH, GRAM = 100, 32
#: Different segments of one anchor from which its windows are dealt by hash.
WIDE = 50_000
#: Text for each bucket, and buckets of a task: a bucket is held in memory, a task reads its buckets one after another.
_BUCKET_BYTES, _TASK_BUCKETS = 8 << 20, 2
_SLICE_BYTES = 2 << 20
_PLACE_BITS = 22  # places within a slice and its overlap, for the leftmost of equal hashes
_BASE, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LAST = np.iinfo(np.int64).max  # rows without an id come last
MARK, ASK, ASK_WIDE, SEGMENT, BYTES, WINDOW, TEXT = range(7)
ROW = "bucket int, kind int, doc long, tie long, blob binary"
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

_PLACE = [("doc", "<i8"), ("tie", "<u4"), ("start", "<u4"), ("size", "<u4")]
_SEGMENT = np.dtype([("anchor", "<u8"), ("name", "<u8"), *_PLACE])
_ASK = np.dtype([("anchor", "<u8"), *_PLACE])
_MARK = np.dtype(_PLACE)
_WINDOW = np.dtype([("anchor", "<u8"), ("name", "<u8"), *_PLACE])


def _pack(rows: np.ndarray) -> bytes:
    """A structured array column by column, so that sorted and small values compress."""
    return b"".join([len(rows).to_bytes(4, "little"), *(np.ascontiguousarray(rows[c]).tobytes() for c in rows.dtype.names)])


def _unpack(blob: bytes, kind: np.dtype) -> tuple[np.ndarray, int]:
    n, at = int.from_bytes(blob[:4], "little"), 4
    rows = np.empty(n, dtype=kind)
    for c in kind.names:
        rows[c] = np.frombuffer(blob, dtype=kind[c], count=n, offset=at)
        at += n * kind[c].itemsize
    return rows, at


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _bucket_of(docs: np.ndarray, n: int) -> np.ndarray:
    return (_mix(docs.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int64)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def get(self, n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            up, down = np.full(n, base, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


_POWERS = {int(b): _Powers() for b in (_BASE, _SECOND)}


def _range_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of byte ranges."""
    up, down = _POWERS[int(base)].get(len(data) + 1, base)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    h = (sums[starts + sizes] - sums[starts]) * down[starts]
    return _mix(h + sizes.astype(np.uint64) * _M1)


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of texts laid end to end: anchor hash, segment hash, first byte, size."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    h, base, width = data.astype(np.uint64) + np.uint64(1), int(_BASE), 1
    while width < GRAM:
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base & ((1 << 64) - 1), width * 2
    h = _mix(h)
    low_bits = np.uint64((1 << _PLACE_BITS) - 1)
    low = (h & ~low_bits) | np.arange(len(h), dtype=np.uint64)
    span, width = LENGTH - GRAM + 1, 1
    while width * 2 <= span:
        low, width = np.minimum(low[:-width], low[width:]), width * 2
    n = len(data) - LENGTH + 1
    low = np.minimum(low[:n], low[span - width : span - width + n])
    anchor = (low & low_bits).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    last = np.minimum(ends - LENGTH, n - 1)  # the last window of each text
    real = np.zeros(n + 1, dtype=np.int32)
    has = last >= begins
    np.add.at(real, begins[has], 1)
    np.add.at(real, last[has] + 1, -1)
    inside = np.cumsum(real[:n]) > 0
    change = np.empty(n, dtype=bool)
    change[0] = True
    change[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    change[begins[has]] = True
    first = np.flatnonzero(change & inside)
    stop = np.flatnonzero(np.append((change[1:] | ~inside[1:]), True) & inside)
    sizes = stop - first + LENGTH
    return h[anchor[first]] >> np.uint64(16), _range_hashes(data, first, sizes, _BASE), first, sizes


def _firsts(rows: np.ndarray, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The row of smallest place for each key, and the rows at other places that repeat a key."""
    order = np.lexsort([rows[c] for c in ("start", "tie", "doc", *reversed(keys))])
    rows = rows[order]
    new = np.ones(len(rows), dtype=bool)
    if len(rows):
        new[1:] = np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in keys])
    first = rows[new]
    of = np.cumsum(new) - 1
    same = np.logical_and.reduce([rows[c] == first[c][of] for c in ("doc", "tie", "start")]) if len(rows) else new
    return first, rows[~new & ~same]


def _merged(marks: np.ndarray) -> np.ndarray:
    """Marks as maximal ranges per document."""
    if not len(marks):
        return marks
    marks = marks[np.lexsort([marks["start"], marks["tie"], marks["doc"]])]
    new_doc = np.ones(len(marks), dtype=bool)
    new_doc[1:] = (marks["doc"][1:] != marks["doc"][:-1]) | (marks["tie"][1:] != marks["tie"][:-1])
    group = (np.cumsum(new_doc) - 1).astype(np.int64) << 33
    end = group + marks["start"] + marks["size"]
    reach = np.maximum.accumulate(end)
    new = np.ones(len(marks), dtype=bool)
    new[1:] = (group + marks["start"])[1:] > reach[:-1]
    out = marks[new].copy()
    last = np.append(np.flatnonzero(new)[1:] - 1, len(marks) - 1)
    out["size"] = reach[last] - group[last] - out["start"]
    return out


def _as_marks(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), dtype=_MARK)
    for c in _MARK.names:
        out[c] = rows[c]
    return out


def _sent(rows: np.ndarray, bucket: np.ndarray, kind: int) -> list[tuple]:
    """One packed row per bucket."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(rows)]]) if len(rows) else np.zeros(1, dtype=np.int64)
    return [(int(bucket[a]), kind, None, None, _pack(rows[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _batch(rows: list[tuple], out: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Texts as (doc, tie, first byte, bytes) in lists of about ``_SLICE_BYTES``; long texts in chunks that overlap."""
    held, size = [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            doc, tie = _LAST if doc is None else doc, zlib.crc32(data)
            for at in range(0, max(len(data) - LENGTH + 1, 0), _SLICE_BYTES):
                piece = data[at : at + _SLICE_BYTES + LENGTH - 1]
                if held and size + len(piece) > _SLICE_BYTES:
                    yield held
                    held, size = [], 0
                held.append((doc, tie, at, piece))
                size += len(piece)
    if held:
        yield held


def _send_segments(docs: DataFrame, buckets: int) -> DataFrame:
    """Step 1: segments by anchor, and marks of copies within a batch."""
    kind = docs.sparkSession.createDataFrame([], ROW).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        for chunk in _chunks(batches):
            data = np.frombuffer(b"".join(c[3] for c in chunk), dtype=np.uint8)
            ends = np.cumsum([len(c[3]) for c in chunk])
            anchor, name, first, size = segments(data, ends)
            of = np.searchsorted(ends, first, side="right")
            rows = np.empty(len(first), dtype=_SEGMENT)
            rows["anchor"], rows["name"], rows["size"] = anchor, name, size
            for c, k in (("doc", 0), ("tie", 1)):
                rows[c] = np.asarray([x[k] for x in chunk], dtype=_SEGMENT[c])[of]
            begins = np.concatenate([[0], ends[:-1]])
            rows["start"] = first - begins[of] + np.asarray([x[2] for x in chunk])[of]
            unique, copies = _firsts(rows, ["anchor", "name", "size"])
            unique = unique[np.lexsort([unique["start"], unique["doc"]])]
            marks = _merged(_as_marks(copies))
            made = _sent(unique, (unique["anchor"] % np.uint64(buckets)).astype(np.int64), SEGMENT) + _sent(marks, _bucket_of(marks["doc"], buckets), MARK)
            if made:
                yield _batch(made, out)

    return in_arrow(docs, run, kind)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, int, bytes]]]]:
    """Rows (kind, doc, tie, blob) of each bucket, from batches sorted by bucket and kind."""
    now, held = None, []
    for batch in batches:
        for bucket, kind, doc, tie, blob in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append((kind, doc, tie, blob))
    if held:
        yield now, held


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.repartition(max(1, buckets // _TASK_BUCKETS), "bucket").sortWithinPartitions("bucket", "kind")


def _bucket_count(source: DataFrame) -> int:
    """Buckets for some ``_BUCKET_BYTES`` of text each, and at least some for every core. Runs a job."""
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    cores = source.sparkSession.sparkContext.defaultParallelism
    return _TASK_BUCKETS * max(cores, -(-size // (_TASK_BUCKETS * _BUCKET_BYTES)))


def _all(rows: list[tuple], kind: int, dtype: np.dtype) -> np.ndarray:
    found = [_unpack(blob, dtype)[0] for k, _, _, blob in rows if k == kind]
    return np.concatenate(found) if found else np.zeros(0, dtype=dtype)


def _settle(rows: DataFrame, buckets: int, wide: int) -> DataFrame:
    """Step 2: marks of equal segments, and the segments whose bytes are needed."""
    kind = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        for bucket, held in _by_bucket(batches):
            unique, copies = _firsts(_all(held, SEGMENT, _SEGMENT), ["anchor", "name", "size"])
            new = np.ones(len(unique), dtype=bool)
            new[1:] = unique["anchor"][1:] != unique["anchor"][:-1]
            counts = np.diff(np.append(np.flatnonzero(new), len(unique)))
            count = np.repeat(counts, counts)
            marks = _as_marks(copies)
            made = [(bucket, k, None, None, blob) for k, _, _, blob in held if k == MARK]
            made += _sent(marks, _bucket_of(marks["doc"], buckets), MARK)
            for ask, which in ((ASK, (count > 1) & (count <= wide)), (ASK_WIDE, count > wide)):
                wanted = np.empty(int(which.sum()), dtype=_ASK)
                for c in _ASK.names:
                    wanted[c] = unique[c][which]
                made += _sent(wanted, _bucket_of(wanted["doc"], buckets), ask)
            if made:
                yield _batch(made, out)

    return in_arrow(_dealt(rows, buckets), run, kind)


def _texts_by_document(docs: DataFrame, buckets: int) -> DataFrame:
    """Compressed texts dealt by document."""
    kind = docs.sparkSession.createDataFrame([], ROW).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            data = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            keys = np.asarray([_LAST if i is None else i for i in ids], dtype=np.int64)
            bucket = _bucket_of(keys, buckets)
            if ids:
                yield _batch([(int(b), TEXT, i, zlib.crc32(d), squeeze.compress(d)) for b, i, d in zip(bucket, ids, data, strict=True)], out)

    return in_arrow(docs, run, kind)


def _documents(batches: Iterator[pa.RecordBatch], kinds: dict[int, np.dtype]) -> Iterator[tuple[int | None, int, bytes, dict[int, np.ndarray]]]:
    """Every text of a bucket with its packed rows of the given kinds; those sort before the texts."""
    spread = zstandard.ZstdDecompressor()
    now, packed, rows = None, {}, None
    for batch in batches:
        for bucket, kind, doc, tie, blob in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if bucket != now:
                now, packed, rows = bucket, {k: [] for k in kinds}, None
            if kind != TEXT:
                packed[kind].append(_unpack(blob, kinds[kind])[0])
                continue
            if rows is None:
                rows = {}
                for k, found in packed.items():
                    every = np.concatenate(found) if found else np.zeros(0, dtype=kinds[k])
                    rows[k] = every[np.lexsort([every["start"], every["tie"], every["doc"]])]
            own = {}
            key = _LAST if doc is None else doc
            for k, every in rows.items():
                a, b = np.searchsorted(every["doc"], key), np.searchsorted(every["doc"], key, side="right")
                own[k] = every[a:b][every["tie"][a:b] == tie]
            yield doc, tie, spread.decompress(blob, max_output_size=1 << 31) if blob else b"", own


def _send_bytes(rows: DataFrame, buckets: int) -> DataFrame:
    """Step 3: the bytes asked for, by anchor; the windows of wide anchors as hashes."""
    kind = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        asked: list[tuple[np.ndarray, list[bytes]]] = []
        windows: list[np.ndarray] = []
        size = 0

        def made() -> Iterator[pa.RecordBatch]:
            nonlocal asked, windows, size
            sent = []
            if asked:
                places = np.concatenate([a for a, _ in asked])
                pieces = [p for _, own in asked for p in own]
                bucket = (places["anchor"] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
                squeeze = zstandard.ZstdCompressor(level=1)
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    own = order[a:b]
                    sent.append((int(bucket[own[0]]), BYTES, None, None, squeeze.compress(_pack(places[own]) + b"".join(pieces[i] for i in own))))
            if windows:
                unique, copies = _firsts(np.concatenate(windows), ["anchor", "name"])
                marks = _merged(_as_marks(copies))
                sent += _sent(unique, (unique["name"] % np.uint64(buckets)).astype(np.int64), WINDOW) + _sent(marks, _bucket_of(marks["doc"], buckets), MARK)
            asked, windows, size = [], [], 0
            if sent:
                yield _batch(sent, out)

        for _, _, text, own in _documents(batches, {ASK: _ASK, ASK_WIDE: _ASK}):
            if len(own[ASK]):
                places = own[ASK][np.append(True, np.diff(own[ASK]["start"].astype(np.int64)) != 0)]
                asked.append((places, [text[p : p + n] for p, n in zip(places["start"].tolist(), places["size"].tolist(), strict=True)]))
                size += int(places["size"].sum())
            for p, n in zip(own[ASK_WIDE]["start"].tolist(), own[ASK_WIDE]["size"].tolist(), strict=True):
                data = np.frombuffer(text, dtype=np.uint8, count=n, offset=p)
                at = np.arange(n - LENGTH + 1)
                found = np.empty(len(at), dtype=_WINDOW)
                for c, base in (("anchor", _SECOND), ("name", _BASE)):
                    found[c] = _range_hashes(data, at, np.full(len(at), LENGTH), base)
                found["doc"], found["tie"], found["start"], found["size"] = own[ASK_WIDE]["doc"][0], own[ASK_WIDE]["tie"][0], p + at, LENGTH
                windows.append(found)
                size += n * 8
            if size >= _SLICE_BYTES:
                yield from made()
        yield from made()

    return in_arrow(_dealt(rows, buckets), run, kind)


def _rank(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of keys."""
    order = np.argsort(keys)
    ranked = keys[order]
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = np.cumsum(np.append(0, ranked[1:] != ranked[:-1])) if len(keys) else 0
    return rank


def suffix_ranks(data: np.ndarray, limit: int = LENGTH) -> list[tuple[int, np.ndarray]]:
    """(length, ranks of all suffixes by that many first bytes), by doubling up to ``limit`` bytes; the end counts as smallest."""

    def ahead(a: np.ndarray, by: int, fill: int) -> np.ndarray:
        return np.concatenate([a[by:], np.full(min(by, len(a)), fill, dtype=a.dtype)])

    key, width = data.astype(np.uint64) + np.uint64(1), 1
    while width < 4:
        key, width = (key << np.uint64(9 * width)) | ahead(key, width, 0), width * 2
    key, width = (key << np.uint64(27)) | (ahead(key, 4, 0) >> np.uint64(9)), 7  # seven bytes of nine bits
    levels = [(7, _rank(key))]
    while width < limit:
        by = min(width, limit - width)
        rank = levels[-1][1]
        levels.append((width + by, _rank((rank + 1) * (len(data) + 2) + ahead(rank + 1, by, 0))))
        width += by
    return levels


def _common(levels: list[tuple[int, np.ndarray]], data: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of suffix pairs, up to ``limit``."""
    n = len(data)
    total = np.zeros(len(a), dtype=np.int64)
    for width, rank in reversed(levels):
        at, to = a + total, b + total
        real = (at + width <= n) & (to + width <= n) & (total + width <= limit)
        same = real.copy()
        same[real] = rank[at[real]] == rank[to[real]]
        total[same] += width
    for _ in range(limit):  # what the widths of the levels do not add up to
        at, to = a + total, b + total
        real = (at < n) & (to < n) & (total < limit)
        same = real.copy()
        same[real] = data[at[real]] == data[to[real]]
        if not same.any():
            break
        total[same] += 1
    return total


def _smaller_before(order: np.ndarray) -> np.ndarray:
    """For every entry the nearest one before it that is smaller (-1 if none), by pointer jumping."""
    found = np.arange(len(order)) - 1
    wait = np.flatnonzero((found >= 0) & (order[found] > order))
    while len(wait):
        found[wait] = found[found[wait]]
        wait = wait[(found[wait] >= 0) & (order[found[wait]] > order[wait])]
    return found


def longest_previous_factors(data: np.ndarray, starts: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """For each start, the longest string (up to ``limit`` bytes) there that also begins at an earlier start.

    Only the suffixes at ``starts`` (ascending) count. In suffix order, the longest common prefix with any earlier
    start is reached at the nearest entry before or after that is an earlier start.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    levels = suffix_ranks(data, limit)
    suffixes = starts[np.argsort(levels[-1][1][starts], kind="stable")]
    before = _smaller_before(suffixes)
    after = len(suffixes) - 1 - _smaller_before(suffixes[::-1])[::-1]
    longest = np.zeros(len(suffixes), dtype=np.int64)
    for near, some in ((before, before >= 0), (after, after < len(suffixes))):
        longest[some] = np.maximum(longest[some], _common(levels, data, suffixes[some], suffixes[near[some]], limit))
    out = np.empty(len(starts), dtype=np.int64)
    out[np.searchsorted(starts, suffixes)] = longest
    return out


def _repeated_windows(places: np.ndarray, pieces: list[bytes]) -> np.ndarray:
    """Marks of the windows of segments whose longest previous factor is a whole window."""
    order = np.lexsort([places["start"], places["tie"], places["doc"]])
    same = np.logical_and.reduce([places[c][order[1:]] == places[c][order[:-1]] for c in ("doc", "tie", "start")])
    order = order[np.append(True, ~same)]  # a repeated row asks for the same place again
    places = places[order]
    data = np.frombuffer(b"".join(pieces[i] for i in order), dtype=np.uint8)
    sizes = places["size"].astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    windows = sizes - LENGTH + 1
    of = np.repeat(np.arange(len(places)), windows)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    hit = longest_previous_factors(data, begins[of] + inside) >= LENGTH
    marks = np.empty(int(hit.sum()), dtype=_MARK)
    marks["doc"], marks["tie"] = places["doc"][of[hit]], places["tie"][of[hit]]
    marks["start"], marks["size"] = places["start"][of[hit]] + inside[hit], LENGTH
    return _merged(marks)


def _mark_factors(rows: DataFrame, buckets: int) -> DataFrame:
    """Step 4: marks from the bytes and the window hashes of each bucket."""
    kind = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        spread = zstandard.ZstdDecompressor()
        for bucket, held in _by_bucket(batches):
            made = [(bucket, k, None, None, blob) for k, _, _, blob in held if k == MARK]
            places, pieces = [], []
            for k, _, _, blob in held:
                if k == BYTES:
                    raw = spread.decompress(blob)
                    own, at = _unpack(raw, _ASK)
                    stops = at + np.cumsum(own["size"].astype(np.int64))
                    places.append(own)
                    pieces += [raw[b - n : b] for b, n in zip(stops.tolist(), own["size"].tolist(), strict=True)]
            if places:
                marks = _repeated_windows(np.concatenate(places), pieces)
                made += _sent(marks, _bucket_of(marks["doc"], buckets), MARK)
            copies = _merged(_as_marks(_firsts(_all(held, WINDOW, _WINDOW), ["anchor", "name"])[1]))
            made += _sent(copies, _bucket_of(copies["doc"], buckets), MARK)
            if made:
                yield _batch(made, out)

    return in_arrow(_dealt(rows, buckets), run, kind)


def _cut(rows: DataFrame, buckets: int, whole: bool) -> DataFrame:
    """Step 5: texts without the marked bytes."""
    schema = SCHEMA + (", removed array<struct<start:long,end:long>>, kept binary" if whole else "")
    kind = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        made = []
        for doc, _, text, own in _documents(batches, {MARK: _MARK}):
            marks = _merged(own[MARK])
            spans = [(int(m["start"]), int(m["start"]) + int(m["size"])) for m in marks]
            rest = b"".join(text[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(text)], strict=True))
            more = ([{"start": a, "end": b} for a, b in spans], rest) if whole else ()
            made.append((doc, len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), *more))
            if len(made) >= 512:
                yield _batch(made, out)
                made = []
        if made:
            yield _batch(made, out)

    return in_arrow(_dealt(rows, buckets), run, kind)


def remove_repeats(docs: DataFrame, wide: int = WIDE, whole: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; ``whole`` adds the spans and the bytes kept.

    Texts are UTF-8 bytes, null counts as empty; matches never cross documents. Texts shorter than ``LENGTH`` lose
    nothing. Rows that repeat an id and text are one document and have the same result; of rows that share an id
    only, and of rows without an id (which come last), the one whose text has the smaller checksum is earlier. An
    empty table gives no rows; other columns are ignored.
    """
    source = texts(docs)
    buckets = _bucket_count(source)
    settled = written(_settle(_send_segments(source, buckets), buckets, wide), "repeat-segments")
    by_document = _texts_by_document(source, buckets)
    asked = settled.filter(F.col("kind").isin(ASK, ASK_WIDE)).unionByName(by_document)
    factors = written(_mark_factors(_send_bytes(asked, buckets), buckets), "repeat-factors")
    marks = settled.filter(F.col("kind") == MARK).unionByName(factors.filter(F.col("kind") == MARK))
    return _cut(marks.unionByName(by_document), buckets, whole)
