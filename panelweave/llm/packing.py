"""Packing documents into token sequences by balanced attention cost.

Texts are tokenised in the tasks that read them, and each task packs what it reads, in groups of at most
``GROUP_DOCS`` documents, so nothing is shuffled and no group grows with the data. A group of ``t`` tokens
gets ``ceil(t / capacity)`` sequences, hence less than one sequence of padding. Documents are taken in
descending order of length. Parts of a whole capacity fill a sequence of their own; the rest of a document
of ``n`` tokens costs ``LINEAR * n + QUADRATIC * n**2`` and goes to the sequence of lowest cost that has
room for all of it. If none has, it is cut: the sequence of lowest cost with any room takes what it holds,
and the remainder looks again.

Tokenising works on distinct words. This vocabulary never joins characters across white space, so a text's
ids are those of its words in order, and a batch encodes only words that the process has not met yet.
"""

from __future__ import annotations

import heapq
import unicodedata
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from panelweave.llm.common import in_arrow, process_cache, texts

CAPACITY = 4096
END_ID = 2
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY
GROUP_DOCS = 1024
_SLICE_BYTES = 4 << 20
_JOINED = 256  # words encoded as one string
_KNOWN = 1 << 19  # words a process remembers
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokenizer:
    """Ids of whole texts from a vocabulary with word ends, by distinct words."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self._forget()
        # Fixed value: the vocabulary's own division of a word.
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def _n_parts(self, words: pa.Array) -> np.ndarray:
        """Parts of each word in the vocabulary's own division."""
        parts = np.ones(len(words), dtype=np.int64)
        other = np.flatnonzero(~pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False))
        for i, w in zip(other.tolist(), words.take(pa.array(other)).to_pylist(), strict=True):
            if w[-1:] in ".,:;|" and w[:-1].isalpha():
                parts[i] = 2
            else:
                parts[i] = sum(1 for _ in self.parts.finditer(unicodedata.normalize("NFC", w).lower()))
        return parts

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the number of ids of each.

        Words are encoded many at a time; the ids that end a part tell the words apart again. Words that could
        hold a special token, and strings whose parts do not add up, are encoded one by one.
        """
        texts, parts = words.to_pylist(), self._n_parts(words)
        apart = pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
        low = range(0, len(texts), _JOINED)
        coded = self.tokenizer.encode_batch_fast([" ".join(texts[i : i + _JOINED]) for i in low], add_special_tokens=False)
        ids, counts = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)]
        for i, code in zip(low, coded, strict=True):
            own = slice(i, i + _JOINED)
            got = np.asarray(code.ids, dtype=np.uint32)
            last = np.flatnonzero(self.ends[got])
            if len(last) != parts[own].sum() or apart[own].any():
                single = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in texts[own]]
                ids.append(np.asarray([i for one in single for i in one], dtype=np.uint32))
                counts.append(np.asarray([len(one) for one in single], dtype=np.int64))
                continue
            stops = np.concatenate([[0], last + 1])[np.cumsum(parts[own])]
            ids.append(got)
            counts.append(np.diff(stops, prepend=0))
        return np.concatenate(ids), np.concatenate(counts)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An array of ids with the first id and the number of ids of each of some distinct words.

        Words of earlier calls are remembered, about ``_KNOWN`` of them at most; then the memory starts anew.
        """
        if len(self.known) > _KNOWN:
            self._forget()
        at = pc.index_in(words, value_set=self.known)
        unknown = pc.is_null(at)
        new = words.filter(unknown)
        place = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[unknown.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(new))
        if len(new):
            ids, counts = self._encoded(new)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.ids = np.concatenate([self.ids, ids])
            self.known = pa.concat_arrays([self.known, new])
        return self.ids, self.starts[place], self.counts[place]

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids = np.zeros(0, dtype=np.uint32)
        self.starts = self.counts = np.zeros(0, dtype=np.int64)

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each text."""
        split = pc.ascii_split_whitespace(column)
        coded = split.flatten().dictionary_encode()
        ids, starts, counts = self.words(coded.dictionary)
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = counts[index]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        flat = ids[np.repeat(starts[index] - (ends - lengths), lengths) + np.arange(total)]
        offsets = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        before = np.concatenate([[0], ends])
        return flat, np.diff(before[offsets])


def tokenizer_of(path: str) -> WordTokenizer:
    """The process's tokenizer; tasks that follow each other in a process share it."""
    kept = process_cache()
    if kept.get("tokenizer_path") != path:
        kept.update(tokenizer=WordTokenizer(path), tokenizer_path=path)
    return kept["tokenizer"]


def pack(lengths: Sequence[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents given by their lengths.

    Equal lengths keep their order; documents without tokens have no piece. Sequences count from zero.
    """
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    pieces, whole = [], 0
    rests = []
    for i in order:
        full = lengths[i] // capacity
        pieces += [(i, k * capacity, capacity, whole + k, 0) for k in range(full)]
        whole += full
        if lengths[i] % capacity:
            rests.append((lengths[i] % capacity, i, full * capacity))
    n = -(-sum(r for r, _, _ in rests) // capacity)
    used = [0] * n
    heap = [(0.0, k) for k in range(n)]
    for rest, i, start in sorted(rests, key=lambda r: -r[0]):
        while rest:
            passed, found = [], None
            while heap:
                at = heapq.heappop(heap)
                if used[at[1]] + rest <= capacity:
                    found = at
                    break
                passed.append(at)
            if found is None:
                found = passed.pop(0)  # the lowest cost with any room
            for at in passed:
                heapq.heappush(heap, at)
            cost, k = found
            taken = min(rest, capacity - used[k])
            pieces.append((i, start, taken, whole + k, used[k]))
            used[k] += taken
            start, rest = start + taken, rest - taken
            if used[k] < capacity:
                heapq.heappush(heap, (cost + LINEAR * taken + QUADRATIC * taken * taken, k))
    return pieces


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about ``_SLICE_BYTES`` of text and at most ``GROUP_DOCS`` * 8 rows."""
    sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (held + size > _SLICE_BYTES or i - start >= GROUP_DOCS * 8):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``, so null and empty texts are one token long. Every id lies in exactly
    one piece; offsets in a sequence have no gaps. Repeated rows are packed each on its own. Sequence ids are
    unique (task, number within the task) and the same when a task runs again. An empty table gives no rows;
    other columns are ignored. A text of any length is tokenised whole.
    """
    spark = docs.sparkSession
    kind = spark.createDataFrame([], SCHEMA).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(tokenizer_path)
        out = to_arrow_schema(kind)
        sequence = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in _slices(batch):
                ids, counts = tokenizer.texts(part.column("text"))
                starts = np.cumsum(counts) - counts
                doc_ids = part.column("doc_id").to_pylist()
                for low in range(0, part.num_rows, GROUP_DOCS):
                    group = range(low, min(low + GROUP_DOCS, part.num_rows))
                    pieces = pack([int(counts[i]) + 1 for i in group], capacity)
                    rows, top = [], 0
                    for i, start, length, k, offset in pieces:
                        n = int(counts[low + i])
                        own = ids[starts[low + i] + start : starts[low + i] + min(start + length, n)]
                        crc = zlib.crc32(own.astype("<u4").tobytes())
                        if start + length > n:
                            crc = zlib.crc32(np.asarray([end_id], dtype="<u4").tobytes(), crc)
                        rows.append((doc_ids[low + i], start, length, crc, n + 1, sequence + k, offset))
                        top = max(top, k + 1)
                    sequence += top
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return in_arrow(texts(docs), run, kind)
