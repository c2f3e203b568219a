"""Collocations of two or three words by Toivonen mining: a sample proposes, full passes count and check.

Phrases are contiguous words, so a frequent phrase has frequent parts. A hashed sample of the documents proposes the
phrases that reach a lowered threshold there. A pass over all documents then counts exactly the proposed
phrases and their negative border: every word, every pair whose two words are proposed, every triple
whose two pairs are. If a phrase of the border turns out frequent, the proposal was too small: what is now known to be
frequent becomes the next proposal, and another pass counts the part of its border that no earlier pass counted.
It ends when every frequent word and pair lies inside the last proposal; then nothing frequent is uncounted. Since
words are all counted by the first pass, that takes three passes at most. The sample decides only what is counted when,
never a result.

A proposal travels to the tasks as a Bloom filter of 16 bits a phrase, of ``MOST_BITS`` at most, built in Spark. A false positive
merely has a phrase counted that need not be. Beyond that size the filter passes more and prunes less, with the same result.

Inside a task, blocks of text are cut into words and counted with arrays; what leaves it is one row per distinct
phrase of a block, summed again after the shuffle. The key is the language and the whole phrase, so neither a frequent word
nor a frequent language gathers rows. Lookups of the parts' counts split keys with many rows, and the best of a
language are taken per salt first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.llm.common import in_arrow, partitions
from panelweave.operators.skew import hot_split_join
from panelweave.session import written

LEAST, TOP = 10, 2000
SAMPLE_OF, LOWERED = 4, 0.8  # a quarter of the documents proposes, at 0.8 of the count to expect there
MOST_BITS, BITS_A_PHRASE = 27, 16  # bits of a filter: two to the power of 27 at most
BLOCK_BYTES = 8 << 20
_COUNTS = "key string, c long"  # language, tab, phrase; no word holds a tab
#: Bytes of words are 0, those between words 1, those between pieces 2.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

Filter = tuple[int, bytes]  # the number of its bits as a power of two, and the bits


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StringArray, pa.StringArray]]:
    """Languages and texts of some ``BLOCK_BYTES``, whole rows."""
    langs, texts, size = [], [], 0
    for batch in batches:
        lang, text = (c.cast(pa.string()) for c in batch.columns)
        at = 0
        total = np.cumsum(np.asarray(pc.binary_length(text), dtype=np.int64))
        while at < len(text):
            gone = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, gone + BLOCK_BYTES - size, "right")))
            langs.append(lang[at:end])
            texts.append(text[at:end])
            size += int(total[end - 1] - gone)
            at = end
            if size >= BLOCK_BYTES:
                yield pa.concat_arrays(langs), pa.concat_arrays(texts)
                langs, texts, size = [], [], 0
    if texts:
        yield pa.concat_arrays(langs), pa.concat_arrays(texts)


def _words(text: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """All words of the texts, the row of each, and whether the next word follows in the same piece."""
    offsets = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, 4 * text.offset)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = _KIND[data]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    rows = offsets[:-1][offsets[:-1] < len(data)]
    first[rows] = inside[rows]
    starts = np.flatnonzero(first)
    lengths = np.diff(np.cumsum(inside, dtype=np.int32)[starts], append=np.int32(inside.sum() + 1)) if len(starts) else np.empty(0, np.int32)
    begin = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(begin.tobytes()), pa.py_buffer(_LOWER[data[inside]].tobytes()))
    row = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    follows = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
    return words, row, follows


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two, in this order."""
    h = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29)))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _string_hashes(strings: pa.StringArray) -> np.ndarray:
    return pd.util.hash_array(strings.to_numpy(zero_copy_only=False), categorize=False).astype(np.uint64)


def _places(hashes: np.ndarray, power: int) -> list[np.ndarray]:
    """The two bits of a filter that stand for each hash."""
    shift = np.uint64(64 - power)
    return [(hashes >> shift).astype(np.int64), ((hashes * np.uint64(0xBF58476D1CE4E5B9)) >> shift).astype(np.int64)]


def _passes(hashes: np.ndarray, kept: Filter) -> np.ndarray:
    power, bits = kept
    bits = np.frombuffer(bits, np.uint8)
    ok = np.ones(len(hashes), bool)
    for place in _places(hashes, power):
        ok &= (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    return ok


def _phrase_hashes(lang: pa.StringArray, phrase: pa.StringArray) -> np.ndarray:
    """The hashes by which tasks look up words and pairs."""
    parts = pc.split_pattern(phrase, " ")
    size = np.asarray(pc.list_value_length(parts))
    told = _string_hashes(lang)
    one = _mixed(told, _string_hashes(pc.list_element(parts, 0)))
    pair = np.flatnonzero(size == 2)
    if len(pair):
        second = _mixed(told[pair], _string_hashes(pc.list_element(parts.take(pa.array(pair)), 1)))
        one[pair] = _mixed(one[pair], second)
    return one


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted so that neighbours share their first words and compress well, and how often each occurs."""
    return np.unique(codes, return_counts=True)


def count_block(lang: pa.StringArray, text: pa.StringArray, proposals: list[tuple[Filter, Filter]]) -> Iterator[tuple[pa.Array, pa.Array, int, np.ndarray]]:
    """Languages, phrases, words a phrase and counts of what the last proposal admits and no earlier one did.

    Without a proposal all words and pairs are counted. Words are counted for the first proposal only; with them
    come the number of words by language, as the empty phrase.
    """
    words, row, follows = _words(text)
    if not len(words):
        return
    told, said = lang.dictionary_encode(), words.dictionary_encode()
    langs, vocabulary = told.dictionary, said.dictionary
    key = np.asarray(told.indices).astype(np.int64)[row] * len(vocabulary) + np.asarray(said.indices)
    code, types = pd.factorize(key)
    code = code.astype(np.int64)
    lang_of, word_of = np.divmod(types, len(vocabulary))
    count = len(types)

    def named(*parts: np.ndarray) -> tuple[pa.Array, pa.Array]:
        pieces = [vocabulary.take(pa.array(word_of[p])) for p in parts]
        return langs.take(pa.array(lang_of[parts[0]])), pc.binary_join_element_wise(*pieces, " ") if len(pieces) > 1 else pieces[0]

    if len(proposals) < 2:
        often = np.bincount(code, minlength=count)
        yield *named(np.arange(count)), 1, often
        spoken = np.bincount(lang_of, often, len(langs)).astype(np.int64)
        yield langs, pa.array([""] * len(langs)), 0, spoken
    left, right = code[:-1], code[1:]
    pair = follows.copy()
    triple = np.zeros(max(len(code) - 2, 0), bool)
    if proposals:
        hashes = _mixed(_string_hashes(langs)[lang_of], _string_hashes(vocabulary)[word_of])
        pair_hashes = _mixed(hashes[left], hashes[right])
        triple = follows[1:] & follows[:-1]
        for kept_words, kept_pairs in proposals[:-1]:
            known = _passes(hashes, kept_words)
            pair &= ~(known[left] & known[right])
            known = _passes(pair_hashes, kept_pairs)
            triple &= ~(known[1:] & known[:-1])
        known = _passes(hashes, proposals[-1][0])
        pair &= known[left] & known[right]
        known = _passes(pair_hashes, proposals[-1][1])
        triple &= known[1:] & known[:-1]
    found, often = _counted(left[pair] * count + right[pair])
    if len(found):
        yield *named(*np.divmod(found, count)), 2, often
    at = np.flatnonzero(triple)
    start, pairs = pd.factorize(left[at] * count + right[at])
    found, often = _counted(start.astype(np.int64) * count + code[at + 2])
    if len(found):
        start, third = np.divmod(found, count)
        yield *named(*np.divmod(pairs[start], count), third), 3, often


def _tally(rows: DataFrame, proposals: list[tuple[Filter, Filter]]) -> DataFrame:
    """lang, phrase, k and c over all rows, for the phrases a pass counts."""
    sc = rows.sparkSession.sparkContext
    sent = sc.broadcast(proposals)  # filters of bounded size, as plain bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in _blocks(batches):
            for langs, phrases, _, often in count_block(lang, text, sent.value):
                for at in range(0, len(often), 100_000):
                    part = pa.array(often[at : at + 100_000].astype(np.int64))
                    keys = pc.binary_join_element_wise(langs[at : at + len(part)], phrases[at : at + len(part)], "\t")
                    yield pa.RecordBatch.from_arrays([keys.cast(pa.string()), part], ["key", "c"])

    # blocks are summed in themselves; hashing every phrase once more before the shuffle would cost more than it saves
    summed = in_arrow(rows, run, _COUNTS).repartition("key").groupBy("key").agg(F.sum("c").alias("c"))
    phrase = F.substring_index("key", "\t", -1)
    k = F.when(phrase == "", F.lit(0)).otherwise(F.size(F.split(phrase, " ")))
    return summed.select(F.substring("key", F.lit(1), F.length("key") - F.length(phrase) - 1).alias("lang"), phrase.alias("phrase"), k.alias("k"), "c")


def _filters(known: DataFrame) -> tuple[Filter, Filter]:
    """Filters of the words and of the pairs in a written table of phrases. What reaches the driver is their bits."""
    sizes = {r["k"]: r["count"] for r in known.filter("k in (1, 2)").groupBy("k").count().collect()}
    power = {k: min(MOST_BITS, max(15, int(BITS_A_PHRASE * sizes.get(k, 0)).bit_length())) for k in (1, 2)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, k = _phrase_hashes(batch.column(0).cast(pa.string()), batch.column(1).cast(pa.string())), np.asarray(batch.column(2))
            for level in (1, 2):
                for place in _places(hashes[k == level], power[level]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), level, np.int32)), pa.array(place + 1)], ["k", "place"])

    places = in_arrow(known.filter("k in (1, 2)").select("lang", "phrase", "k"), run, "k int, place long")
    dealt = places.withColumn("bucket", F.bitmap_bucket_number("place")).repartition("k", "bucket")
    maps = dealt.groupBy("k", "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = {k: bytearray(1 << (power[k] - 3)) for k in (1, 2)}
    for r in maps.collect():  # 4 kB for 32,768 bits
        out[r["k"]][(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = r["bits"]
    return (power[1], bytes(out[1])), (power[2], bytes(out[2]))


def _outside(known: DataFrame, proposal: tuple[Filter, Filter]) -> int:
    """How many words and pairs of a table lie outside of a proposal."""
    sent = known.sparkSession.sparkContext.broadcast(proposal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, k = _phrase_hashes(batch.column(0).cast(pa.string()), batch.column(1).cast(pa.string())), np.asarray(batch.column(2))
            missing = sum(int((~_passes(hashes[k == level], sent.value[level - 1])).sum()) for level in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array([missing], pa.int64())], ["n"])

    found = in_arrow(known.filter("k in (1, 2)").select("lang", "phrase", "k"), run, "n long")
    return found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def frequent_phrases(docs: DataFrame, least: int = LEAST, sample_of: int = SAMPLE_OF) -> DataFrame:
    """lang, phrase, k (its words) and c (its occurrences), for all phrases of one to three words with c >= ``least``.

    Besides, the empty phrase with k = 0 counts all words of a language.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("phrases"))
    lowered = max(1, int(LOWERED * least / sample_of))
    sample = rows.filter(F.pmod(key, F.lit(sample_of)) == 0)
    proposed = written(_tally(sample, []).filter((F.col("k") > 0) & (F.col("c") >= lowered)), "phrase-sample")
    proposals, known = [_filters(proposed)], None
    while True:
        found = written(_tally(rows, proposals).filter((F.col("k") == 0) | (F.col("c") >= least)), "phrase-counts")
        known = found if known is None else known.unionByName(found)
        if not _outside(known, proposals[-1]):
            return known
        proposals.append(_filters(known))


def _looked_up(cuts: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """The cuts with the count of one of their parts."""
    needed = cuts.groupBy("lang", part).agg(F.count("*").alias("_rows"))
    side = needed.join(counts.select("lang", F.col("phrase").alias(part), F.col("c").alias(name)), ["lang", part])
    return hot_split_join(cuts, side, ["lang", part], count="_rows").drop("_rows")


def scored(counts: DataFrame, share: int = 50, scale: int = 1_000_000) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases that no longer one explains, from the table of frequent phrases."""
    several = counts.filter("k >= 2").select("lang", "phrase", F.col("c").alias("a"), F.split("phrase", " ").alias("w"))

    def joined(start: Column | int, size: Column | int) -> Column:
        return F.array_join(F.slice("w", start, size), " ")

    cuts = several.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", joined(1, F.col("cut")).alias("before"), joined(F.col("cut") + 1, F.size("w") - F.col("cut")).alias("after"))
    cuts = _looked_up(_looked_up(cuts, counts, "before", "l"), counts, "after", "r")
    whole = {c: F.col(c).cast("decimal(18,0)") for c in "alr"}
    score = F.call_function("div", whole["a"] * whole["a"] * F.lit(scale).cast("decimal(18,0)"), whole["l"] * whole["r"])
    cuts = cuts.withColumn("score", score)
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    inner = several.filter(F.size("w") == 3).select("lang", F.explode(F.array(joined(1, 2), joined(2, 2))).alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    return kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = 50, sample_of: int = SAMPLE_OF) -> DataFrame:
    """The ``top`` phrases of every language by score: lang, rank, phrase, a, l, r, n, score.

    Null texts have no words; a null language is ``und``; rows that repeat an id and a text all count. Ties go by count, then by the
    bytes of the phrase. A language without a frequent phrase has no rows, and neither has an empty table; other columns are
    ignored. A text is held once as bytes and once as numbers, however long it is.
    """
    counts = written(frequent_phrases(docs, least, sample_of), "frequent-phrases")
    rows = scored(counts, share)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession))))
    first = salted.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    spoken = counts.filter("k = 0").groupBy("lang").agg(F.sum("c").alias("n"))
    return ranked.join(spoken, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
