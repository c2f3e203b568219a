"""Benchmark decontamination with a broadcast hash set of test n-grams, in DataFrame operations only.

Every window of ``n`` consecutive words of a benchmark item becomes a gram (an item of fewer words is one gram),
kept once with the sorted list of the items that hold it. The grams go to all tasks as a hash set; every window of
a document looks its hash up there, and a hit counts only after its words have been compared one by one. Windows
are made, looked up and compared in one pass over the text, so only hits are ever shuffled, folded per document
beforehand. No gram can be hot: the lookup moves no document.

The set is broadcast by slices of at most ``SLICE_GRAMS`` grams and ``SLICE_BYTES`` bytes, counted before. A
benchmark beyond one slice takes a pass over the documents per slice, with the same result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import texts
from panelweave.session import written

WIDTH = 10
SLICE_GRAMS, SLICE_BYTES = 500_000, 64 << 20
#: Words and what stands between them, before A-Z are lower-cased.
WORD, BETWEEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text."""
    return F.array_remove(F.split(text, BETWEEN), "")  # splitting takes time in proportion, extracting all matches does not


def _lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def grams(benchmark: DataFrame, n: int = WIDTH) -> DataFrame:
    """The distinct windows of all items: hash, width, gram (its words, a space between) and the sorted ids of the items that hold it.

    Ids are taken as text; a missing id is the empty string, and rows that repeat an id are one item.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(_lowered(F.coalesce("text", F.lit("")))).alias("w"))
    items = items.filter(F.size("w") > 0)
    starts = items.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))).alias("start"))
    cut = starts.select("item_id", F.slice("w", F.col("start") + 1, n).alias("gram"))
    held = cut.groupBy("gram").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return held.select(F.xxhash64("gram").alias("hash"), F.size("gram").alias("width"), F.array_join("gram", " ").alias("gram"), "items")


def _windows(docs: DataFrame, widths: list[int]) -> DataFrame:
    """All windows of every document, with the words of the whole text beside them (by reference within the pass)."""
    rows = texts(docs).select(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.unhex(F.sha2("text", 256)).alias("sha"), words(_lowered(F.col("text"))).alias("w"))
    wide = rows.withColumn("width", F.lit(widths[0])) if len(widths) == 1 else rows.select("*", F.explode(F.array(*map(F.lit, widths))).alias("width"))
    starts = F.when(F.size("w") >= F.col("width"), F.sequence(F.lit(0), F.size("w") - F.col("width"))).otherwise(F.array().cast("array<int>"))
    placed = wide.select("*", F.explode(starts).alias("start"))
    return placed.withColumn("hash", F.xxhash64(F.slice("w", F.col("start") + 1, F.col("width"))))


def _hits(docs: DataFrame, found: DataFrame, widths: list[int]) -> DataFrame:
    """Per document with hits: id, sha of the text, the hit windows and the item lists of their grams."""
    met = _windows(docs, widths).join(F.broadcast(found.select("hash", "gram", "items")), "hash")  # a slice, so bounded
    said = F.array_join(F.slice("w", F.col("start") + 1, F.col("width")), " ")
    same = met.filter(F.startswith("gram", said) & F.startswith(said, "gram"))  # equal; as an equality it would become a key of the lookup
    return same.groupBy("id", "sha").agg(F.collect_set(F.struct("start", "width")).alias("hits"), F.collect_set("items").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WIDTH, slice_grams: int = SLICE_GRAMS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per document: doc_id, text_sha256, n_words, n_hit, spans (runs of hit words, from 0, end exclusive), items, contaminated.

    Null and empty texts have no words. Rows that repeat an id and a text get the same result each. An empty
    benchmark hits nothing; an empty table gives no rows; other columns are ignored. A text is held once by the task that
    scans it, with its words, however long it is; its hits are at most one row per word. A window of many items costs a list of
    their ids per document that holds it, since they are the result.
    """
    held = written(grams(benchmark, n), "grams")
    bytes_of = F.length("gram") + F.length(F.array_join("items", " ")) + 64
    count, size = held.agg(F.count("*"), F.coalesce(F.sum(bytes_of), F.lit(0))).first()
    widths = sorted(r[0] for r in held.select("width").distinct().collect())  # at most n rows
    slices = max(1, -(-count // slice_grams), -(-size // slice_bytes))
    base = texts(docs).select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    if count:
        parts = [_hits(docs, held.filter(F.pmod("hash", F.lit(slices)) == k), widths) for k in range(slices)]
        if slices > 1:  # one slice in memory at a time
            merged = reduce(DataFrame.unionByName, [written(p, "gram-hits") for p in parts])
            hits = merged.groupBy("id", "sha").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        else:
            hits = parts[0]
        covered = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h.start, h.start + h.width - 1)))))
        hits = hits.select("id", F.lower(F.hex("sha")).alias("sha"), covered.alias("covered"), F.sort_array(F.array_distinct(F.flatten("items"))).alias("found"))
        step = lambda i, by: F.get("covered", i + by)
        first = F.filter("covered", lambda x, i: F.coalesce(step(i, -1) != x - 1, F.lit(True)))
        last = F.filter("covered", lambda x, i: F.coalesce(step(i, 1) != x + 1, F.lit(True)))
        runs = F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))
        hits = hits.select("id", "sha", F.size("covered").cast("long").alias("n_hit"), runs.alias("spans"), "found")
        joined = base.join(hits, (F.coalesce(base["doc_id"], F.lit(-1)) == hits["id"]) & (base["text_sha256"] == hits["sha"]), "left")
    else:
        joined = base.select("*", F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"), none.alias("found"))
    return joined.select(
        "doc_id", "text_sha256", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"), F.coalesce("found", none).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _without(text: Column, spans: Column) -> Column:
    """The text less the words of the spans and what stands between them."""
    said, between = words(text), F.split(text, WORD, -1)
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s.end))
    ends = F.concat(F.transform(spans, lambda s: s.start), F.array(F.size(said)))

    def piece(a: Column, b: Column) -> Column:
        inner = F.zip_with(F.slice(between, a + 1, b - a), F.slice(said, a + 1, b - a), lambda x, y: F.concat(x, y))
        return F.concat(F.array_join(inner, ""), F.get(between, b))

    return F.array_join(F.zip_with(starts, ends, piece), "")


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = WIDTH, remove: str = "spans", share: float = 0.0) -> DataFrame:
    """The documents without what they share with the benchmark, with all their columns.

    ``remove="spans"`` cuts the hit words, and what stands between them, out of every text; ``remove="documents"`` drops each
    document with more than ``share`` of its words hit. Texts that are not hit, nulls included, stay as they are;
    rows that repeat an id and a text are treated alike.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    found = contamination(docs, benchmark, n).filter(F.col("contaminated") & (F.col("n_hit") > F.lit(share) * F.col("n_words")))
    found = found.select(F.coalesce("doc_id", F.lit(-1)).alias("_hit_id"), F.col("text_sha256").alias("_hit_sha"), F.col("spans").alias("_hit_spans"))
    found = found.dropDuplicates(["_hit_id", "_hit_sha"])
    match = (F.coalesce(docs["doc_id"].cast("long"), F.lit(-1)) == found["_hit_id"]) & (F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == found["_hit_sha"])
    if remove == "documents":
        return docs.join(found, match, "left_anti")
    joined = docs.join(found, match, "left")
    clean = F.when(F.col("_hit_spans").isNull(), docs["text"]).otherwise(_without(docs["text"], F.col("_hit_spans")))
    return joined.select(*[clean.alias("text") if c == "text" else docs[c] for c in docs.columns])


def digests(docs: DataFrame, benchmark: DataFrame, **how: int) -> DataFrame:
    """The rows of :func:`contamination` with the number and the hash of the items in place of their list."""
    found = contamination(docs, benchmark, **how)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )
