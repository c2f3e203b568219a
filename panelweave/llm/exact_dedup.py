"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only.

Every document becomes a digest row. The rows are cut into ``RUNS`` runs by a hash of the document id, so
that copies of one text, however many, are spread evenly. Within a run equal digests fold into one row
(smallest id, number of rows). Then come binomial rounds: in each, ``2**ROUND_BITS`` neighbouring runs
exchange their rows, sliced by digest over all tasks. Every task sorts and folds its part of a run before it sends it; what
arrives is merged in digest order, and a pass over that order keeps the smallest identifier per digest (sort
aggregates on both sides, which need that order). A digest has at most ``2**ROUND_BITS`` rows in any merge, so no group is ever large, and no
task holds a whole run. A merge takes two rows for the same text only when the digest, the length and a
second, independent hash agree; that is the verification at each level.

The answer travels back down the same way: the merged classes meet the rows of the first level (at most
``RUNS`` per digest), and those meet the documents on (run, digest).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import SPACE, texts
from panelweave.session import written

RUNS = 256
ROUND_BITS = 4
_TEXT = ("digest", "length", "witness")


def digest_runs(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """One row per document: id, run, digest, length and witness of the text with white space folded."""
    folded = texts(docs).withColumn("text", F.regexp_replace("text", SPACE, " "))
    return folded.select(
        "doc_id",
        F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(runs)).cast("int").alias("run"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.length("text").alias("length"),
        F.xxhash64("text").alias("witness"),
    )


def _merge(runs: DataFrame) -> DataFrame:
    """Merge the rows of each run in digest order and fold those of one text.

    A minimum over a struct cannot be kept in a hash table, so rows are folded in sorted order, before and after the exchange.
    """
    first = F.min(F.when(F.col("keep_id").isNotNull(), F.struct("keep_id")))
    merged = runs.groupBy("run", *_TEXT).agg(first.alias("first"), F.sum("group_size").alias("group_size"))
    return merged.select("run", *_TEXT, F.col("first.keep_id").alias("keep_id"), "group_size")


def exact_duplicates(docs: DataFrame, runs: int = RUNS, round_bits: int = ROUND_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after folding white space. The smallest doc_id of a class stays; of rows
    that repeat a doc_id and text all are kept = (doc_id = keep_id), so an id that occurs twice stays twice
    here (``keep_first`` keeps one row). Null texts count as empty and form one class with empty ones. A row
    without an id never stays unless its class has no id at all; it is then returned with keep_id null and
    kept true. An empty table gives no rows; other columns are ignored. A text of any length is hashed whole where it is read and
    never shuffled.
    """
    rows = written(digest_runs(docs, runs), "digests")
    first = _merge(rows.withColumnRenamed("doc_id", "keep_id").withColumn("group_size", F.lit(1).cast("long")))
    leaves = written(first, "runs")
    level, left = leaves, runs
    while left > 1:
        level = _merge(level.withColumn("run", F.shiftright("run", round_bits)))
        left = (left + (1 << round_bits) - 1) >> round_bits
    classes = level.drop("run")
    down = leaves.select("run", *_TEXT).join(classes, list(_TEXT))
    out = rows.join(down, ["run", *_TEXT])
    kept = F.when(F.col("keep_id").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; of rows with the same id and text one stays.

    Null texts count as empty and keep their null; a row without an id stays only in a class without one. An empty table gives no
    rows. Columns of any name are kept, but for ones that begin with ``_dedup_``. A text of any length is hashed whole.
    """
    folded = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " ")
    keys = {"_dedup_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_dedup_sha": F.sha2(folded, 256)}
    found = exact_duplicates(docs).filter("kept")
    found = found.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_dedup_id"), F.col("text_sha256").alias("_dedup_sha"))
    joined = docs.withColumns(keys).join(found.distinct(), list(keys), "left_semi")
    return joined.dropDuplicates(list(keys)).select(*docs.columns)
