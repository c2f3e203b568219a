"""Temperature mixing of sources, realised as budgeted block permutations.

With p the token shares of the sources, the mix has weights proportional to p**a. The exponent a in [0, 1]
is found by bisection (several sections at a time, one small job each) over the table of source totals: the
smallest a whose mix keeps every source within ``repetition`` passes, or the one that meets a target entropy.
The budget is the least that passes over every source at least once, unless one is given.

A source of r passes is cut into blocks of about ``BLOCK_TOKENS`` tokens by a hash of the document id, so its blocks in
their order are a permutation of it, and a source of any size spreads over all tasks. Every block is shown floor(r) times whole, each
time in another permutation. The tokens that remain are spent on the source's blocks in order: the place of a
block among them is a running total by groups of ``GROUP_BLOCKS`` blocks, so what a block leaves goes to the next, and the source
misses its budget by half of one document at most, however long its documents are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.session import written

BLOCK_TOKENS, GROUP_BLOCKS = 1 << 16, 4096
REPETITION = 2.0
_SECTIONS, _ROUNDS = 32, 5
_SALTS = 64
WORD = r"[^\x20\x09-\x0D]+"


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source and number of words (runs without white space) of every document; null text has none."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
    )


def source_totals(rows: DataFrame) -> DataFrame:
    """source, docs, tokens and the source's share of all tokens (sources without a token have none). Runs a job."""
    totals = rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    whole = totals.agg(F.sum("tokens")).first()[0] or 1
    return totals.withColumn("share", F.col("tokens") / F.lit(float(whole)))


def _measured(totals: DataFrame, exponents: list[float], budget: float | None) -> dict[float, tuple[float, float]]:
    """Entropy of the mix and its most passes over a source, by exponent."""
    grid = F.explode(F.array(*[F.lit(a) for a in exponents])).alias("a")
    tempered = totals.filter("tokens > 0").select("share", grid)
    power, passes = F.pow("share", F.col("a")), F.pow("share", F.col("a") - 1)
    found = tempered.groupBy("a").agg(
        F.sum(power).alias("z"), F.sum(power * F.log(power)).alias("plogp"), F.max(passes).alias("most"), F.min(passes).alias("least")
    )
    whole = totals.agg(F.sum("tokens")).first()[0] or 1
    out = {}
    for r in found.collect():  # one row per exponent of the grid
        entropy = math.log(r["z"]) - r["plogp"] / r["z"]
        out[r["a"]] = (entropy, r["most"] / r["least"] if budget is None else budget / whole * r["most"] / r["z"])
    return out


def exponent(totals: DataFrame, *, repetition: float | None = REPETITION, entropy: float | None = None, budget: float | None = None) -> float:
    """The exponent in [0, 1] that meets the target; entropy falls and passes shrink as it grows.

    With ``entropy`` (in nats) the largest exponent whose mix still has it, else the smallest whose mix passes over no
    source more than ``repetition`` times. Out of reach, the nearer end is returned.
    """
    low, high = 0.0, 1.0
    for _ in range(_ROUNDS):
        grid = [low + (high - low) * k / _SECTIONS for k in range(_SECTIONS + 1)]
        seen = _measured(totals, grid, budget)
        if not seen:
            return 1.0
        if entropy is not None:
            good = [a for a in grid if seen[a][0] >= entropy]
            low = max(good, default=0.0)
            high = min([a for a in grid if a > low], default=low)
        else:
            good = [a for a in grid if seen[a][1] <= repetition]
            high = min(good, default=1.0)
            low = max([a for a in grid if a < high], default=high)
        if low >= high:
            break
    return low if entropy is not None else high


def weights(totals: DataFrame, a: float, budget: float | None = None) -> DataFrame:
    """source, docs, tokens, share, weight and passes of the mix with exponent ``a``."""
    power = F.when(F.col("tokens") > 0, F.pow("share", F.lit(a))).otherwise(0.0)
    tempered = totals.withColumn("_power", power).withColumn("_raw", F.when(F.col("tokens") > 0, F.col("_power") / F.col("share")))
    z, least, whole = tempered.agg(F.sum("_power"), F.min("_raw"), F.sum("tokens")).first()
    unit = (least or 1.0) if budget is None else (whole or 1) * (z or 1.0) / float(budget)
    passes = F.coalesce(F.col("_raw") / F.lit(unit), F.lit(1.0))  # divided, so that the least is one pass exactly
    near = F.when(F.abs(passes - F.round(passes)) < 1e-6, F.round(passes)).otherwise(passes)  # bisection ends just beside a whole limit
    return tempered.select(*totals.columns, (F.col("_power") / F.lit(z or 1.0)).alias("weight"), near.alias("passes"))


def _before_blocks(placed: DataFrame) -> DataFrame:
    """source, block and the tokens of the source's earlier blocks.

    Totals run over groups of blocks first, then inside each group; a source has a group for some 2**28 tokens, a group 4096 blocks.
    """
    blocks = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("_tokens")).withColumn("_group", F.floor(F.col("block") / GROUP_BLOCKS))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    groups = blocks.groupBy("source", "_group").agg(F.sum("_tokens").alias("_tokens"))
    running = F.coalesce(F.sum("_tokens").over(earlier.partitionBy("source").orderBy("_group")), F.lit(0))
    inside = F.coalesce(F.sum("_tokens").over(earlier.partitionBy("source", "_group").orderBy("block")), F.lit(0))
    groups = groups.select("source", "_group", running.alias("_ahead"))
    return blocks.withColumn("_inside", inside).join(groups, ["source", "_group"]).select("source", "block", (F.col("_ahead") + F.col("_inside")).alias("_ahead"))


def mix(docs: DataFrame, *, repetition: float | None = REPETITION, entropy: float | None = None, budget: float | None = None,
        block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per shown copy of a document: doc_id, source, n_tokens, weight, passes, epoch, block, position.

    ``position`` is the place in the block's permutation of that epoch, from 0. A null source is the source
    named by the empty string. Documents without a token, null texts among them, are shown in every whole pass. Rows that repeat an id
    are shown each. With the default budget every document is shown at least once, and a source's part of a pass ends with the
    document that brings it nearest to its budget. A budget that is given is not exceeded; a small one shows only the first of the
    source's blocks. Ties go by document id. A text's length does not matter: only its tokens are counted. An empty table
    gives no rows; other columns are ignored.
    """
    rows = written(token_counts(docs), "mix-counts")
    totals = written(source_totals(rows), "mix-totals")
    a = exponent(totals, repetition=repetition, entropy=entropy, budget=budget)
    blocks = F.greatest(F.lit(1), F.ceil((F.col("tokens") + F.col("docs")) / block_tokens)).alias("blocks")
    sources = weights(totals, a, budget).select("source", "tokens", "weight", "passes", blocks)
    sources = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    key = F.xxhash64(F.coalesce("doc_id", F.lit(-1)))
    salted = rows.withColumn("_salt", F.pmod(key, F.lit(_SALTS)).cast("int"))
    placed = salted.join(sources, ["source", "_salt"]).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit("block")), F.col("blocks")))
    placed = placed.withColumn("_order", F.xxhash64("doc_id", F.lit("pass")))
    placed = placed.join(_before_blocks(placed), ["source", "block"])
    so_far = Window.partitionBy("source", "block").orderBy("_order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = (F.col("passes") - F.floor("passes")) * F.col("tokens") - F.col("_ahead") - F.sum("n_tokens").over(so_far)
    more = (left >= (-F.col("n_tokens") / 2 if budget is None else F.lit(0))) & (F.col("passes") > F.floor("passes")) & (F.col("n_tokens") > 0)
    copies = F.floor("passes") + F.when(more, 1).otherwise(0)
    shown = placed.withColumn("copies", copies.cast("int")).filter("copies > 0")
    shown = shown.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    permuted = Window.partitionBy("source", "block", "epoch").orderBy(F.xxhash64("doc_id", "epoch"), "doc_id", "n_tokens")
    return shown.select(
        "doc_id", "source", "n_tokens", "weight", "passes", "epoch", F.col("block").cast("long").alias("block"),
        (F.row_number().over(permuted) - 1).cast("long").alias("position"),
    )


def mixed_documents(docs: DataFrame, **how: float) -> DataFrame:
    """The documents of the mix with all their columns, a row per shown copy.

    Documents without a token, null texts among them, are shown in every whole pass; rows that repeat an id are each shown as often as the one
    shown most. An empty table gives no rows. Columns of any name are kept, but for ones that begin with ``_mix_``.
    """
    copies = mix(docs, **how).groupBy(F.coalesce("doc_id", F.lit(-1)).alias("_mix_id")).agg((F.max("epoch") + 1).alias("_mix_copies"))
    joined = docs.join(copies, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)) == F.col("_mix_id"))
    return joined.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), "_mix_copies"))).select(*docs.columns)
