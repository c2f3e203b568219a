"""Near duplicates on word shingles by SetSketch registers, confirmed on full sets.

A document's set holds the hashes of its distinct runs of ``width`` words. Its sketch has ``REGISTERS``
registers: the smallest of exponentially distributed hashes of the elements, truncated to a scale of powers
of ``SCALE``. Equal registers are about as likely as the sets are alike, so runs of ``ROWS`` registers are
band keys; documents that share one meet in a bucket. Documents with identical sets count once throughout.

Buckets are not expanded into pairs. Each has a hub, the member whose buckets are largest (an original
among its copies), and all members of a hub's buckets form its star:

1. A pair alone in its star is first estimated from the registers, jointly by likelihood, and dropped when
   the estimate is far below the threshold.
2. All other members are compared with their hub on full sets. What is kept of a member is its set relative
   to the hub: one bit per element of the hub's set, and the elements outside it.
3. Members that are not linked to the hub may still be linked to each other or to linked members. They meet
   all members of the star in blocks of bounded size; the bits and the counts outside bound the likeness, and
   pairs that pass are counted exactly. Only links leave a block.
4. Components of the links are found by the smallest label among neighbours, with pointer jumping.

Hence two documents that share any bucket are always compared or bounded, whatever the size of the bucket.
The members of a large star are salted into groups of at most ``GROUP`` rows, the hub's set going to each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from panelweave.llm.common import in_arrow, partitions, texts
from panelweave.operators.skew import hot_split_join
from panelweave.session import written

#: Defaults: words of a shingle, and the least likeness in hundredths.
WIDTH, THRESHOLD = 5, 80
REGISTERS, ROWS = 96, 4
SCALE, RATE = 1.001, 20.0
_TOP = (1 << 16) - 2
#: Pairs whose estimate is this far below the threshold are dropped (some five standard errors).
MARGIN = 0.2
GROUP, BLOCK = 64, 256
_SLICE_BYTES = 2 << 20
_CHUNK = 1 << 16
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)]
_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C[3]
    h = (h ^ (h >> np.uint64(29))) * _C[0]
    return h ^ (h >> np.uint64(32))


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than ``width`` words are one shingle, none are no shingle.

    Words are runs without white space, with A-Z in lower case.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column))
    coded = lists.flatten().dictionary_encode()
    names = [xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()]
    hashes = np.asarray(names, dtype=np.uint64)[coded.indices.to_numpy(zero_copy_only=False)] if names else np.zeros(0, dtype=np.uint64)
    some = pc.greater(pc.binary_length(lists.flatten()), 0).to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    before = np.concatenate([[0], np.cumsum(some)])[offsets - offsets[0]]
    hashes = hashes[some]
    found = []
    for a, b in zip(before[:-1], before[1:], strict=True):
        own, n = hashes[a:b], min(width, b - a)
        if not n:
            found.append(np.zeros(0, dtype=np.uint64))
            continue
        h = np.full(b - a - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ own[k : b - a - n + 1 + k]) * _C[0]
            h ^= h >> np.uint64(31)
        found.append(np.unique(_mix(h)))
    return found


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (one row per set, none of the sets empty)."""
    least = np.empty((len(sets), REGISTERS), dtype=np.uint64)
    sizes = np.asarray([len(s) for s in sets])
    low = 0
    while low < len(sets):
        high, held = low, 0
        while high < len(sets) and (high == low or held + sizes[high] <= _CHUNK):
            held += sizes[high]
            high += 1
        elements = np.concatenate(sets[low:high])
        starts = np.cumsum(sizes[low:high]) - sizes[low:high]
        for j in range(REGISTERS):
            h = elements * _FACTORS[j] + _SHIFTS[j]
            least[low:high, j] = np.minimum.reduceat(h ^ (h >> np.uint64(33)), starts)
        low = high
    uniform = np.minimum((least.astype(np.float64) + 0.5) / 2.0**64, 1.0 - 1e-15)
    value = np.floor(1.0 - np.log(-np.log1p(-uniform) / RATE) / math.log(SCALE))
    return np.clip(value, 0, _TOP + 1).astype("<u2")


def likeness(one: np.ndarray, other: np.ndarray, n_one: np.ndarray, n_other: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard likeness of pairs from their registers (rows) and set sizes.

    The registers of a pair are larger, smaller or equal with probabilities that depend on the likeness alone
    once the sizes are known; the likelihood is concave, and its maximum is found by halving on the slope.
    """
    up, down = (one > other).sum(axis=1), (one < other).sum(axis=1)
    same = one.shape[1] - up - down
    u, v = n_one / (n_one + n_other), n_other / (n_one + n_other)
    base, ratio = math.log(SCALE), (SCALE - 1.0) / SCALE

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-12, 1.0) * ratio) / base

    def slope(x: np.ndarray) -> np.ndarray:
        """Probability that one register exceeds the other: derivative of p."""
        return ratio / base / (1.0 - x * ratio)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):
        mid = (low + high) / 2
        a, b = u - v * mid, v - u * mid
        rest = np.maximum(1.0 - p(a) - p(b), 1e-12)
        gain = -up * v * slope(a) / p(a) - down * u * slope(b) / p(b) + same * (v * slope(a) + u * slope(b)) / rest
        low, high = np.where(gain > 0, mid, low), np.where(gain > 0, high, mid)
    return (low + high) / 2


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > _SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def sketches(rows: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, and for non-empty sets a 128-bit key of the whole set and the registers."""
    kind = rows.sparkSession.createDataFrame([], "doc_id long, n_shingles long, set_key binary, registers binary").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        for batch in batches:
            for part in _slices(batch):
                sets = shingle_sets(part.column("text"), width)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, found = [None] * len(sets), [None] * len(sets)
                if full:
                    for i, r in zip(full, registers([sets[i] for i in full]), strict=True):
                        keys[i], found[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), r.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.binary())], schema=out
                )

    return in_arrow(rows, run, kind)


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """doc_id, key of the set and the whole set as bytes."""
    kind = rows.sparkSession.createDataFrame([], "doc_id long, set_key binary, elements binary").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        for batch in batches:
            for part in _slices(batch):
                sets = [s.tobytes() for s in shingle_sets(part.column("text"), width)]
                keys = pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), keys, pa.array(sets, pa.binary())], schema=out)

    return in_arrow(rows, run, kind)


def _stars(reps: DataFrame) -> DataFrame:
    """Pairs (hub, member) of documents that share a bucket with the hub, and the members of the star."""
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("registers", 2 * ROWS * b + 1, 2 * ROWS)) for b in range(REGISTERS // ROWS)])
    rows = reps.select("rep", F.explode(keys).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = written(rows.join(sizes, "bucket"), "near-members")
    weight = members.groupBy("rep").agg(F.sum("size").alias("weight"))
    weighed = written(members.join(weight, "rep").select("bucket", "rep", "weight"), "near-weighed")
    heaviest = weighed.groupBy("bucket").agg(F.max("weight").alias("weight"))
    hubs = weighed.join(heaviest, ["bucket", "weight"]).groupBy("bucket").agg(F.min("rep").alias("hub"))
    pairs = weighed.join(hubs, "bucket").filter("rep <> hub").select("hub", F.col("rep").alias("member")).distinct()
    pairs = written(pairs, "near-pairs")
    return pairs.join(pairs.groupBy("hub").agg(F.count("*").alias("star")), "hub")


def _estimated(pairs: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """Pairs of the two sketches, without those estimated far below the threshold."""
    own = reps.select(F.col("rep").alias("member"), F.col("registers").alias("r_member"), F.col("n_shingles").alias("n_member"))
    hub = reps.select(F.col("rep").alias("hub"), F.col("registers").alias("r_hub"), F.col("n_shingles").alias("n_hub"))
    joined = pairs.join(own, "member").join(hub, "hub")
    least = threshold / 100 - MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(batch.num_rows, -1) for c in ("r_member", "r_hub"))
                n, m = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("n_member", "n_hub"))
                yield batch.select(["hub", "member", "star"]).filter(pa.array(likeness(a, b, n, m) >= least))

    return in_arrow(joined.select("hub", "member", "star", "r_member", "r_hub", "n_member", "n_hub"), run, pairs.select("hub", "member", "star").schema)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Rows of consecutive equal keys, from batches sorted by the keys; groups are bounded by their salts."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[k] != held[0][k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _relative(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of stars relative to the hub: sizes, common elements, a bit per element of the hub, elements outside it."""
    spark = pairs.sparkSession
    salts = F.ceil(F.col("star") / GROUP).cast("int")
    own = pairs.join(sets.withColumnRenamed("doc_id", "member"), "member").withColumn("salt", F.pmod(F.xxhash64("member"), salts).cast("int"))
    hubs = pairs.select("hub", "star").distinct().join(sets.withColumnRenamed("doc_id", "hub"), "hub")
    hubs = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).withColumn("member", F.lit(None).cast("long"))
    columns = ["hub", "salt", "member", "star", "elements"]
    rows = own.select(*columns).unionByName(hubs.select(*columns)).repartition(partitions(spark), "hub", "salt")
    rows = rows.sortWithinPartitions("hub", "salt", F.asc_nulls_first("member"))
    schema = "hub long, member long, star long, n_hub long, n_member long, common long, bits binary, outside binary"
    kind = spark.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        center = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                elements = np.frombuffer(row["elements"], dtype="<u8")
                if row["member"] is None:
                    center = elements
                    continue
                _, in_hub, in_own = np.intersect1d(center, elements, assume_unique=True, return_indices=True)
                bits = np.zeros(-(-len(center) // 64) * 64, dtype=np.uint8)
                bits[in_hub] = 1
                outside = np.delete(elements, in_own).tobytes()
                made.append((row["hub"], row["member"], row["star"], len(center), len(elements), len(in_own), np.packbits(bits).tobytes(), outside))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)

    return in_arrow(rows, run, kind)


def _linked(common: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: int) -> np.ndarray:
    return 100 * common >= threshold * (n + m - common)


def links_in_block(rest: list[dict], members: list[dict], threshold: int) -> list[tuple[int, int]]:
    """Links between members not linked to their hub and any members of the star."""
    found = []
    bits, other = (np.frombuffer(b"".join(r["bits"] for r in side), dtype="<u8").reshape(len(side), -1) for side in (rest, members))
    n, m = (np.asarray([r["n_member"] for r in side]) for side in (rest, members))
    outside, beyond = (np.asarray([len(r["outside"]) // 8 for r in side]) for side in (rest, members))
    for i, row in enumerate(rest):
        common = np.bitwise_count(other & bits[i]).sum(axis=1, dtype=np.int64)
        possible = _linked(common + np.minimum(beyond, outside[i]), m, n[i], threshold)
        for j in np.flatnonzero(possible):
            if members[j]["member"] == row["member"]:
                continue
            both = np.intersect1d(np.frombuffer(row["outside"], dtype="<u8"), np.frombuffer(members[j]["outside"], dtype="<u8"), assume_unique=True)
            if _linked(common[j] + len(both), m[j], n[i], threshold):
                found.append((row["member"], members[j]["member"]))
    return found


def _star_blocks(rows: DataFrame) -> DataFrame:
    """Open members (``rest``) against all members of their star, as a grid of blocks (i, j).

    An open member goes to all blocks j of its star. Any member goes only to the blocks i that hold an open one, so a star
    with one open member is copied once, however large it is.
    """
    rows = rows.withColumn("own", F.pmod(F.xxhash64("member"), F.ceil(F.col("star") / BLOCK)).cast("int"))
    hubs = rows.groupBy("hub").agg(F.count("*").alias("members"), F.collect_set(F.when(F.col("rest"), F.col("own"))).alias("open"))
    rows = hot_split_join(rows, hubs, ["hub"], count="members").filter(F.size("open") > 0)
    every = F.sequence(F.lit(0), F.ceil(F.col("star") / BLOCK).cast("int") - 1)
    columns = ["hub", "i", "j", "rest", "member", "n_member", "bits", "outside"]
    first = rows.filter("rest").withColumn("i", F.col("own")).withColumn("j", F.explode(every)).select(*columns)
    second = rows.withColumn("j", F.col("own")).withColumn("i", F.explode("open")).withColumn("rest", F.lit(False)).select(*columns)
    return first.unionByName(second)


def _links_beside_hubs(relative: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) in a star that do not involve its hub, from blocks of at most ``BLOCK`` expected members a side."""
    spark = relative.sparkSession
    with_hub = F.expr(f"100 * common >= {threshold} * (n_hub + n_member - common)")
    rows = relative.filter("star > 1").withColumn("rest", ~with_hub)
    dealt = _star_blocks(rows).repartition(partitions(spark), "hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    kind = spark.createDataFrame([], "a long, b long").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        for group in _groups(batches, ["hub", "i", "j"]):
            rest, members = [r for r in group if r["rest"]], [r for r in group if not r["rest"]]
            found = links_in_block(rest, members, threshold) if rest and members else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=out)

    return in_arrow(dealt, run, kind)


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every end of a link (a, b): the smallest id reachable.

    In each round a vertex takes the smallest label among its neighbours and itself, and then the label of that
    label, so the rounds grow with the logarithm of the diameter. Labels are written between rounds.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).toDF("a", "b").distinct(), "near-links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("label")), "near-labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("jump"))
        new = step.join(jump, "label").select("id", "old", F.least("label", "jump").alias("label"))
        new = written(new, "near-labels")
        moved = new.filter("label <> old").limit(1).count()
        labels = new.select("id", "label")
        if not moved:
            return labels


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * common >= ``threshold`` * union of their shingle sets. ``component_id`` is the
    smallest doc_id reachable over links, ``kept`` whether it is the document's own. Null and empty texts, and
    texts of white space, have no shingle and are linked with nothing. A row without an id is linked with
    nothing; its component_id is null and it is kept. Rows that repeat an id are one document. An empty table
    gives no rows; other columns are ignored. A text of any length counts whole; its task holds its shingles. Ties do not matter:
    links do not depend on the order of rows.
    """
    source = texts(docs)
    rows = written(sketches(source, width), "near-sketches")
    full = rows.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = full.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    reps = full.join(classes.withColumnRenamed("rep", "doc_id"), ["set_key", "doc_id"]).withColumnRenamed("doc_id", "rep")
    of_rep = reps.groupBy("rep").agg(F.min("set_key").alias("set_key"))  # an id with several texts counts with one of them
    reps = reps.join(of_rep, ["rep", "set_key"]).dropDuplicates(["rep", "set_key"])
    reps = written(reps.select("rep", "set_key", "n_shingles", "registers"), "near-reps")
    stars = written(_stars(reps), "near-stars")
    alone = _estimated(stars.filter("star = 1"), reps, threshold)
    pairs = written(alone.unionByName(stars.filter("star > 1")), "near-compared")
    active = pairs.select(F.col("hub").alias("doc_id")).union(pairs.select("member")).distinct()
    keys = reps.join(active.withColumnRenamed("doc_id", "rep"), "rep").select(F.col("rep").alias("doc_id"), "set_key")
    sets = _sets(source.join(active, "doc_id", "left_semi"), width).join(keys, ["doc_id", "set_key"], "left_semi")
    sets = written(sets.dropDuplicates(["doc_id", "set_key"]).drop("set_key"), "near-sets")
    relative = written(_relative(pairs, sets), "near-relative")
    with_hub = relative.filter(f"100 * common >= {threshold} * (n_hub + n_member - common)").select(F.col("hub").alias("a"), F.col("member").alias("b"))
    linked = components(with_hub.union(_links_beside_hubs(relative, threshold)))
    labelled = classes.join(linked.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("label", "rep").alias("component_id"))
    found = full.join(labelled, "set_key").select("doc_id", "n_shingles", "component_id", (F.col("component_id") == F.col("doc_id")).alias("kept"))
    rest = rows.filter(F.col("doc_id").isNull() | (F.col("n_shingles") == 0))
    return found.unionByName(rest.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).alias("component_id"), F.lit(True).alias("kept")))


def keep_one(docs: DataFrame, **how: int) -> DataFrame:
    """The documents that stay, one of each component, with all their columns.

    Documents without a shingle (null, empty, white space) and rows without an id stay; rows that repeat an id stay or go together.
    An empty table gives no rows. Columns of any name are kept, but for ``_near_id``.
    """
    kept = near_duplicates(docs, **how).filter("kept").select(F.coalesce("doc_id", F.lit(-1)).alias("_near_id")).distinct()
    return docs.join(kept, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)) == F.col("_near_id"), "left_semi")
