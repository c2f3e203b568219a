"""Aggregates kept as mergeable states, extended by the keys of a new batch.

A state table holds one row per key, and every column of it can be merged with itself: sums, extremes, flags, and picks that
carry the order they were picked by. It is stored by one of its keys (a year, a cycle). A batch is grouped on its own, meets
the stored rows of the partitions it touches, and replaces those partitions; all others stay the files they are. A
manifest makes each step visible at once, and a batch that was published before is not added again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.functions.picks import longest
from panelweave.operators import insiders
from panelweave.operators.panel import FIRST_SEEN, needed_cycles, weighted_terms
from panelweave.session import intermediates, written
from panelweave.sources import manifest

Merge = Callable[[Column], Column]
_PLACE = "_place"

#: How the columns of :func:`insiders.person_years` merge.
YEAR_KEYS = ("owner_cik", "cik", "year")
YEAR_MERGES: Mapping[str, Merge] = {
    "owner_name_raw": longest, "issuer_name": F.min, "ticker": F.max, "is_officer": F.bool_or, "is_director": F.bool_or, "has_form3": F.bool_or,
    "title_label": longest, "first_event": F.min, "last_event": F.max, "n_filings": F.sum,
}
#: How the columns of :func:`panel_states` merge.
PANEL_KEYS = ("cid", "cycle")
PANEL_MERGES: Mapping[str, Merge] = {
    **{f"first_{c}": F.min for c in FIRST_SEEN}, "n_transactions": F.sum, "total_amount": F.sum, "num": F.sum, "den": F.sum,
}


def merged(states: DataFrame, keys: Sequence[str], merges: Mapping[str, Merge]) -> DataFrame:
    """States of equal keys folded into one."""
    return states.groupBy(*keys).agg(*[how(F.col(c)).alias(c) for c, how in merges.items()])


def read_states(spark: SparkSession, root: str, values: Iterable[object] | None = None) -> DataFrame | None:
    """The stored states, all or those of some partition values; ``None`` when there are none."""
    wanted = None if values is None else {str(v) for v in values}
    paths = [p for p in manifest.current(spark, root)["parts"] if wanted is None or p.split(f"{_PLACE}=", 1)[1] in wanted]
    if not paths:
        return None
    return spark.read.option("basePath", root).parquet(*[f"{root}/{p}" for p in paths]).drop("part", _PLACE)


def upsert_states(spark: SparkSession, root: str, batch: DataFrame, keys: Sequence[str], merges: Mapping[str, Merge], by: str,
                  batch_number: int | None = None) -> list[str]:
    """Merge the states of a batch into the stored ones; returns the partition values that were replaced or added.

    ``by`` is one of the keys, with few values in a batch and none missing. One writer at a time. With
    ``batch_number`` a batch that is not above the last published one changes nothing.
    """
    if batch_number is not None and batch_number <= manifest.current(spark, root)["last_batch"]:
        return []
    with intermediates(spark):
        new = written(merged(batch, keys, merges), "state-batch")
        touched = sorted(str(r[0]) for r in new.select(by).distinct().collect())  # years or cycles of one batch
        old = read_states(spark, root, touched)
        whole = new if old is None else merged(new.unionByName(old), keys, merges)
        part, out = manifest.new_part(root, "states")
        whole.withColumn(_PLACE, F.col(by).cast("string")).write.partitionBy(_PLACE).option("compression", "zstd").parquet(out)
    live = manifest.current(spark, root)["parts"]
    gone = [p for p in live if p.split(f"{_PLACE}=", 1)[1] in set(touched)]
    manifest.publish(spark, root, [f"{part}/{_PLACE}={v}" for v in touched], gone, last_batch=batch_number)
    return touched


def add_filings(spark: SparkSession, root: str, submissions: DataFrame, owners: DataFrame, batch_number: int | None = None) -> list[str]:
    """Extend the stored person-years by a batch of filings, say a quarter; returns the years it touched.

    A filing and its owners must come in the same batch.
    """
    return upsert_states(spark, root, insiders.person_years(submissions, owners), YEAR_KEYS, YEAR_MERGES, "year", batch_number)


def panel_states(df: DataFrame) -> DataFrame:
    """Per (cid, cycle) of individuals what :func:`panel_from_states` needs: picks with their order, counts and sums."""
    num, den = weighted_terms(df)
    order = F.col("date").isNotNull()
    picks = [F.min(F.when(order & F.col(c).isNotNull(), F.struct("date", "txn_id", F.col(c).alias("value")))).alias(f"first_{c}") for c in FIRST_SEEN]
    return df.where("contributor_type = 'I'").groupBy(*PANEL_KEYS).agg(
        *picks, F.count("*").alias("n_transactions"), F.sum("amount").alias("total_amount"), F.sum(num).alias("num"), F.sum(den).alias("den")
    )


def add_transactions(spark: SparkSession, root: str, transactions: DataFrame, batch_number: int | None = None) -> list[str]:
    """Extend the stored panel states by a batch of transactions; returns the cycles it touched."""
    return upsert_states(spark, root, panel_states(transactions), PANEL_KEYS, PANEL_MERGES, "cycle", batch_number)


def panel_from_states(spark: SparkSession, root: str, targets: Iterable[int], step: int = 2) -> DataFrame:
    """The person-by-cycle panel of the stored states; only the cycles it needs are read."""
    targets = list(targets)
    states = read_states(spark, root, needed_cycles(targets, step))
    if states is None:
        raise ValueError("no states of these cycles are stored")
    before = Window.partitionBy("cid").orderBy("cycle").rangeBetween(-step, -step)
    pool = lambda c: F.coalesce(F.col(c), F.lit(0.0)) + F.coalesce(F.sum(c).over(before), F.lit(0.0))
    pooled = states.withColumns({"_pn": pool("num"), "_pd": pool("den")}).where(F.col("cycle").isin(targets))
    return pooled.select(
        "cid", "cycle", *[F.col(f"first_{c}.value").alias(c) for c in FIRST_SEEN],
        F.col("n_transactions").alias("n_transactions_per_cycle"), "total_amount", F.when(F.col("_pd") > 0, F.col("_pn") / F.col("_pd")).alias("score_dyn"),
    )
