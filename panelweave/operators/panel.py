"""Person-by-cycle panels from transactions, and latest-per-person tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.picks import first_by, last_by
from panelweave.functions.scores import amount_weight, counts_for_score

# Source columns the panel needs, and those it carries per person and cycle.
SOURCE_COLUMNS = (
    "cid", "recipient_id", "cycle", "txn_id", "txn_type", "date", "amount", "contributor_type", "employer",
    "occupation", "city", "zipcode", "contributor_score", "candidate_score", "gender", "state",
    "name", "lname", "fname", "mname",
)
FIRST_SEEN = (
    "employer", "occupation", "state", "city", "zipcode", "contributor_score",
    "gender", "name", "lname", "fname", "mname",
)


def prune(df: DataFrame, columns: Sequence[str] = SOURCE_COLUMNS) -> DataFrame:
    """Keep the named columns that exist, in the given order."""
    return df.select(*[c for c in columns if c in df.columns])


def needed_cycles(targets: Iterable[int], step: int = 2) -> list[int]:
    """The target cycles and the one before each, which the pooled score looks back to."""
    return sorted({c - back for c in targets for back in (0, step)})


def individuals(df: DataFrame, targets: Iterable[int], step: int = 2) -> DataFrame:
    """Transactions of individuals in the needed cycles; both tests reach the parquet scan."""
    return df.where(F.col("cycle").isin(needed_cycles(targets, step)) & (F.col("contributor_type") == "I"))


def weighted_terms(df: DataFrame) -> tuple[Column, Column]:
    """Weight times score, and weight, of the rows that count."""
    weight = amount_weight(F.col("amount"))
    counted = counts_for_score(F.col("cid"), F.col("candidate_score"), F.col("txn_type")) & (weight > 0)
    return F.when(counted, weight * F.col("candidate_score")), F.when(counted, weight)


def _weighted(df: DataFrame) -> tuple[Column, Column]:
    """Sums of weight times score and of weight over the rows that count."""
    num, den = weighted_terms(df)
    return F.sum(num), F.sum(den)


def weighted_sums(df: DataFrame) -> DataFrame:
    """Per (cid, cycle): ``num`` and ``den`` of the amount-weighted score, groups with weight only."""
    num, den = _weighted(df)
    return df.groupBy("cid", "cycle").agg(num.alias("num"), den.alias("den")).where(F.col("den") > 0)


def pooled_scores(sums: DataFrame, step: int = 2) -> DataFrame:
    """Score of a cycle pooled with the one before: each sum counts in its own cycle and in the next.

    The sums are already one row per person and cycle, so doubling them costs little; a second
    grouping replaces the union of a shifted copy, which would read the source twice.
    """
    spread = sums.withColumn("cycle", F.explode(F.array(F.col("cycle"), F.col("cycle") + step)))
    return (
        spread.groupBy("cid", "cycle")
        .agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
        .where(F.col("den") > 0)
        .select("cid", "cycle", (F.col("num") / F.col("den")).alias("score_dyn"))
    )


def person_cycle_panel(df: DataFrame, targets: Iterable[int], step: int = 2,
                       attributes: Sequence[str] = FIRST_SEEN) -> DataFrame:
    """One row per (cid, cycle) with first-seen attributes, counts and the pooled score.

    Transactions are dealt by person, once: the grouping by cycle and the look-back, a window over the few panel
    rows of a person, both find their rows together. Rows without a person are one large group and meet in partial
    aggregates instead.
    """
    targets = list(targets)
    rows = individuals(df, targets, step)
    known = rows.where(F.col("cid").isNotNull()).repartition("cid")
    return _panel_rows(known, targets, step, attributes).unionByName(
        _panel_rows(rows.where(F.col("cid").isNull()), targets, step, attributes)
    )


def _panel_rows(rows: DataFrame, targets: Sequence[int], step: int, attributes: Sequence[str]) -> DataFrame:
    """Attributes, counts and sums of (cid, cycle) from one grouping, then the look-back."""
    num, den = _weighted(rows)
    by_date = [first_by(F.col(c), F.col("date"), F.col("txn_id")).alias(c) for c in attributes]
    grouped = rows.groupBy("cid", "cycle").agg(
        *by_date,
        F.count("*").alias("n_transactions_per_cycle"),
        F.sum("amount").alias("total_amount"),
        num.alias("_num"),
        den.alias("_den"),
    )
    before = Window.partitionBy("cid").orderBy("cycle").rangeBetween(-step, -step)
    pool = lambda c: F.coalesce(F.col(c), F.lit(0.0)) + F.coalesce(F.sum(c).over(before), F.lit(0.0))
    return (
        grouped.withColumn("_pn", pool("_num"))
        .withColumn("_pd", pool("_den"))
        .where(F.col("cycle").isin(targets))
        .withColumn("score_dyn", F.when(F.col("_pd") > 0, F.col("_pn") / F.col("_pd")))
        .drop("_num", "_den", "_pn", "_pd")
    )


def latest_by_key(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Per key and column the value at the largest ``order`` among its non-NULL values.

    ``order`` itself, where asked for, is its maximum. Equal orders resolve to the larger value.
    """
    picks = [F.max(order).alias(c) if c == order else last_by(F.col(c), F.col(order), F.col(c)).alias(c) for c in columns]
    return df.groupBy(key).agg(*picks)


def dropped_columns(before: DataFrame, after: DataFrame) -> list[str]:
    """Columns a projection removed, in their old order."""
    kept = set(after.columns)
    return [c for c in before.columns if c not in kept]
