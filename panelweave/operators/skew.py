"""Joins that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.session import written

TASK_ROWS = 1_000_000  # rows of one key that a task takes; a key with more is spread over several
MOST_SPLIT = 100_000  # keys that are split at most: with very many rows a task takes more of one key


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool):
    tests = [left[k].eqNullSafe(right[f"_k_{k}"]) if null_safe else left[k] == right[f"_k_{k}"] for k in keys]
    return reduce(lambda a, b: a & b, tests)


def hot_split_join(left: DataFrame, right: DataFrame, keys: Sequence[str], *, count: str,
                   null_safe: bool = False, task_rows: int = TASK_ROWS) -> DataFrame:
    """Left join to a ``right`` with one row per key of ``left``; ``right[count]`` counts its rows.

    This runs a job: ``right`` is written to the shared folder first, because it is read twice below, and
    a stored table of known size lets the planner broadcast it when small, which spares ``left`` the shuffle.

    A key of c rows is dealt to ceil(c / task_rows) places: its rows carry a salt below that number, and its
    one row of ``right`` is repeated for every salt. How many keys are split follows from the counts alone;
    they are at most rows / task_rows and at most ``MOST_SPLIT`` (beyond, task_rows grows with the rows), which bounds the
    table of their factors, the only thing broadcast.
    Rows with a NULL key are spread the same way when they meet nothing. The salt is a hash of all columns, so
    rows that are equal throughout stay together: group those beforehand. A key absent from ``right`` joins to
    nothing, but its rows stay together: hand in all keys and filter afterwards when one may be frequent.
    """
    right = written(right, "join-side")
    values = [c for c in right.columns if c not in keys]
    renamed = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(v).alias(f"_v_{v}") for v in values])
    tie = [f"_k_{k}" for k in keys]
    task_rows = max(task_rows, (right.agg(F.sum(count)).first()[0] or 0) // MOST_SPLIT)
    factor = F.ceil(F.col(f"_v_{count}") / F.lit(task_rows)).cast("int")
    split = renamed.where(F.col(f"_v_{count}") > task_rows).select(*tie, factor.alias("_factor"))
    step = left.join(F.broadcast(split), _same(left, split, keys, null_safe), "left").drop(*tie)  # at most MOST_SPLIT
    places = F.coalesce("_factor", F.lit(1))
    if not null_safe:
        unknown = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
        places = F.when(unknown, F.lit(1 << 20)).otherwise(places)
    step = step.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), places).cast("int")).drop("_factor")
    copies = F.sequence(F.lit(0), F.greatest(F.coalesce(factor, F.lit(1)), F.lit(1)) - 1)
    spread = renamed.withColumn("_place", F.explode(copies))
    joined = step.join(spread, _same(step, spread, keys, null_safe) & (step["_salt"] == spread["_place"]), "left")
    return joined.select(*left.columns, *[F.col(f"_v_{v}").alias(v) for v in values])
