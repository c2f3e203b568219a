"""Group means and leave-one-out group means attached to every row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.skew import hot_split_join


def group_stats(df: DataFrame, keys: Sequence[str], value: str, prefix: str = "") -> DataFrame:
    """Per group: rows (``n``), rows with a value (``n_x``) and the sum of values (``sum_x``)."""
    return df.groupBy(*keys).agg(
        F.count("*").alias(f"{prefix}n"),
        F.count(value).alias(f"{prefix}n_x"),
        F.sum(value).alias(f"{prefix}sum_x"),
    )


def group_mean(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Mean of ``value`` per group."""
    return df.groupBy(*keys).agg(F.avg(value).alias(name))


def leave_one_out(total: Column, n: Column, x: Column) -> Column:
    """Mean of the others: ``(total - x) / (n - 1)``, NULL for a group of one or a NULL ``x``."""
    return F.when(n > 1, (total - x) / (n - 1))


def attach_group_stats(df: DataFrame, keys: Sequence[str], value: str, *, mean: str | None = None,
                       loo: str | None = None, size: str | None = None, denominator: str = "rows") -> DataFrame:
    """Attach the group mean, leave-one-out mean and group size to every row.

    The group is aggregated first and joined back; a window over the group would collect it in one
    task. A NULL key is a group of its own. ``denominator="rows"`` counts all rows of the group,
    also those without a value; ``"non_null"`` counts values only.
    """
    if denominator not in ("rows", "non_null"):
        raise ValueError("denominator must be 'rows' or 'non_null'")
    stats = group_stats(df, keys, value, "_g_")
    joined = hot_split_join(df, stats, keys, count="_g_n", null_safe=True)
    n = F.col("_g_n") if denominator == "rows" else F.col("_g_n_x")
    out = list(df.columns)
    if mean:
        out.append((F.col("_g_sum_x") / F.col("_g_n_x")).alias(mean))
    if loo:
        out.append(leave_one_out(F.col("_g_sum_x"), n, F.col(value)).alias(loo))
    if size:
        out.append(F.col("_g_n").alias(size))
    return joined.select(*out)


_STATIC, _DYNAMIC = "contributor_score", "score_dyn"
PLACES = {"city": ("city", True), "zipcode": ("zipcode", False)}


def _place_stats(panel: DataFrame, place: str) -> DataFrame:
    """Per place, state and cycle: rows, and sums and counts of the dynamic score; beside them those of the place.

    The sums over all states of a place and cycle, and over the whole place, are windows over these rows: a
    place has one per state and cycle, however many people live there.
    """
    fine = panel.groupBy(place, "state", "cycle").agg(
        F.count("*").alias("_n"),
        F.sum(_STATIC).alias("_s"), F.count(_STATIC).alias("_ns"), F.sum(_DYNAMIC).alias("_dyn"), F.count(_DYNAMIC).alias("_n_dyn"),
    )
    whole, cycle = Window.partitionBy(place), Window.partitionBy(place, "cycle")
    return fine.select(
        place, "state", "cycle", "_n", "_dyn", "_n_dyn",
        F.sum("_n").over(whole).alias("_n_place"), F.sum("_s").over(whole).alias("_static"), F.sum("_ns").over(whole).alias("_n_static"),
        F.sum("_n").over(cycle).alias("_n_cycle"), F.sum("_dyn").over(cycle).alias("_dyn_cycle"),
    )


def attach_local_means(panel: DataFrame, places: Mapping[str, tuple[str, bool]] = PLACES, size: str | None = "n_per_zip") -> DataFrame:
    """All local means of the panel: by place (static), and by place and cycle (dynamic), with and without the row itself.

    ``places`` maps the name in the new columns to the place column and whether the dynamic leave-one-out mean
    stays within the state. The defaults follow the published tables: the zip-by-cycle mean includes the state
    while its leave-one-out twin does not, and the static means have no state. ``size`` names the row count of
    the last place. Each place takes one join. ``panel`` is read once more per place: hand in a written table (see
    ``session.written``) when it is costly to compute. Runs jobs.
    """
    out = panel
    static, dynamic = F.col(_STATIC), F.col(_DYNAMIC)
    for i, (name, (place, within_state)) in enumerate(places.items()):
        joined = hot_split_join(out, _place_stats(panel, place), [place, "state", "cycle"], count="_n", null_safe=True)
        total, rows = ("_dyn", "_n") if within_state else ("_dyn_cycle", "_n_cycle")
        added = [
            (F.col("_static") / F.col("_n_static")).alias(f"mean_score_{name}"),
            leave_one_out(F.col("_static"), F.col("_n_place"), static).alias(f"mean_score_{name}_wo_i"),
            F.when(F.col("_n_dyn") > 0, F.col("_dyn") / F.col("_n_dyn")).alias(f"mean_dyn_score_{name}_cycle"),
            leave_one_out(F.col(total), F.col(rows), dynamic).alias(f"mean_dyn_score_{name}_cycle_wo_i"),
        ]
        if size and i == len(places) - 1:
            added.append(F.col("_n_place").alias(size))
        out = joined.select(*out.columns, *added)
    return out
