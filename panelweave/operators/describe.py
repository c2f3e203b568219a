"""Descriptives: complete cases, group summaries, box statistics and densities."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from panelweave.operators.ordered import running_total
from panelweave.operators.selection import renamed, same, selected_quantiles
from panelweave.operators.skew import hot_split_join
from panelweave.session import written


def _all(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _complete(df: DataFrame, columns: Sequence[str], drop_blank: bool) -> Column:
    tests = [F.col(c).isNotNull() for c in columns]
    if drop_blank:
        tests += [F.col(c) != "" for c in columns if isinstance(df.schema[c].dataType, StringType)]
    return _all(tests)


def complete_cases(df: DataFrame, columns: Sequence[str], drop_blank: bool = False) -> DataFrame:
    """Rows without a NULL in ``columns``; with ``drop_blank`` also without an empty string."""
    return df.where(_complete(df, columns, drop_blank))


def omitted_rows(df: DataFrame, columns: Sequence[str], drop_blank: bool = False) -> DataFrame:
    """How many rows the complete-case filter drops, in one pass."""
    kept = F.coalesce(_complete(df, columns, drop_blank), F.lit(False))
    counts = df.agg(F.count("*").alias("n_total"), F.count_if(~kept).alias("n_omitted"))
    return counts.withColumn("pct_omitted", 100 * F.col("n_omitted") / F.col("n_total"))


def na_patterns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequency of each combination of missing columns, most frequent first."""
    flags = [F.col(c).isNull().alias(f"na_{c}") for c in columns]
    return df.groupBy(*flags).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *[f"na_{c}" for c in columns])


def within(df: DataFrame, column: str, bound: float = 5.0) -> DataFrame:
    """Rows strictly inside ``(-bound, bound)``; NULL is outside."""
    return df.where((F.col(column) > -bound) & (F.col(column) < bound))


def outlier_count(df: DataFrame, column: str, bound: float = 5.0) -> DataFrame:
    """Rows strictly beyond either bound."""
    return df.agg(F.count_if((F.col(column) < -bound) | (F.col(column) > bound)).alias("n_outliers"))


def with_zscore(df: DataFrame, column: str, name: str) -> DataFrame:
    """``(x - mean) / sd`` over the frame; mean and sd arrive as scalar subqueries, without a join."""
    stats = df.agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"))
    return df.withColumn(name, (F.col(column) - stats.select("m").scalar()) / stats.select("s").scalar())


def mean_ci(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per group: rows, mean, sample sd, standard error and the bounds two errors either side."""
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    out = out.withColumn("se", F.col("sd") / F.sqrt("n"))
    return out.withColumn("lo", F.col("mean") - 2 * F.col("se")).withColumn("hi", F.col("mean") + 2 * F.col("se"))


def mean_with_total(df: DataFrame, by: str, value: str, total_value: str, label: str = "All") -> DataFrame:
    """Mean per group, and one total row that averages ``total_value``; one pass over the rows."""
    rolled = df.rollup(by).agg(
        F.avg(value).alias("_g"), F.avg(total_value).alias("_t"), F.grouping(by).alias("_is_total")
    )
    total = F.col("_is_total") == 1
    return rolled.select(
        F.when(total, F.col("_t")).otherwise(F.col("_g")).alias("mean"),
        F.when(total, F.lit(label)).otherwise(F.col(by).cast("string")).alias(by),
    )


def two_way(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Rows, mean and sd per pair of groups, the largest first."""
    out = df.groupBy(row, column).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    return out.orderBy(F.desc("n"), row, column)


def composition(df: DataFrame, by: str, part: str) -> DataFrame:
    """Share of each ``part`` within each ``by`` group; the window runs over group counts only."""
    counts = df.groupBy(by, part).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def ranked_values(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct known values per group: ``_x``, rows that have it ``_c``, rows up to it ``_upto``, rows of the group ``_n``.

    Repeated values, however frequent, cost one row per task before they are ranked, and ranking splits a
    large group over ranges; see ``ordered.running_total``, which writes the values.
    """
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    values = known.groupBy(*by, "_x").agg(F.count("*").alias("_c"))
    return running_total(values, by, ["_x"], F.col("_c"), "_upto", "_n")


def _quantiles(ranked: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Quantiles with linear interpolation from ranked values: one grouping, nothing is collected."""

    def at(p: float) -> Column:
        place = (F.col("_n") - 1) * F.lit(float(p))  # among the sorted values, counted from zero
        low, high = (F.min(F.when(F.col("_upto") >= rank, F.col("_x"))) for rank in (F.floor(place) + 1, F.ceil(place) + 1))
        return low + (high - low) * F.max(place - F.floor(place))

    return ranked.groupBy(*by).agg(F.max("_n").alias("n"), *[at(p).alias(f"q{i}") for i, p in enumerate(probs)])


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles per group with linear interpolation, as columns ``q0, q1, ...``, and rows ``n``.

    ``percentile`` would hold all distinct values of a group in one buffer. Here wanted ranks are narrowed down by counted
    digits (``selection``). For very many groups distinct values are ranked by running totals over ranges instead,
    and a quantile is the smallest value whose rank reaches it.
    """
    if not by:
        return quantiles(df.withColumn("_all", F.lit(1)), ["_all"], value, probs).drop("_all")
    by = list(by)
    out = selected_quantiles(df, by, value, probs)
    return _quantiles(ranked_values(df, by, value), by, probs) if out is None else out


def box_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers (last value within 1.5 box lengths) and outlier count per group with a known value.

    The quartiles of up to ``selection.MOST_GROUPS`` groups are written and broadcast to a last scan. For more groups
    ranked values serve the quartiles and, joined to them, the whiskers.
    """
    if not by:
        return box_stats(df.withColumn("_all", F.lit(1)), ["_all"], value).drop("_all")
    by, quartiles = list(by), (0.25, 0.5, 0.75)
    names = ["n", *[F.col(f"q{i}").alias(c) for i, c in enumerate(("q1", "median", "q3"))]]
    box = selected_quantiles(df, by, value, quartiles)
    if box is not None:
        box = renamed(written(box.select(*by, *names), "boxes"), by)
        rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"), F.lit(1).alias("_c"))
        rows = rows.join(F.broadcast(box), same(rows, box, by))
    else:
        ranked = ranked_values(df, by, value)
        box = _quantiles(ranked, by, quartiles).select(*by, *names)
        rows = hot_split_join(ranked.select(*by, "_x", "_c"), box, by, count="n", null_safe=True)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("_x").between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.groupBy(*by).agg(
        *[F.max(c).alias(c) for c in ("n", "q1", "median", "q3")],
        F.min(F.when(inside, F.col("_x"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_hi"),
        F.sum(F.when(inside, 0).otherwise(F.col("_c"))).alias("n_outliers"),
    )


def histogram(df: DataFrame, by: Sequence[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts and normalised density per fixed-width bin; the last bin includes ``hi``."""
    width = (hi - lo) / bins
    index = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int")
    counted = df.where(F.col(value).between(lo, hi)).groupBy(*by, index.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return counted.select(
        *by, "bin", (lo + (F.col("bin") + 0.5) * width).alias("mid"), "n", (F.col("n") / (total * width)).alias("density")
    )


def kernel_density(df: DataFrame, by: Sequence[str], value: str, lo: float, hi: float, *, grid: int = 512,
                   bins: int = 1024, cut: float = 6.0) -> DataFrame:
    """Gaussian kernel density on ``grid`` points of ``[lo, hi]``, bandwidth by the rule of thumb.

    Rows are reduced to linear-binned masses first, so the kernel meets at most ``bins`` masses per
    group, each spread to the grid points within ``cut`` bandwidths.
    """
    if not by:
        whole = df.withColumn("_all", F.lit(1))
        return kernel_density(whole, ["_all"], value, lo, hi, grid=grid, bins=bins, cut=cut).drop("_all")
    by = list(by)
    inside = df.where(F.col(value).between(lo, hi)).select(*by, F.col(value).cast("double").alias("_x"))
    quart = quantiles(inside, by, "_x", (0.25, 0.75)).drop("n")
    moments = inside.groupBy(*by).agg(F.count("*").alias("_n"), F.stddev_samp("_x").alias("_sd"))
    spread = moments.join(quart, by)
    narrow = F.least(F.col("_sd"), F.when(F.col("q1") > F.col("q0"), (F.col("q1") - F.col("q0")) / 1.34))
    bands = spread.select(*by, "_n", (0.9 * narrow * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).alias("bw"))
    step, gap = (hi - lo) / bins, (hi - lo) / (grid - 1)
    at = (F.col("_x") - lo) / step
    cells = inside.groupBy(*by, F.floor(at).cast("int").alias("_j")).agg(
        F.count("*").alias("_c"), F.sum(at - F.floor(at)).alias("_f")
    )
    masses = cells.select(
        *by,
        F.inline(
            F.array(
                F.struct(F.col("_j").alias("_j"), (F.col("_c") - F.col("_f")).alias("_m")),
                F.struct((F.col("_j") + 1).alias("_j"), F.col("_f").alias("_m")),
            )
        ),
    ).groupBy(*by, "_j").agg(F.sum("_m").alias("_m"))
    centre = lo + F.col("_j") * step
    first = F.greatest(F.ceil((centre - cut * F.col("bw") - lo) / gap), F.lit(0)).cast("int")
    last = F.least(F.floor((centre + cut * F.col("bw") - lo) / gap), F.lit(grid - 1)).cast("int")
    spread_out = (
        masses.join(bands, by)
        .where(F.col("bw") > 0)
        .withColumn("_first", first)
        .withColumn("_last", last)
        .where("_first <= _last")
        .withColumn("point", F.explode(F.sequence("_first", "_last")))
    )
    z = (lo + F.col("point") * gap - centre) / F.col("bw")
    kernel = F.exp(-0.5 * z * z) / (F.col("bw") * F.col("_n") * (2 * 3.141592653589793) ** 0.5)
    dens = spread_out.groupBy(*by, "point").agg(F.sum(F.col("_m") * kernel).alias("density"))
    return dens.withColumn("x", lo + F.col("point") * gap)
