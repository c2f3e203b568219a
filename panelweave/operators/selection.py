"""Exact order statistics by radix selection: three scans that count digits, without a sort or a copy of the values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.session import written

MOST_GROUPS = 20_000  # the wanted cells of so many groups are broadcast; beyond that callers rank the values instead
_LOW = 21  # bits of the second digit


def _code(x: Column) -> Column:
    """A whole number that never falls when ``x`` grows: sign and logarithm, in steps of 2^-31.

    Some 2^42 codes span all doubles, and at most about two million doubles share one. Zero has the code 0, infinities lie
    beyond all finite values, NaN beyond those.
    """
    size = F.least(F.ln(F.abs(x)), F.lit(710.0)) + 746.0  # logarithms of doubles lie between -745 and 709.8
    return F.floor(F.when(F.isnan(x), F.lit(1500.0)).when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * size) * float(2**31))


def _wanted(cells: DataFrame, keys: Sequence[str], digit: str, ranks: Column) -> DataFrame:
    """The cells, in order of ``digit`` within ``keys``, that hold a wanted rank; ``_ranks`` become ranks inside the cell."""
    order = Window.partitionBy(*keys).orderBy(digit).rowsBetween(Window.unboundedPreceding, 0)
    placed = cells.withColumn("_before", F.sum("_c").over(order) - F.col("_c"))
    inside = F.filter(ranks, lambda r: (r["rank"] > F.col("_before")) & (r["rank"] <= F.col("_before") + F.col("_c")))
    moved = F.transform(inside, lambda r: F.struct(r["id"].alias("id"), (r["rank"] - F.col("_before")).alias("rank")))
    return placed.withColumn("_ranks", moved).where(F.size("_ranks") > 0).drop("_before", "_c")


def same(left: DataFrame, right: DataFrame, by: Sequence[str]) -> Column:
    """Null-safe equality of ``by`` with the columns of ``right`` called ``_k_`` and the name."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"_k_{c}"]) for c in by], F.lit(True))


def renamed(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` with ``_k_`` before the names of ``by``."""
    return df.withColumnsRenamed({c: f"_k_{c}" for c in by})


def selected_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame | None:
    """Quantiles ``q0, q1, ...`` with linear interpolation and known rows ``n`` per group; None above ``MOST_GROUPS`` groups.

    A scan counts the leading digit of every value per group, and a running total over the digits (at most some four
    million) tells in which of them the wanted ranks lie. The second scan counts the next digit of the values there,
    the third the values themselves. Counts combine before every shuffle, so neither a large group nor a frequent value
    meets in one task. Two tables of wanted cells, a few rows per group, are written; the values are not.
    ``by`` must not be empty. Groups without a known value are left out.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    rows = rows.withColumn("_code", _code(F.col("_x"))).withColumn("_lead", F.shiftright("_code", _LOW))

    cells = rows.groupBy(*by, "_lead").agg(F.count("*").alias("_c"))
    cells = cells.withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    places = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]  # among the sorted values, counted from zero
    ends = [end for place in places for end in (F.floor(place) + 1, F.ceil(place) + 1)]
    ranks = F.array(*[F.struct(F.lit(i).alias("id"), end.alias("rank")) for i, end in enumerate(ends)])
    wanted = written(_wanted(cells, by, "_lead", ranks), "wanted-lead")
    if wanted.where(F.exists("_ranks", lambda r: r["id"] == 0)).count() > MOST_GROUPS:  # one cell of a group holds the first rank
        return None

    for prefix, digit in (("_lead", "_code"), ("_code", "_x")):
        few = renamed(wanted, [*by, prefix])
        met = rows.join(F.broadcast(few), same(rows, few, [*by, prefix]))
        counted = met.groupBy(*by, "_n", "_ranks", prefix, digit).agg(F.count("*").alias("_c"))
        wanted = _wanted(counted, [*by, prefix], digit, F.col("_ranks"))
        wanted = written(wanted.drop(prefix), "wanted-code") if digit == "_code" else wanted

    def at(i: int) -> Column:
        return F.max(F.when(F.exists("_ranks", lambda r: r["id"] == i), F.col("_x")))

    found = wanted.groupBy(*by).agg(F.max("_n").alias("n"), *[at(i).alias(f"_e{i}") for i in range(len(ends))])
    quantile = []
    for i, p in enumerate(probs):
        place = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.col(f"_e{2 * i}"), F.col(f"_e{2 * i + 1}")
        quantile.append((low + (high - low) * (place - F.floor(place))).alias(f"q{i}"))
    return found.select(*by, "n", *quantile)
