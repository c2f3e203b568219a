"""Running numbers over ordered rows without collecting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.session import written


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[str], amount: Column, name: str,
                  total: str | None = None) -> DataFrame:
    """Sum of ``amount`` up to and including this row, per ``by`` group in ``order``; ``total`` adds the whole group's sum.

    The rows are range-partitioned by group and order, so a group with a third of all rows lies in many
    consecutive ranges, and are written that way (this runs jobs). Each range adds up its own rows; the sums of
    ranges before it in the same group come from a window over the range totals, a row per range and group.
    ``order`` must tell the rows of a group apart, or rows that tie are numbered arbitrarily.
    """
    by = list(by)
    ranged = df.withColumn("_amount", amount).repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    keys = [*by, "_range"]
    sums = ranged.groupBy(*keys).agg(F.sum("_amount").alias("_sum"))
    group = Window.partitionBy(*by) if by else Window.partitionBy()
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(c).alias(f"_k_{c}") for c in keys],
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"), F.sum("_sum").over(group).alias("_whole"),
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = ranged.withColumn("_inside", F.sum("_amount").over(inside))
    on = F.lit(True)
    for c in keys:
        on = on & counted[c].eqNullSafe(offsets[f"_k_{c}"])
    more = [F.col("_whole").alias(total)] if total else []
    return counted.join(offsets, on).select(*df.columns, (F.col("_before") + F.col("_inside")).alias(name), *more)


def running_count(df: DataFrame, by: Sequence[str], order: Sequence[str], marker: Column, name: str = "grp") -> DataFrame:
    """Number of marker rows up to and including this row, per ``by`` group in ``order``."""
    return running_total(df, by, order, F.when(marker, 1).otherwise(0).cast("long"), name)


def row_numbers(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """Consecutive row numbers over the whole frame in ``order``; one task adds up one total per range."""
    return running_count(df, [], order, F.lit(True), name)


def running_last(df: DataFrame, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The last ``value`` that is not NULL up to and including this row, over the whole frame in ``order``.

    Rows are range-partitioned and written as in :func:`running_total`; one task passes on one value per range.
    """
    ranged = df.withColumn("_own", value).repartitionByRange(*order).withColumn("_range_id", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    last = ranged.where(F.col("_own").isNotNull()).groupBy("_range_id").agg(F.max_by("_own", F.struct(*order)).alias("_last"))
    every = ranged.select("_range_id").distinct().join(last, "_range_id", "left")
    earlier = Window.orderBy("_range_id").rowsBetween(Window.unboundedPreceding, -1)
    before = every.select("_range_id", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    inside = Window.partitionBy("_range_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.withColumn("_inside", F.last("_own", ignorenulls=True).over(inside))
    return found.join(before, "_range_id").select(*df.columns, F.coalesce("_inside", "_before").alias(name))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in a full order: a grouped minimum that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_f"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_f.{c}").alias(c) for c in df.columns])
