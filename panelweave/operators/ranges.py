"""Points to the narrowest range that holds them, over any domain of integers or dates, without trying all ranges.

The ends of n ranges cut the domain into at most 2n segments; between two ends the same ranges hold every point. So the
narrowest range is found per segment, and a point takes that of the last segment that begins at or before it, by one pass over
points and segments in order. Points are not multiplied, whatever the length of the ranges.

For the segments, a range is cut into dyadic bins of segment numbers: the bins of width 2**k are the numbers that agree but for
their last k bits, and a range is the union of at most two bins per width. A segment lies in one bin per width, so both
meet by equality, in some 2 log2(2n) rows a range at most. All segments of a bin of a range lie in it, hence of the ranges that share a
bin only the first in order is kept: the right side has one row per bin, and a bin of very many segments is split by its count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from panelweave.operators.ordered import row_numbers, running_last
from panelweave.operators.skew import hot_split_join
from panelweave.session import written

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _number(df: DataFrame, column: str) -> Column:
    """A date as its day number, any other value as a long."""
    c = F.col(column)
    return F.unix_date(c).cast("long") if isinstance(df.schema[column].dataType, DateType) else c.cast("long")


def bins(low: Column, high: Column, bits: int = 63) -> Column:
    """The bins (width as a power of two, number) whose union is the closed range from ``low`` to ``high``.

    Ends of at most ``bits`` bits take fewer steps.
    """
    none = F.array().cast("array<struct<k:int,bin:bigint>>")

    def step(acc: Column, k: Column) -> Column:
        a, b = acc["a"], acc["b"]
        live, last = a <= b, a == b
        odd, even = live & ~last & ((a % 2) != 0), live & ~last & ((b % 2) == 0)
        taken = lambda test, x: F.when(test, F.array(F.struct(k.cast("int").alias("k"), x.alias("bin")))).otherwise(none)
        found = F.concat(acc["found"], taken(live & last | odd, a), taken(even, b))
        # a finished range is marked by a > b
        up, down = F.when(odd, a + 1).otherwise(a), F.when(even, b - 1).otherwise(b)
        over = ~live | last | (up > down)
        return F.struct(
            F.when(over, F.lit(1).cast("long")).otherwise(F.shiftright(up, 1)).alias("a"),
            F.when(over, F.lit(0).cast("long")).otherwise(F.shiftright(down, 1)).alias("b"), found.alias("found"),
        )

    start = F.struct(low.cast("long").alias("a"), high.cast("long").alias("b"), none.alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits)), start, step, lambda acc: acc["found"])


def _segments(sized: DataFrame) -> DataFrame:
    """Begin (``_value``) of every segment between range ends, and ``_range``, the narrowest range there or NULL.

    ``sized`` has a row per pair of ends ``_a`` and ``_b``, with ``_range``.
    """
    after = F.when(F.col("_b") < _MOST, F.col("_b") + 1)
    ends = sized.select(F.explode(F.array(F.struct(F.col("_a").alias("_value"), F.lit(1).alias("_low")), F.struct(after.alias("_value"), F.lit(0).alias("_low")))).alias("_e"))
    ends = ends.select("_e.*").where("_value IS NOT NULL").groupBy("_value").agg(F.sum("_low").alias("_lows"), F.sum(1 - F.col("_low")).alias("_highs"))
    ends = written(row_numbers(ends, ["_value"], "_id").withColumn("_id", F.col("_id") - 1), "range-ends")
    last = ends.count() - 1
    numbered = hot_split_join(sized.withColumn("_after", after), ends.select(F.col("_value").alias("_a"), F.col("_id").alias("_from"), "_lows"), ["_a"], count="_lows")
    # an open end has no segment after it; those rows are kept apart, so that they need not meet in one place
    shut = hot_split_join(
        numbered.where("_after IS NOT NULL").select("_range", "_from", "_after"),
        ends.where("_highs > 0").select(F.col("_value").alias("_after"), F.col("_id").alias("_to"), "_highs"), ["_after"], count="_highs",
    ).select("_range", "_from", (F.col("_to") - 1).alias("_to"))
    spans = shut.unionByName(numbered.where("_after IS NULL").select("_range", "_from", F.lit(last).cast("long").alias("_to")))
    placed = spans.select("_range", F.explode(bins(F.col("_from"), F.col("_to"), max(last, 0).bit_length())).alias("_at"))
    best = written(placed.groupBy(F.col("_at.k").alias("_k"), F.col("_at.bin").alias("_bin")).agg(F.min("_range").alias("_range")), "range-bins")
    widths = sorted(r[0] for r in best.select("_k").distinct().collect())  # at most 64
    keyed = ends.select("_value", "_id", F.explode(F.array(*[F.lit(k) for k in widths]).cast("array<int>")).alias("_k"))
    keyed = keyed.select("_value", "_k", F.expr("shiftright(_id, _k)").alias("_bin"))
    side = keyed.groupBy("_k", "_bin").agg(F.count("*").alias("_n")).join(best, ["_k", "_bin"], "left")
    return hot_split_join(keyed, side, ["_k", "_bin"], count="_n").groupBy("_value").agg(F.min("_range").alias("_range"))


def narrowest_ranges(points: DataFrame, point: str, ranges: DataFrame, low: str, high: str, order: Sequence[str] = ()) -> DataFrame:
    """Every distinct value of ``points[point]`` in a range, with the columns of the narrowest range that holds it.

    Ranges are closed; a missing end is open, and one that ends before it begins holds nothing. Equally narrow ranges go by
    ``order``, then by their other columns. Values are integers of 64 bits or dates. Runs jobs; nothing is broadcast but
    what :func:`hot_split_join` bounds.
    """
    columns = ranges.columns
    a, b = (F.coalesce(_number(ranges, c), F.lit(end)) for c, end in ((low, _LEAST), (high, _MOST)))
    sized = ranges.withColumns({"_a": a, "_b": b}).where("_a <= _b").withColumn("_width", F.col("_b").cast("decimal(20,0)") - F.col("_a").cast("decimal(20,0)"))
    rest = [c for c in columns if c not in order]
    first = F.struct("_width", *order, *rest)
    sized = written(sized.groupBy("_a", "_b").agg(F.min(first).alias("_range")), "range-sides")
    values = points.where(F.col(point).isNotNull()).select(F.col(point), _number(points, point).alias("_value")).distinct()
    # a segment goes before the points at its begin; that of no range ends the one before
    begins = _segments(sized).select(F.lit(None).cast(points.schema[point].dataType).alias(point), "_value", F.lit(0).alias("_kind"), F.struct("_range").alias("_segment"))
    both = begins.unionByName(values.select(point, "_value", F.lit(1).alias("_kind")), allowMissingColumns=True)
    found = running_last(both, ["_value", "_kind"], F.col("_segment"), "_found").where("_kind = 1 AND _found._range IS NOT NULL")
    return found.select(point, *[F.col(f"_found._range.{c}").alias(c) for c in columns])
