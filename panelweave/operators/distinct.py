"""Exact distinct counts over several overlapping groupings at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_counts(df: DataFrame, key: str, groupings: Sequence[Sequence[str]], name: str = "n") -> DataFrame:
    """Distinct non-NULL ``key`` values of every group of every grouping, as one table.

    A row holds the grouping's columns (NULL where a column is not part of it), ``grouping`` (its position in the list) and
    the count. A NULL in a grouping column is a group of its own; ``[]`` is the total, present even without rows.

    Repeated combinations fold before the shuffle, and the rows of a key then meet once, whatever the number of groupings. There
    the first row of the key in each group is marked; a key lies in one partition only, so marks simply add up, and only
    sums per task and group are shuffled again. ``count(DISTINCT ...)`` over grouping sets shuffles every
    combination once per set instead.
    """
    sets = [list(dict.fromkeys(g)) for g in groupings]
    columns = list(dict.fromkeys(c for g in sets for c in g))
    dims = {c: f"_d{i}" for i, c in enumerate(columns)}
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *[F.col(c).alias(d) for c, d in dims.items()])
    rows = rows.distinct().repartition("_key")

    def first(group: list[str]) -> Column:
        rest = [d for c, d in dims.items() if c not in group]
        inside = Window.partitionBy("_key", *[dims[c] for c in group])
        return F.row_number().over(inside.orderBy(*rest)) == 1 if rest else F.lit(True)

    marked = rows.select(*dims.values(), *[first(g).alias(f"_f{i}") for i, g in enumerate(sets)])
    cells = [
        F.when(F.col(f"_f{i}"), F.struct(F.lit(i).alias("grouping"), *[
            (F.col(d) if c in g else F.lit(None).cast(df.schema[c].dataType)).alias(d) for c, d in dims.items()]))
        for i, g in enumerate(sets)
    ]
    each = marked.select(F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("_c")).select("_c.*")
    out = each.groupBy("grouping", *dims.values()).agg(F.count("*").alias(name))
    empty = [i for i, g in enumerate(sets) if not g]
    if empty:  # the total of no rows is a row as well
        totals = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(i) for i in empty])).alias("grouping"), *[
            F.lit(None).cast(df.schema[c].dataType).alias(d) for c, d in dims.items()], F.lit(0).cast("long").alias(name))
        out = out.unionByName(totals).groupBy("grouping", *dims.values()).agg(F.sum(name).alias(name))
    return out.select("grouping", *[F.col(d).alias(c) for c, d in dims.items()], name)
