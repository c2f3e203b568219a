"""Aggregates that pick one value of a group by an order, skipping NULLs per column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _order_key(value: Column, order: tuple[Column, ...], required: int) -> Column:
    """The order as a struct, NULL (so the row is skipped) where the value or a required key is NULL."""
    present = reduce(lambda a, b: a & b, (c.isNotNull() for c in order[:required]), value.isNotNull())
    return F.when(present, F.struct(*order))


def first_by(value: Column, *order: Column, required: int = 1) -> Column:
    """Value at the smallest order key among rows where value and the first keys are non-NULL.

    ``min_by`` alone returns NULL when the value at the minimum is NULL; the guarded key makes each
    column pick its own earliest known value. Keys after ``required`` only break ties.
    """
    return F.min_by(value, _order_key(value, order, required))


def last_by(value: Column, *order: Column, required: int = 1) -> Column:
    """Value at the largest order key among rows where value and the first keys are non-NULL."""
    return F.max_by(value, _order_key(value, order, required))


def longest(value: Column) -> Column:
    """The longest text of the group; equal lengths resolve to the alphabetically last."""
    return F.max_by(value, F.when(value.isNotNull(), F.struct(F.length(value), value)))
