"""Scalar rules for amounts, cycles, flags and dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Transaction types that count towards a score, and the industries called "tech".
SCORE_TXN_TYPES = ("15", "15E", "15J", "15S", "15L", "24E", "24P")
TECH_INDUSTRIES = ("Softw", "Hardw", "Chips")
BUSINESS_EQUIPMENT = "BusEq"


def amount_weight(amount: Column, unit: float = 100.0, ceiling: float = 5000.0) -> Column:
    """Contribution weight: number of started units, flat from ``ceiling`` on, 0 for refunds, NULL for NULL."""
    return (
        F.when(amount <= 0, F.lit(0.0))
        .when(amount < ceiling, F.ceil(amount / unit).cast("double"))
        .when(amount >= ceiling, F.lit(ceiling / unit))
    )


def counts_for_score(person: Column, score: Column, txn_type: Column) -> Column:
    """True where a transaction enters the weighted score; never NULL."""
    return person.isNotNull() & score.isNotNull() & F.coalesce(txn_type.isin(*SCORE_TXN_TYPES), F.lit(False))


def even_cycle(year: Column) -> Column:
    """Election cycle of a year: the even year at or after it."""
    return year + year % 2


def tech_flag(industry: Column, codes: Sequence[str] = TECH_INDUSTRIES) -> Column:
    """True for the given industries, False for any other and for NULL."""
    return F.coalesce(industry.isin(*codes), F.lit(False))


def business_equipment_flag(industry: Column) -> Column:
    """True for business equipment; NULL stays NULL."""
    return industry == BUSINESS_EQUIPMENT


def insider_now(is_insider: Column, cycle: Column, first_cycle: Column, last_cycle: Column, grace: int = 2) -> Column:
    """True while the cycle lies in the insider spell plus a grace period; False when not an insider.

    Unmatched rows carry NULL bounds, and ``false and NULL`` is false, so they come out False.
    """
    return is_insider & (cycle >= first_cycle) & (cycle <= last_cycle + grace)


def filing_date(text: Column) -> Column:
    """``31-Jan-2020`` to a date, NULL where it does not parse."""
    return F.try_to_date(F.trim(text), "dd-MMM-yyyy")


def clean_ticker(text: Column) -> Column:
    """Upper-case ticker, NULL for the placeholder ``NONE``."""
    return F.nullif(F.upper(F.trim(text)), F.lit("NONE"))


def padded_id(value: Column, width: int = 10) -> Column:
    """Register number as zero-padded text, the join form on both sides."""
    return F.lpad(value.cast("string"), width, "0")
