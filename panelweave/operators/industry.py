"""Industry codes: interval joins, residual buckets and the multi-scheme crosswalk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators.skew import hot_split_join

SCHEMES = (12, 48, 49)
CODE_MIN, CODE_MAX = 100, 9999  # fixed values: first and last four-digit code


def points_of_ranges(ranges: DataFrame, low: str, high: str, attributes: Sequence[str],
                     domain: tuple[int, int] = (CODE_MIN, CODE_MAX)) -> DataFrame:
    """One row per covered code with the narrowest range that covers it.

    Codes live in a small closed domain, so intervals become points: at most one row per code of the
    domain is left, which bounds the lookup. Equal widths resolve by ``attributes``, then by start.
    """
    lo, hi = (F.greatest(F.col(low), F.lit(domain[0])), F.least(F.col(high), F.lit(domain[1])))
    points = (
        ranges.where(F.col(low).isNotNull() & (lo <= hi))
        .withColumn("code", F.explode(F.sequence(lo, hi)))
        .withColumn("_w", F.col(high) - F.col(low))
    )
    best = points.groupBy("code").agg(F.min(F.struct("_w", *attributes, F.col(low).alias("_from"))).alias("_b"))
    return best.select("code", *[F.col(f"_b.{a}").alias(a) for a in attributes])


def range_lookup(df: DataFrame, code: str, ranges: DataFrame, low: str, high: str, attributes: Sequence[str]) -> DataFrame:
    """Left join ``df[code] BETWEEN low AND high``, narrowest range only.

    The lookup holds at most one row per code of the closed domain and is broadcast for that reason.
    """
    points = points_of_ranges(ranges, low, high, attributes).withColumnRenamed("code", "_code")
    return df.join(F.broadcast(points), F.col(code) == F.col("_code"), "left").drop("_code")


def residual_bucket(definitions: DataFrame, scheme: int) -> DataFrame:
    """The highest-numbered industry of a scheme, which takes all codes without a range."""
    d = definitions.where(F.col("scheme") == scheme)
    return d.orderBy(F.desc("ff_num"), "ff_abbr").select("ff_num", "ff_abbr", "ff_name").limit(1)


def assign_scheme(codes: DataFrame, definitions: DataFrame, scheme: int, code: str = "sic_int") -> DataFrame:
    """Industry of every row of ``codes`` in one scheme, the residual bucket where no range applies.

    Columns are named after the scheme: ``ff12``, ``ff12_abbr``, ``ff12_name``, ``ff12_detail`` and
    ``ff12_explicit`` (False for the residual).
    """
    attributes = ["ff_num", "ff_abbr", "ff_name", "range_desc"]
    d = definitions.where(F.col("scheme") == scheme)
    joined = range_lookup(codes, code, d, "sic_from", "sic_to", attributes)
    rest = residual_bucket(definitions, scheme)
    explicit = F.col("ff_num").isNotNull()
    filled = {c: F.when(explicit, F.col(c)).otherwise(rest.select(c).scalar()) for c in attributes[:3]}
    return joined.select(
        *codes.columns,
        filled["ff_num"].alias(f"ff{scheme}"),
        filled["ff_abbr"].alias(f"ff{scheme}_abbr"),
        filled["ff_name"].alias(f"ff{scheme}_name"),
        F.col("range_desc").alias(f"ff{scheme}_detail"),
        explicit.alias(f"ff{scheme}_explicit"),
    )


def code_universe(spark: SparkSession) -> DataFrame:
    """All four-digit codes."""
    return spark.range(CODE_MIN, CODE_MAX + 1).select(F.col("id").cast("int").alias("sic_int"))


def first_per_code(sic_list: DataFrame) -> DataFrame:
    """One row per code of a published code list, the first by office and title."""
    first = sic_list.where(F.col("sic_int").isNotNull()).groupBy("sic_int").agg(
        F.min(F.struct("sec_office", "sec_title")).alias("_f")
    )
    return first.select("sic_int", "_f.sec_office", "_f.sec_title")


def crosswalk(definitions: DataFrame, sic_list: DataFrame, schemes: Sequence[int] = SCHEMES) -> DataFrame:
    """Every code with its industry in each scheme and its entry in the published list."""
    out = code_universe(definitions.sparkSession).join(first_per_code(sic_list), "sic_int", "left")
    for scheme in schemes:
        out = assign_scheme(out, definitions, scheme)
    industry = [c for c in out.columns if c.startswith("ff") and c not in ("ff12_detail", "ff48_detail")]
    return out.select(
        F.lpad(F.col("sic_int").cast("string"), 4, "0").alias("sic"),
        "sic_int",
        F.col("sec_title").isNotNull().alias("in_sec"),
        "sec_office", "sec_title",
        *industry,
    ).withColumnsRenamed({"ff49_detail": "sic_detail"})


def residual_counts(lookup: DataFrame, schemes: Sequence[int] = SCHEMES) -> DataFrame:
    """Listed codes per scheme that fell into the residual bucket."""
    return lookup.where("in_sec").agg(
        *[F.count_if(~F.col(f"ff{s}_explicit")).alias(f"ff{s}_explicit") for s in schemes]
    )


def check_crosswalk(lookup: DataFrame) -> DataFrame:
    """The crosswalk's invariants as one row of Booleans."""
    return lookup.agg(
        (F.count("*") == CODE_MAX - CODE_MIN + 1).alias("complete"),
        *[(F.count_if(F.col(f"ff{s}").isNull()) == 0).alias(f"ff{s}_filled") for s in SCHEMES],
        (F.countDistinct("ff12") <= 12).alias("ff12_in_range"),
        (F.countDistinct("ff49") <= 49).alias("ff49_in_range"),
    )


def attach_industries(df: DataFrame, lookup: DataFrame, code: str = "sic") -> DataFrame:
    """Left join listed codes' industries, a row per code.

    A code may hold a large share of the rows: their salts keep it apart (see ``skew.hot_split_join``, which
    runs a job). A lookup of the usual size is broadcast by the planner.
    """
    listed = lookup.where("in_sec").withColumnRenamed("sic", code)
    rows = df.groupBy(code).agg(F.count("*").alias("_rows"))
    known = rows.join(listed, code, "left")
    return hot_split_join(df, known, [code], count="_rows").drop("_rows")
