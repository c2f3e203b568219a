"""Company profiles, insider filings and small lookup tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILE_SCHEMA = "cik string, name string, sic string, sicDescription string"


def read_profiles(spark: SparkSession, path: str | list[str], one_per_file: bool = True) -> DataFrame:
    """Company profiles as JSON, one document per file or per line; broken documents are skipped.

    Only the four named fields are parsed. Blank codes become NULL; a profile needs a name.
    """
    reader = spark.read.schema(PROFILE_SCHEMA).option("multiLine", one_per_file).option("mode", "PERMISSIVE")
    docs = reader.json(path)
    return docs.where(F.col("name").isNotNull()).select(
        F.col("cik").try_cast("int").alias("cik"),
        F.col("name").alias("real_name"),
        F.nullif("sic", F.lit("")).alias("sic"),
        F.nullif("sicDescription", F.lit("")).alias("sic_description"),
    )


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """One unquoted tab-separated file set with a header, all text; a malformed row is an error."""
    return (
        spark.read.option("sep", "\t")
        .option("header", True)
        .option("quote", "")
        .option("escape", "")
        .option("inferSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_tsv_union(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several file sets united by column name; a column one of them lacks is NULL there."""
    parts = [read_tsv(spark, p) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_lookup(df: DataFrame, path: str) -> None:
    """A small lookup as CSV and as parquet."""
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    df.write.mode("overwrite").parquet(f"{path}/parquet")


def read_lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A lookup written by :func:`write_lookup`, from its CSV, with an explicit schema."""
    return spark.read.schema(schema).option("header", True).csv(f"{path}/csv")


def read_processed(spark: SparkSession, root: str, sample: bool = False) -> DataFrame:
    """A processed table, or its sample twin next to it."""
    return spark.read.parquet(f"{root}_sample" if sample else root)
