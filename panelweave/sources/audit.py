"""Completeness checks of converted data and the conversion ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.sources.transactions import rejection

def missing_columns(df: DataFrame, expected: Sequence[str]) -> list[str]:
    """Expected columns a frame lacks; reads the schema only."""
    have = set(df.columns)
    return [c for c in expected if c not in have]


def wrong_key_counts(df: DataFrame, key: str, expected: str) -> DataFrame:
    """Per expected key: rows, and rows whose own key differs or is NULL."""
    differs = ~F.col(key).eqNullSafe(F.col(expected))
    return df.groupBy(expected).agg(F.count("*").alias("n"), F.count_if(differs).alias("n_wrong"))


def audit(df: DataFrame, key: str, expected: str, columns: Sequence[str]) -> DataFrame:
    """Per partition: rows, wrong keys, missing columns, and whether it counts as complete."""
    missing = missing_columns(df, columns)
    counts = wrong_key_counts(df, key, expected)
    complete = (F.col("n") > 0) & (F.col("n_wrong") == 0) & F.lit(not missing)
    return counts.withColumn("missing_columns", F.lit(",".join(missing))).withColumn("complete", complete)


def not_yet_done(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files without a finished entry in the ledger."""
    done = ledger.where(F.col("status").isin("converted", "empty")).select("source_file")
    return files.join(done, "source_file", "left_anti")


def ledger_rows(raw: DataFrame, probed: DataFrame, key: str = "cycle", file_key: Column | None = None) -> DataFrame:
    """One ledger row per probed file: lines, encoding, rows written, rejected by reason and with another key, status.

    ``raw`` are the text rows as read; rows that :func:`rejection` names count as rejected, the others as
    written. ``file_key`` is the key the file name states. A file without a key is ``failed``, one with rows of
    another key ``wrong_key``, one without a written row ``empty``, all others ``converted``.
    """
    stated = F.col(key).try_cast("bigint")
    why = rejection(raw, key)
    expected = file_key if file_key is not None else F.lit(None).cast("bigint")
    judged = raw.select("source_file", stated.alias("_key"), why.alias("_why"), expected.alias("_file_key"))
    good = F.col("_why").isNull()
    counts = judged.groupBy("source_file").agg(
        F.max(F.when(good, F.col("_key"))).alias("_row_key"),
        F.count_if(good).alias("n_written"),
        F.count_if(F.col("_why") == "long").alias("n_long"),
        F.count_if(F.col("_why") == "key").alias("n_bad_key"),
        F.count_if(good & F.col("_file_key").isNotNull() & (F.col("_key") != F.col("_file_key"))).alias("n_wrong"),
    )
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    own = file_key if file_key is not None else F.col("_row_key")
    joined = probed.join(counts, "source_file", "left").withColumn("_own", own)
    status = F.when(F.lit(file_key is not None) & F.col("_own").isNull(), "failed")
    status = status.when(F.col("n_wrong") > 0, "wrong_key").when(F.coalesce("n_written", F.lit(0)) == 0, "empty").otherwise("converted")
    return joined.select(
        "source_file", F.col("_own").alias(key), "n_lines", (~F.col("is_utf8")).alias("transcoded"),
        *[number(c) for c in ("n_written", "n_long", "n_bad_key", "n_wrong")], status.alias("status"),
    )
