"""Reproducible samples of an exact size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.session import written

_DIGITS = 8  # leading hex digits that are compared as a number


def sample_rows(df: DataFrame, n: int, key: str, seed: int | str = 123) -> DataFrame:
    """The ``n`` rows whose hashed key is smallest; ``key`` must be unique.

    The order is the md5 of seed and key, so the same rows come out on every run and any engine. Hashes are
    uniform: of N rows, those below a share n / N plus six standard errors hold the n smallest all but certainly.
    They are written (this runs jobs) and only they are sorted. Should they be too few, the share is doubled.
    """
    whole = df.count()
    hashed = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    place = F.conv(F.substring("_h", 1, _DIGITS), 16, 10).cast("long")
    share = min(1.0, (n + 6 * math.sqrt(n) + 20) / max(whole, 1))
    while True:
        low = written(hashed.where(place < math.ceil(share * 16**_DIGITS)), "sample")
        if share >= 1.0 or low.count() >= n:
            return low.orderBy("_h", key).limit(n).select(*df.columns)
        share = min(1.0, 2 * share)


def sample_ids(df: DataFrame, key: str, n: int, seed: int | str = 123) -> DataFrame:
    """``n`` distinct non-NULL ids."""
    return sample_rows(df.where(F.col(key).isNotNull()).select(key).distinct(), n, key, seed)


def rows_of_sampled_ids(df: DataFrame, key: str, n: int, seed: int | str = 123) -> DataFrame:
    """All rows of ``n`` sampled ids."""
    return df.join(sample_ids(df, key, n, seed), key, "left_semi")
