"""Documents with the awkward cases every operator must take, and small references."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{i % 977}x{i % 1231}" for i in range(20_000))
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "Same  text\nhere again", "en", "a", 1),
    (5, "Same text here again", "en", None, 1), (6, "Same text here again", None, "b", 1), (7, "x", "de", "b", 1),
    (7, "x", "de", "b", 1), (8, LONG, "en", "c", len(LONG)), (9, LONG[:-7] + "another", "fr", "c", 1), (10, "é😀 漢字 ½ ﬁ İ", None, "d", 1),
    (11, "12 34 !!", "en", "d", 1), (None, "no id here at all", "en", "d", 1), (None, None, None, None, None), (12, "a" * 3000, "es", "d", 1),
]
#: Columns named like those the operators make.
CLASHING = ("keep_id", "kept", "run", "digest", "score", "bucket", "rep", "hub", "block", "epoch", "own", "row", "spans", "terms", "weight", "label")


def odd(spark, rows=ODD):
    """The awkward rows, with further columns whose names clash with columns the operators make."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in CLASHING:
        df = df.selectExpr("*", f"'other' AS {name}")
    return df


def table(spark, sf="0.001"):
    return spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
