"""Registered queries: readers, writers, audits and incremental conversion.

Source files are derived from the tables by Spark, with the defects real files have, into the shared
folder; each query then reads them back the way a user would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators import panel
from panelweave.plans import bind
from panelweave.plans.bind import TARGETS, role_sql, table
from panelweave.plans.registry import query, r6, rounded
from panelweave.session import shared_path
from panelweave.sources import audit, registers, transactions
from panelweave.streaming.incremental import convert_new_files, read_converted

COLUMNS = ("cycle", "txn_id", "amount", "date", "cid", "employer", "city")
TYPES = {"amount": "double", "date": "date", "cid": "bigint", "txn_id": "bigint"}
PATTERN = r"file=contrib_(\d{4})"


LATIN = 1996  # the files of this cycle are not UTF-8


def _raw_lines(spark: SparkSession, d: str) -> DataFrame:
    """CSV records of the transactions, dirty by rule, with the file they go to."""
    t = bind.transactions(spark, d)
    k = F.col("txn_id")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\\N"))
    quoted = lambda *parts: F.concat(F.lit('"'), *parts, F.lit('"'))
    employer = (
        F.when(F.col("employer").isNull(), "\\N")
        .when(k % 19 == 0, quoted("employer", F.lit("\\\nDivision")))
        .when(k % 23 == 0, quoted(F.lit('The ""Big"", '), "employer"))
        .when(k % 71 == 0, quoted("employer", F.lit("\\")))
        .when(F.col("employer").contains(","), quoted("employer"))
        .when(k % 17 == 0, F.concat("employer", F.lit("\\")))
        .otherwise(F.col("employer"))
    )
    place = F.concat("city", F.when(k % 31 == 0, " Zürich").otherwise(""))
    city = (
        F.when(k % 29 == 0, "").when(k % 73 == 0, quoted(place, F.lit("\\"))).when(k % 37 == 0, F.concat(place, F.lit("\\"))).otherwise(place)
    )
    fields = [
        F.when(k % 101 == 0, "bad").otherwise(F.col("cycle").cast("string")),
        k.cast("string"),
        F.when(k % 47 == 0, "n/a").otherwise(text("amount")),
        text("date"), text("cid"), employer,
    ]
    line = F.concat_ws(",", *fields)
    line = F.when(k % 61 == 0, line).when(k % 67 == 0, F.concat_ws(",", line, city, F.lit("extra"))).otherwise(F.concat_ws(",", line, city))
    value = F.when(F.col("cycle") == LATIN, F.encode(line, "ISO-8859-1").cast("string")).otherwise(line)
    return t.select(value.alias("value"), F.concat(F.lit("contrib_"), F.col("cycle")).alias("file"), "cycle")


# what the fields must come to: a backslash stays unless it ends a line, outside quotes or before a break inside them
_EMPLOYER = """CASE WHEN employer IS NULL THEN NULL WHEN txn_id % 19 = 0 THEN employer || chr(10) || 'Division' WHEN txn_id % 23 = 0 THEN 'The "Big", ' || employer
    WHEN txn_id % 71 = 0 THEN employer || chr(92) WHEN contains(employer, ',') THEN employer WHEN txn_id % 17 = 0 AND txn_id % 61 <> 0 THEN employer || chr(92) ELSE employer END"""
_CITY = """CASE WHEN txn_id % 61 = 0 THEN NULL WHEN txn_id % 29 = 0 THEN '' ELSE city || CASE WHEN txn_id % 31 = 0 THEN ' Zürich' ELSE '' END
    || CASE WHEN txn_id % 73 = 0 THEN chr(92) ELSE '' END END"""
_LONG = "(txn_id % 67 = 0 AND txn_id % 61 <> 0)"
_LINES = "CAST(sum(CASE WHEN txn_id % 19 = 0 AND employer IS NOT NULL THEN 2 ELSE 1 END) AS BIGINT)"
_SRC = "src AS (SELECT * FROM txn)"


def _files(spark: SparkSession, d: str) -> str:
    path = shared_path(spark, "dirty")
    _raw_lines(spark, d).select("value", "file").write.partitionBy("file").text(path)
    return path


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    return transactions.read_files(spark, f"{_files(spark, d)}/file=*", COLUMNS, header=False)


@query("src_dirty_csv", role_sql("txn", extra=_SRC) + """ SELECT CASE WHEN txn_id % 61 = 0 THEN 'short' WHEN txn_id % 67 = 0 THEN 'long' ELSE 'ok' END AS row_state,
    count(*) AS n, count(CASE WHEN txn_id % 61 = 0 THEN NULL ELSE 1 END) AS n_city, count(cid) AS n_cid, count(date) AS n_date FROM src GROUP BY 1""")
def _(spark, d):
    return _dirty(spark, d).groupBy("row_state").agg(
        F.count("*").alias("n"), F.count("city").alias("n_city"), F.count("cid").alias("n_cid"), F.count("date").alias("n_date")
    )


@query("src_repair_lines", role_sql("txn", extra=_SRC) + f""" SELECT txn_id, {_EMPLOYER} AS employer, {_CITY} AS city FROM src WHERE NOT {_LONG}""")
def _(spark, d):
    rows = _dirty(spark, d).where("row_state <> 'long'")
    return rows.select(F.col("txn_id").cast("bigint").alias("txn_id"), "employer", "city")


_TYPED = f"""SELECT cycle, txn_id, CASE WHEN txn_id % 47 = 0 THEN NULL ELSE amount END AS amount, date, cid, {_EMPLOYER} AS employer, {_CITY} AS city
    FROM src WHERE txn_id % 101 <> 0 AND NOT {_LONG}"""


@query("src_typed_project", role_sql("txn", extra=_SRC) + f" SELECT * REPLACE (round(amount, 6) AS amount) FROM ({_TYPED})")
def _(spark, d):
    return rounded(transactions.typed(_dirty(spark, d), TYPES).drop("source_file"), "amount")


@query("src_probe_files", role_sql("txn", extra=_SRC) + f" SELECT cycle, {_LINES} AS n_lines, cycle <> {LATIN} AS is_utf8 FROM src GROUP BY cycle")
def _(spark, d):
    probed = transactions.probe_files(spark, f"{_files(spark, d)}/file=*")
    return probed.groupBy(transactions.key_from_path(F.col("source_file"), PATTERN).alias("cycle")).agg(
        F.sum("n_lines").alias("n_lines"), F.bool_and("is_utf8").alias("is_utf8")
    )


def _typed_with_key(spark, d) -> DataFrame:
    rows = transactions.typed(_dirty(spark, d), TYPES)
    return rows.withColumn("file_cycle", transactions.key_from_path(F.col("source_file"), PATTERN))


@query("ing_key_from_path", role_sql("txn", extra=_SRC) + f" SELECT cycle AS file_cycle, count(*) AS n FROM ({_TYPED}) GROUP BY cycle")
def _(spark, d):
    return _typed_with_key(spark, d).groupBy("file_cycle").agg(F.count("*").alias("n"))


@query("ing_audit", role_sql("txn", extra=_SRC) + f" SELECT cycle AS file_cycle, count(*) AS n, CAST(0 AS BIGINT) AS n_wrong, 'latitude' AS missing_columns, FALSE AS complete FROM ({_TYPED}) GROUP BY cycle")
def _(spark, d):
    return audit.audit(_typed_with_key(spark, d), "cycle", "file_cycle", [*COLUMNS, "latitude"])


@query("agg_filter_count", role_sql("txn") + """ SELECT cycle, count(*) AS n, count(*) FILTER (WHERE CAST(year(date) AS BIGINT) IS DISTINCT FROM cycle) AS n_wrong FROM txn GROUP BY cycle""")
def _(spark, d):
    rows = bind.transactions(spark, d).withColumn("year", F.year("date").cast("bigint")).withColumn("expected", F.col("cycle"))
    return audit.wrong_key_counts(rows, "year", "expected").withColumnRenamed("expected", "cycle")


_COUNTS = f"""SELECT cycle, {_LINES} AS n_lines, cycle = {LATIN} AS transcoded, count(*) FILTER (WHERE txn_id % 101 <> 0 AND NOT {_LONG}) AS n_written,
    count(*) FILTER (WHERE {_LONG}) AS n_long, count(*) FILTER (WHERE txn_id % 101 = 0 AND NOT {_LONG}) AS n_bad_key FROM src GROUP BY cycle"""


def _per_cycle(entries: DataFrame) -> DataFrame:
    counts = ("n_lines", "n_written", "n_long", "n_bad_key")
    return entries.groupBy("cycle").agg(*[F.sum(c).alias(c) for c in counts], F.bool_or("transcoded").alias("transcoded"), F.min("status").alias("status"))


@query("ing_ledger", role_sql("txn", extra=_SRC) + f" SELECT *, 'converted' AS status FROM ({_COUNTS})")
def _(spark, d):
    path = f"{_files(spark, d)}/file=*"
    survey = transactions.survey_files(spark, path)
    rows = transactions.read_files(spark, path, COLUMNS, header=False, survey=survey)
    return _per_cycle(audit.ledger_rows(rows, transactions.file_totals(survey), file_key=transactions.key_from_path(F.col("source_file"), PATTERN)))


@query("ing_incremental", role_sql("txn", extra=_SRC) + f""" SELECT c.*, 'converted' AS status, n_umlaut, n_backslash, CASE WHEN cycle <= 1998 THEN 1 ELSE 2 END AS pass FROM ({_COUNTS}) c
    JOIN (SELECT cycle, count(*) FILTER (WHERE city LIKE '%ü%') AS n_umlaut, count(*) FILTER (WHERE contains(employer, chr(92))) AS n_backslash FROM ({_TYPED}) GROUP BY cycle) USING (cycle)""")
def _(spark, d):
    root = shared_path(spark, "incremental")
    source, target, ledger, state = (f"{root}/{p}" for p in ("source", "target", "ledger", "state"))
    lines = _raw_lines(spark, d)
    seen = None
    for number, arrived in ((1, lines.where("cycle <= 1998")), (2, lines.where("cycle > 1998")), (3, None)):
        if arrived is not None:
            arrived.select("value", "file").write.mode("append").partitionBy("file").text(source)
        convert_new_files(spark, f"{source}/file=*", target, ledger, state, COLUMNS, types=TYPES, pattern=PATTERN, header=False)
        entries = spark.read.parquet(ledger).drop("batch")
        new = entries if seen is None else entries.join(seen.select("source_file"), "source_file", "left_anti")
        new.withColumn("pass", F.lit(number)).write.parquet(f"{root}/passes/pass_number={number}")
        seen = spark.read.parquet(f"{root}/passes").drop("pass_number")
    rows = read_converted(spark, target, COLUMNS, types=TYPES)
    stored = rows.groupBy("cycle").agg(
        F.count_if(F.col("city").contains("ü")).alias("n_umlaut"), F.count_if(F.col("employer").contains("\\")).alias("n_backslash")
    )
    return stored.join(_per_cycle(seen), "cycle").join(seen.groupBy("cycle").agg(F.max("pass").alias("pass")), "cycle")


@query("ing_partition_summary", role_sql("txn") + " SELECT cycle, count(*) AS n_rows FROM txn GROUP BY cycle ORDER BY cycle")
def _(spark, d):
    return transactions.partition_summary(bind.transactions(spark, d))


def _stored(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    path, rows = shared_path(spark, "hive"), bind.transactions(spark, d)
    transactions.write_partitioned(rows, path, "cycle")
    return path, rows


@query("src_hive_read", role_sql("txn") + " SELECT cycle, 'bigint' AS key_type, count(*) AS n, round(sum(amount), 4) AS total FROM txn WHERE cycle IN (1998, 2002) GROUP BY cycle")
def _(spark, d):
    path, rows = _stored(spark, d)
    back = transactions.read_partitioned(spark, path, rows.schema).where(F.col("cycle").isin(*TARGETS))
    return back.groupBy("cycle").agg(F.typeof(F.first("cycle")).alias("key_type"), F.count("*").alias("n"), r6(F.sum("amount"), 4).alias("total"))


@query("snk_partitioned", role_sql("txn") + " SELECT cycle, count(*) AS n, count(DISTINCT txn_id) AS n_ids, CASE WHEN cycle = 2000 THEN 'second' ELSE 'first' END AS written FROM txn GROUP BY cycle")
def _(spark, d):
    path, rows = shared_path(spark, "partitioned"), bind.transactions(spark, d)
    transactions.write_partitioned(rows.withColumn("written", F.lit("first")), path, "cycle")
    # a second write replaces the one partition it holds and leaves the others alone
    again = rows.where("cycle = 2000").withColumn("written", F.lit("second"))
    transactions.write_partitioned(again, path, "cycle")
    back = transactions.read_partitioned(spark, path, again.schema)
    return back.groupBy("cycle", "written").agg(F.count("*").alias("n"), F.countDistinct("txn_id").alias("n_ids"))


@query("snk_zstd", role_sql("txn") + " SELECT state, count(*) AS n, TRUE AS zstd FROM txn GROUP BY state")
def _(spark, d):
    path, rows = shared_path(spark, "zstd"), bind.transactions(spark, d)
    transactions.write_partitioned(rows, path, "state", compression="zstd")
    back = spark.read.parquet(path).select("state", F.col("_metadata.file_name").alias("f"))
    return back.groupBy("state").agg(F.count("*").alias("n"), F.bool_and(F.col("f").endswith(".zstd.parquet")).alias("zstd"))


@query("src_arrow_dataset", role_sql("panel") + " SELECT state, count(*) AS n, count(DISTINCT cid) AS n_people FROM panel GROUP BY state")
def _(spark, d):
    root = shared_path(spark, "processed")
    rows = panel.person_cycle_panel(bind.transactions(spark, d), TARGETS)
    transactions.write_partitioned(rows, f"{root}_sample", "cycle")
    back = registers.read_processed(spark, root, sample=True)
    return back.groupBy("state").agg(F.count("*").alias("n"), F.countDistinct("cid").alias("n_people"))


@query("src_json_profiles", """SELECT CAST(p_partkey AS INTEGER) AS cik, p_name AS real_name, nullif(CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END, '') AS sic,
    nullif(CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END, '') AS sic_description FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 41 <> 0""")
def _(spark, d):
    p = table(spark, d, "part")
    doc = F.to_json(
        F.struct(
            F.lpad(F.col("p_partkey").cast("string"), 10, "0").alias("cik"),
            F.when(F.col("p_partkey") % 11 != 0, F.col("p_name")).alias("name"),
            F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_size").cast("string")).alias("sic"),
            F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_type")).alias("sicDescription"),
            F.array("p_brand").alias("formerNames"),
        )
    )
    path = shared_path(spark, "profiles")
    p.select(F.when(F.col("p_partkey") % 41 == 0, '{"cik": "00').otherwise(doc).alias("value")).write.text(path)
    return registers.read_profiles(spark, path, one_per_file=False)


@query("src_tsv_union", role_sql("owner", "submission") + """ SELECT ACCESSION_NUMBER, RPTOWNERCIK, RPTOWNERNAME, RPTOWNER_TITLE FROM (
    SELECT ACCESSION_NUMBER, RPTOWNERCIK, RPTOWNERNAME, CASE WHEN CAST(ACCESSION_NUMBER AS BIGINT) % 2 = 0 THEN nullif(RPTOWNER_TITLE, '') END AS RPTOWNER_TITLE FROM owner)""")
def _(spark, d):
    rows = bind.owners(spark, d).select("ACCESSION_NUMBER", "RPTOWNERCIK", "RPTOWNERNAME", "RPTOWNER_TITLE")
    root = shared_path(spark, "tsv")
    even = F.col("ACCESSION_NUMBER").cast("bigint") % 2 == 0
    for name, part in (("a", rows.where(even)), ("b", rows.where(~even).drop("RPTOWNER_TITLE"))):
        part.write.options(sep="\t", header=True, quote="", escape="", emptyValue="", ignoreTrailingWhiteSpace=False).csv(f"{root}/{name}")
    return registers.read_tsv_union(spark, [f"{root}/a", f"{root}/b"])


@query("src_lookup_csv", "SELECT p_size, p_type, count(*) AS n FROM part GROUP BY 1, 2")
def _(spark, d):
    path = shared_path(spark, "lookup")
    registers.write_lookup(table(spark, d, "part").groupBy("p_size", "p_type").agg(F.count("*").alias("n")), path)
    return registers.read_lookup(spark, path, "p_size int, p_type string, n bigint")
