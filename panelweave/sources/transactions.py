"""Bulk transaction files: dirty CSV in, typed and partitioned parquet out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from panelweave.session import written
from panelweave.sources.split_csv import MOST_BLOCKS, block_states, csv_records

# Source columns in file order, the names they get here, and the typed ones.
SOURCE_NAMES: Mapping[str, str] = {
    "cycle": "cycle",
    "transaction.id": "txn_id",
    "transaction.type": "txn_type",
    "amount": "amount",
    "date": "date",
    "bonica.cid": "cid",
    "contributor.name": "name",
    "contributor.lname": "lname",
    "contributor.fname": "fname",
    "contributor.mname": "mname",
    "contributor.suffix": "suffix",
    "contributor.title": "title",
    "contributor.ffname": "ffname",
    "contributor.type": "contributor_type",
    "contributor.gender": "gender",
    "contributor.address": "address",
    "contributor.city": "city",
    "contributor.state": "state",
    "contributor.zipcode": "zipcode",
    "contributor.occupation": "occupation",
    "contributor.employer": "employer",
    "occ.standardized": "occ_standardized",
    "is.corp": "is_corp",
    "recipient.name": "recipient_name",
    "bonica.rid": "recipient_id",
    "recipient.party": "recipient_party",
    "recipient.type": "recipient_type",
    "recipient.state": "recipient_state",
    "seat": "seat",
    "election.type": "election_type",
    "latitude": "latitude",
    "longitude": "longitude",
    "gis.confidence": "gis_confidence",
    "contributor.district": "contributor_district",
    "censustract": "censustract",
    "efec.memo": "efec_memo",
    "efec.memo2": "efec_memo2",
    "efec.transaction.id.orig": "efec_transaction_id_orig",
    "bk.ref.transaction.id": "bk_ref_transaction_id",
    "efec.org.orig": "efec_org_orig",
    "efec.comid.orig": "efec_comid_orig",
    "efec.form.type": "efec_form_type",
    "excluded.from.scaling": "excluded_from_scaling",
    "contributor.cfscore": "contributor_score",
    "candidate.cfscore": "candidate_score",
}
TYPED: Mapping[str, str] = {
    "amount": "double", "date": "date", "cid": "bigint", "latitude": "double", "longitude": "double",
    "gis_confidence": "double", "excluded_from_scaling": "bigint", "contributor_score": "double",
    "candidate_score": "double",
}
NULL_TOKEN = "\\N"
CORRUPT = "_corrupt_record"
_BEYOND = "_beyond"
_UNSET = "\u0001"
_BYTES = "ISO-8859-1"  # every byte is one character, so text read this way can be decoded again


def text_schema(columns: Sequence[str], corrupt: bool = False) -> StructType:
    """All columns as text, optionally with one column too many and the one that receives the record.

    A record that lacks a field counts as malformed, and only such records are handed over whole. With
    one column more than the file has, that is every record of the right or a smaller length.
    """
    names = [*columns, _BEYOND, CORRUPT] if corrupt else list(columns)
    return StructType([StructField(n, StringType()) for n in names])


def repaired(text: Column, ends_record: Column) -> Column:
    """Remove a backslash at the end of each physical line of a field.

    The source escapes a line break inside quotes with a backslash. With backslash not an escape
    character the reader keeps such a field in one piece, so the stray mark can go after parsing:
    no cleaned copy of the files is written. The end of a field is the end of a line only where
    ``ends_record``: for the last field of a record, and only if no closing quote follows it.
    """
    inside = F.regexp_replace(text, r"\\(?=\n)", "")
    return F.when(ends_record, F.regexp_replace(inside, r"\\$", "")).otherwise(inside)


def _field_count(record: Column) -> Column:
    bare = F.regexp_replace(record, r'(?s)"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","))) + 1


def csv_options(header: bool = True, encoding: str = "UTF-8") -> dict[str, object]:
    """Reader options for dirty files, batch or stream.

    Quoted fields may span lines and double their quotes; backslash escapes nothing. The NULL option
    is set to a mark that never occurs, which keeps the NULL token apart from an empty field.
    """
    return {
        "header": header, "multiLine": True, "quote": '"', "escape": '"', "nullValue": _UNSET, "emptyValue": "",
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "encoding": encoding, "enforceSchema": True,
    }


def csv_fields(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Repaired text fields with ``row_state`` (``ok``, ``short``, ``long``) and ``source_file``.

    The token ``\\N`` is NULL while an empty field stays an empty string. Short rows are padded with
    NULL; rows with too many fields are marked ``long`` for the caller to count and drop.
    """
    n, record = len(columns), F.col(f"`{CORRUPT}`")
    counted = raw.withColumn("_n_fields", F.when(record.isNull(), n + 1).otherwise(_field_count(record)))
    counted = counted.withColumn("_open_end", F.coalesce(~F.endswith(record, F.lit('"')), F.lit(False)))
    count = F.col("_n_fields")
    state = F.when(count > n, "long").when(count < n, "short").otherwise("ok")
    fields = []
    for i, c in enumerate(columns):
        present = F.when(count > i, F.coalesce(F.col(f"`{c}`"), F.lit("")))
        fields.append(F.nullif(repaired(present, F.col("_open_end") & (count == i + 1)), F.lit(NULL_TOKEN)).alias(c))
    return counted.select(*fields, state.alias("row_state"), F.col("_metadata.file_path").alias("source_file"))


def read_dirty_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str], *, encoding: str = "UTF-8",
                   header: bool = True) -> DataFrame:
    """All-text rows of dirty CSV files; see :func:`csv_options` and :func:`csv_fields`.

    A file is read by one task, because records span lines; parallelism comes from the number of files.
    """
    schema = text_schema(columns, corrupt=True)
    return csv_fields(spark.read.schema(schema).options(**csv_options(header, encoding)).csv(path), columns)


def probe_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per file: physical lines and whether all of them are valid UTF-8, in one streaming pass."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file"))
    return lines.groupBy("source_file").agg(
        F.count("*").alias("n_lines"), F.bool_and(F.is_valid_utf8("value")).alias("is_utf8")
    )


def record_fields(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What :func:`csv_fields` gives, from whole records with their number of fields."""
    options = {k: str(v) for k, v in csv_options().items() if k not in ("header", "multiLine", "encoding", "enforceSchema", "columnNameOfCorruptRecord")}
    schema = ", ".join(f"`{c}` string" for c in [*columns, _BEYOND])
    open_end = ~F.endswith("record", F.lit('"'))
    parsed = records.select(F.from_csv("record", schema, options).alias("p"), "n_fields", open_end.alias("_open_end"), "source_file")
    n = len(columns)
    state = F.when(F.col("n_fields") > n, "long").when(F.col("n_fields") < n, "short").otherwise("ok")
    fields = []
    for i, c in enumerate(columns):
        present = F.when(F.col("n_fields") > i, F.coalesce(F.col("p")[c], F.lit("")))
        fields.append(F.nullif(repaired(present, F.col("_open_end") & (F.col("n_fields") == i + 1)), F.lit(NULL_TOKEN)).alias(c))
    return parsed.select(*fields, state.alias("row_state"), "source_file")


def survey_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The blocks of the files as stored rows, for :func:`read_files` and :func:`file_totals`; one pass over the files."""
    return written(block_states(spark, path), "csv-survey")


def file_totals(survey: DataFrame) -> DataFrame:
    """What :func:`probe_files` tells, from a survey of the blocks."""
    return survey.groupBy("source_file").agg(F.sum("n_lines").alias("n_lines"), F.bool_and("is_utf8").alias("is_utf8"))


def read_files(spark: SparkSession, path: str | list[str], columns: Sequence[str], *, header: bool = True,
               survey: DataFrame | None = None) -> DataFrame:
    """Dirty CSV of mixed encodings: valid UTF-8 as it is, all else as Latin-1; see :func:`csv_fields`.

    A file is read by as many tasks as it has blocks, although its records span lines. ``survey`` (by default made
    here by :func:`survey_files`) says where its blocks begin inside a field and how it is encoded. With more than
    ``MOST_BLOCKS`` blocks each file is read by one task, a character per byte, and decoded afterwards.
    """
    known = survey_files(spark, path) if survey is None else survey
    if known.count() <= MOST_BLOCKS:
        return record_fields(csv_records(spark, path, known, header), columns)
    joined = read_dirty_csv(spark, path, columns, encoding=_BYTES, header=header).join(file_totals(known).select("source_file", "is_utf8"), "source_file")
    text = lambda c: F.when(F.col("is_utf8"), F.decode(F.encode(F.col(c), _BYTES), "UTF-8")).otherwise(F.col(c))
    return joined.select(*[text(c).alias(c) for c in columns], "row_state", "source_file")


def rejection(raw: DataFrame, key: str = "cycle") -> Column:
    """Why a row is not converted: too many fields (``long``) or a key that does not parse (``key``); else NULL."""
    no_key = F.when(F.col(key).try_cast("bigint").isNull(), "key")
    return F.when(F.col("row_state") == "long", "long").otherwise(no_key) if "row_state" in raw.columns else no_key


def typed(raw: DataFrame, types: Mapping[str, str] = TYPED, key: str = "cycle") -> DataFrame:
    """Cast tolerantly, without the rows that :func:`rejection` names; count those beforehand (``audit.ledger_rows``)."""
    casts = {c: types[c] for c in raw.columns if c in types} | {key: "bigint"}
    kept = raw.where(rejection(raw, key).isNull())
    return kept.select(*[F.col(c).try_cast(casts[c]).alias(c) if c in casts else F.col(c) for c in raw.columns if c != "row_state"])


def renamed(raw: DataFrame, names: Mapping[str, str] = SOURCE_NAMES) -> DataFrame:
    """Source names (with dots) to plain ones."""
    return raw.withColumnsRenamed({k: v for k, v in names.items() if k in raw.columns})


def key_from_path(path: Column, pattern: str = r"_(\d{4})\.csv", low: int = 1979, high: int = 2024) -> Column:
    """Partition key from the file name; a missing or out-of-range key is an error."""
    message = F.concat(F.lit("no key in range in file name "), path)
    return F.coalesce(key_or_null(path, pattern, low, high), F.raise_error(message).cast("bigint"))


def key_or_null(path: Column, pattern: str, low: int, high: int) -> Column:
    """The key in the file name if it has one in range, else NULL."""
    key = F.regexp_extract(path, pattern, 1).try_cast("bigint")
    return F.when(key.between(low, high), key)


def write_partitioned(df: DataFrame, path: str, by: str, *, mode: str = "overwrite", compression: str = "zstd",
                      rows_per_file: int = 20_000_000, replace_all: bool = False, files_per_key: int | None = None) -> None:
    """Partitioned parquet. Overwriting replaces only the partitions that ``df`` holds.

    By default rows go out from the tasks that hold them, without a shuffle: right when a task holds
    few keys. With ``files_per_key`` rows are first gathered by key and a salt, which gives every key
    at most that many files while a key with most of the rows is still written by that many tasks.
    Long files are cut.
    """
    scope = "static" if replace_all else "dynamic"
    if files_per_key:
        salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != by]), F.lit(files_per_key))
        df = df.repartition(F.col(by), salt)
    (
        df.write.mode(mode)
        .option("compression", compression)
        .option("maxRecordsPerFile", rows_per_file)
        .option("partitionOverwriteMode", scope)
        .partitionBy(by)
        .parquet(path)
    )


def read_partitioned(spark: SparkSession, path: str, schema: StructType, key: str = "cycle", key_type: str = "bigint") -> DataFrame:
    """Partition tree with a pinned key type; no file is opened to infer a schema."""
    fields = [f for f in schema.fields if f.name != key]
    pinned = StructType([*fields, *StructType.fromDDL(f"`{key}` {key_type}").fields])
    df = spark.read.schema(pinned).parquet(path)
    if df.schema[key].dataType.simpleString() != key_type:
        raise TypeError(f"{key} is {df.schema[key].dataType.simpleString()}, not {key_type}")
    return df


def partition_summary(df: DataFrame, key: str = "cycle") -> DataFrame:
    """Rows per partition, in order."""
    return df.groupBy(key).agg(F.count("*").alias("n_rows")).orderBy(key)
