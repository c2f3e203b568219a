"""Resumable conversion: files are converted as they appear, each exactly once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from panelweave.session import intermediates, written
from panelweave.sources import manifest
from panelweave.sources.audit import ledger_rows
from panelweave.sources.transactions import TYPED, file_totals, key_or_null, read_files, survey_files, typed, write_partitioned


def convert_new_files(spark: SparkSession, source: str, target: str, ledger: str, checkpoint: str,
                      columns: Sequence[str], *, key: str = "cycle", types: Mapping[str, str] = TYPED,
                      pattern: str = r"_(\d{4})\.csv", low: int = 1979, high: int = 2024, header: bool = True,
                      files_per_batch: int = 64) -> None:
    """Convert the files in ``source`` that no earlier call has finished, then stop.

    The stream carries the names of new files only (``files_per_batch`` at a time); their content goes
    through the batch reader, which tells UTF-8 from Latin-1 per file. The stream's checkpoint knows the
    finished files, so a repeated or restarted call does only what is left. A batch writes a part of its own, then
    its ledger rows, and then publishes the part (:mod:`panelweave.sources.manifest`): :func:`read_converted` and
    :func:`read_ledger` see whole batches only. A batch killed before is converted anew and leaves no part, one killed after is
    known to be published and not converted again. Intermediate files go with the batch. The partition key comes from the file name; rows that state another key are kept as
    ``row_<key>`` and counted in the ledger. Every file gets a ledger row, also one without a good row; a
    file whose name has no key from ``low`` to ``high`` is entered as failed and the others go on.
    """
    kind = "path string, modificationTime timestamp, length bigint, content binary"  # only the path is read
    names = spark.readStream.format("binaryFile").schema(kind).option("maxFilesPerTrigger", files_per_batch).load(source).select("path")

    def convert(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        manifest.sweep(session, target, keep_versions=2)  # what killed batches have left
        if number <= manifest.current(session, target)["last_batch"]:
            return
        with intermediates(session):
            paths = [r["path"] for r in batch.collect()]  # at most files_per_batch
            survey = survey_files(session, paths)
            of_file = key_or_null(F.col("source_file"), pattern, low, high)
            raw = read_files(session, paths, columns, header=header, survey=survey).withColumn(f"_file_{key}", of_file)
            raw = written(raw.where(F.col(f"_file_{key}").isNotNull()), "batch-rows")
            rows = typed(raw, types, key).withColumnsRenamed({key: f"row_{key}", f"_file_{key}": key})
            part, out = manifest.new_part(target, str(number))
            rows.write.mode("overwrite").partitionBy(key).option("compression", "zstd").parquet(out)
            entries = ledger_rows(raw, file_totals(survey), key=key, file_key=of_file)
            entries.write.mode("overwrite").parquet(f"{ledger}/batch={number}")
        manifest.publish(session, target, [part], last_batch=number)

    query = (
        names.writeStream.foreachBatch(convert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_ledger(spark: SparkSession, target: str, ledger: str) -> DataFrame:
    """The ledger rows of published batches, with their number as ``batch``."""
    last = manifest.current(spark, target)["last_batch"]
    return spark.read.parquet(ledger).where(F.col("batch") <= last)


def _schema(columns: Sequence[str], key: str, types: Mapping[str, str]) -> StructType:
    kinds = {**{c: types.get(c, "string") for c in columns if c != key}, f"row_{key}": "bigint", "source_file": "string"}
    return StructType.fromDDL(", ".join([*(f"`{c}` {kind}" for c, kind in kinds.items()), f"`{key}` bigint"]))


def read_converted(spark: SparkSession, target: str, columns: Sequence[str], *, key: str = "cycle",
                   types: Mapping[str, str] = TYPED) -> DataFrame:
    """All converted rows of published batches, with the types they were written with and the key pinned to BIGINT."""
    schema = _schema(columns, key, types)
    parts = manifest.current(spark, target)["parts"]
    if not parts:
        return spark.createDataFrame([], schema)
    pinned = StructType([*schema.fields, StructField("part", StringType())])
    return spark.read.schema(pinned).option("basePath", target).parquet(*[f"{target}/{p}" for p in parts]).drop("part")


def compact_converted(spark: SparkSession, target: str, columns: Sequence[str], *, key: str = "cycle",
                      types: Mapping[str, str] = TYPED, files_per_key: int = 1, least_parts: int = 2) -> int:
    """Replace all parts by one with at most ``files_per_key`` files a key (long ones are cut); returns how many were replaced.

    Readers that started before go on with the parts they know; those are deleted by the next conversion but one. With
    fewer than ``least_parts`` parts nothing is done.
    """
    parts = manifest.current(spark, target)["parts"]
    if len(parts) < least_parts:
        return 0
    part, out = manifest.new_part(target, "compact")
    write_partitioned(read_converted(spark, target, columns, key=key, types=types), out, key, files_per_key=files_per_key, replace_all=True)
    manifest.publish(spark, target, [part], parts)
    return len(parts)
