"""Helpers shared by the document operators."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"

#: Rows of an Arrow batch at most.
BATCH_ROWS = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *also: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key as a long, the text (null counts as empty) and the named columns; further columns are left behind."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *also)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_ROWS`` rows, whose process gives freed memory back.

    A batch is held several times, on both sides of the pipe to Python, and texts are long. The session's
    setting is lowered when it allows more, since it counts at the time the rows are computed. Spark keeps the
    Python processes for later stages; what an operator has freed should not stay with them.
    """
    conf = rows.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_KEY)) <= BATCH_ROWS:
        conf.set(_BATCH_KEY, BATCH_ROWS)

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, batch in enumerate(run(batches)):
            yield batch
            if i % 8 == 7:
                give_back()
        give_back()

    return rows.mapInArrow(released, schema)


def broadcast_object(spark: SparkSession, value: Any) -> Broadcast:
    """Broadcast an object with its class, for workers that cannot import this package; read it by :func:`received`."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent: Broadcast) -> Any:
    """The object of a :func:`broadcast_object`, once for each call."""
    return cloudpickle.loads(sent.value)


def process_cache() -> dict[str, Any]:
    """What this Python process keeps from task to task. Kept as a module made on the spot, so nothing need be importable."""
    return sys.modules.setdefault("_panelweave_process", types.ModuleType("_panelweave_process")).__dict__


def give_back() -> None:
    """Return freed memory of Arrow and the C library to the system, where the library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def by_batch(rows: DataFrame, work: Callable[[dict[str, list]], dict[str, list]], schema: str, step: int = 256) -> DataFrame:
    """Apply ``work`` to the columns of at most ``step`` rows at a time, as Arrow batches inside the tasks.

    ``work`` gets and returns columns as lists. Small steps bound what one call holds beside the batch.
    """
    spark = rows.sparkSession
    kind = spark.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                made = work(batch.slice(start, step).to_pydict())
                yield pa.RecordBatch.from_pydict({f.name: pa.array(made[f.name], f.type) for f in out}, schema=out)

    return in_arrow(rows, run, kind)
