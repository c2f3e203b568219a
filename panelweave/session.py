"""Session helpers: the shared folder for written intermediates and local test sessions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    Only a session that runs in this one process (``local[...]``) may fall back to a temporary
    folder; on a cluster a missing setting is an error, because executors on other machines
    would not see the files.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that every executor can read and write")
    root = tempfile.mkdtemp(prefix="panelweave-")
    sc.setCheckpointDir(root)
    return root


_SCOPES: list[list[str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; an open :func:`intermediates` scope removes it at its end."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """A scope for a job that writes its result: what it stored in the shared folder on the way goes at the end.

    Frames built inside read those files, so nothing lazy may be used after the scope. Only paths handed out
    inside the scope are removed.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a frame feeds several later jobs: the files survive the loss of an executor,
    and the lineage of whatever follows starts at a parquet scan. Runs a job when called, also while a
    plan is being built.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-process session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("panelweave")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config(CHECKPOINT_KEY, tempfile.mkdtemp(prefix="panelweave-"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
