"""Atomic publishing of parts of a data set: readers follow a manifest, writers add to it when a part is whole.

A data set is a folder with one folder per part and, below ``_manifest``, numbered versions. A version lists the live
parts and the last batch that was published; it is written beside and renamed, so it is there whole or not at all, and
the highest number counts. A part that no version lists was never published, or has been replaced. A version may also list
folders inside of parts, which can then be replaced one by one.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import SparkSession

_FOLDER = "_manifest"


def _files(spark: SparkSession, path: str) -> tuple[Any, Any]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _newest(spark: SparkSession, root: str) -> int:
    return max((int(m[1]) for n in _names(spark, f"{root}/{_FOLDER}") if (m := re.fullmatch(r"v(\d+)\.json", n))), default=0)


def current(spark: SparkSession, root: str) -> dict[str, Any]:
    """The newest version: ``parts`` (folder names in order of publishing) and ``last_batch`` (-1 before the first)."""
    version = _newest(spark, root)
    if not version:
        return {"parts": [], "last_batch": -1}
    fs, at = _files(spark, f"{root}/{_FOLDER}/v{version}.json")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def new_part(root: str, name: str) -> tuple[str, str]:
    """Name and path of a part that nobody has written yet."""
    part = f"part={name}-{uuid.uuid4().hex[:12]}"
    return part, f"{root}/{part}"


def publish(spark: SparkSession, root: str, add: Sequence[str], drop: Sequence[str] = (), last_batch: int | None = None) -> None:
    """Make parts visible, and others invisible, in one step. One writer at a time; a second one fails."""
    now, version = current(spark, root), _newest(spark, root) + 1
    gone = set(drop)
    if not gone <= set(now["parts"]):
        raise RuntimeError("parts to be replaced are not live any more")
    parts = [p for p in now["parts"] if p not in gone] + [p for p in add if p not in now["parts"]]
    body = json.dumps({"parts": parts, "last_batch": now["last_batch"] if last_batch is None else max(last_batch, now["last_batch"])})
    fs, beside = _files(spark, f"{root}/{_FOLDER}/.{uuid.uuid4().hex}.tmp")
    stream = fs.create(beside, True)
    stream.write(bytearray(body.encode()))
    stream.close()
    _, target = _files(spark, f"{root}/{_FOLDER}/v{version}.json")
    if fs.exists(target) or not fs.rename(beside, target):
        fs.delete(beside, False)
        raise RuntimeError(f"version {version} of the manifest was written by somebody else")


def sweep(spark: SparkSession, root: str, keep_versions: int = 1) -> list[str]:
    """Delete the parts that the newest ``keep_versions`` versions do not list, and older versions; returns their names.

    For the only writer, when no reader uses what older versions list: parts of killed batches and replaced ones.
    """
    newest = _newest(spark, root)
    live: set[str] = set()
    for version in range(max(1, newest - keep_versions + 1), newest + 1):
        fs, at = _files(spark, f"{root}/{_FOLDER}/v{version}.json")
        if fs.exists(at):
            stream = fs.open(at)
            live |= set(json.loads(bytes(stream.readAllBytes()).decode())["parts"])
            stream.close()
    held = {p.split("/", 1)[0] for p in live}
    gone = [n for n in _names(spark, root) if n.startswith("part=") and n not in held]
    for name in held - live:  # parts of which some folders are live
        gone += [f"{name}/{n}" for n in _names(spark, f"{root}/{name}") if "=" in n and f"{name}/{n}" not in live]
    for name in gone:
        fs, at = _files(spark, f"{root}/{name}")
        fs.delete(at, True)
    for name in _names(spark, f"{root}/{_FOLDER}"):
        m = re.fullmatch(r"v(\d+)\.json", name)
        if name.endswith(".tmp") or m and int(m[1]) <= newest - keep_versions:
            fs, at = _files(spark, f"{root}/{_FOLDER}/{name}")
            fs.delete(at, False)
    return gone
