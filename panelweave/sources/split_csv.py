"""CSV records of large files, read by many tasks although quoted fields span lines.

Lines are read by the splittable text reader, which tells the byte range (block) a line starts in. Whether a block begins
inside a quoted field depends on all before it, so two passes are made:

1. Every block reports its transition: whether a quote is open at its end if none was at its start, and if one was. Only
   lines that hold a quote can change that. Line counts and the validity of UTF-8 come along. The transitions
   of a file, composed in order, give the state at each block's start.
2. Every block cuts its lines into records from its state; they never leave their task. Only where a block begins inside a
   field, the record that crosses its border comes as fragments from the blocks concerned (all other lines are left
   out before they reach Python), which are put together by file and first block.

The states are one row per block and are handed to the second pass by broadcast, up to ``MOST_BLOCKS`` of them; beyond that
``transactions.read_files`` reads a file per task. Compressed files are one block each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.session import written

MOST_BLOCKS = 250_000  # some 32 TB of blocks of 128 MB; 40 MB of states
_RECORD = "source_file string, block long, piece int, record binary, n_fields int, is_utf8 boolean"
#: A whole record, the end of one begun in an earlier block, the beginning of one that goes on, a block inside one.
WHOLE, TAIL, HEAD, MIDDLE = range(4)


def scan_line(line: bytes, inside: bool) -> tuple[bool, int]:
    """Whether a quoted field is open after a line, and the delimiters outside of quotes.

    A field is quoted when its first character is a quote. Two quotes inside stand for one; a quote followed by anything but blanks and
    a delimiter or the end of the line makes the field an unquoted one, up to the next delimiter.
    """
    at, found, size = 0, 0, len(line)
    while True:
        if not inside:
            if line[at : at + 1] != b'"':
                at = line.find(b",", at)
                if at < 0:
                    return False, found
                at, found = at + 1, found + 1
                continue
            at += 1
        inside = False
        while True:
            at = line.find(b'"', at)
            if at < 0:
                return True, found
            if line[at + 1 : at + 2] != b'"':
                break
            at += 2
        at += 1
        while line[at : at + 1] in (b" ", b"\t"):
            at += 1
        if at < size and line[at : at + 1] != b",":
            at = line.find(b",", at)
        if at < 0 or at >= size:
            return False, found
        at, found = at + 1, found + 1


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The parts of a batch that belong to one block each."""
    files, blocks = batch.column("source_file").dictionary_encode(), np.asarray(batch.column("block"))
    of = np.asarray(files.indices)
    cuts = np.concatenate([[0], np.flatnonzero((of[1:] != of[:-1]) | (blocks[1:] != blocks[:-1])) + 1, [len(of)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield files.dictionary[of[a]].as_py(), int(blocks[a]), batch.slice(a, b - a)


def block_states(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per block: source_file, block, inside and open_end (a quoted field is open at its start, at its end), its n_lines, and
    is_utf8 of the whole file. Runs a job.
    """
    schema = "source_file string, block long, closed boolean, opened boolean, n_lines long, is_utf8 boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[str, int] | None = None
        states, lines, good = (False, True), 0, True

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"source_file": now[0], "block": now[1], "closed": states[0], "opened": states[1], "n_lines": lines, "is_utf8": good}], pa.schema(
                [("source_file", pa.string()), ("block", pa.int64()), ("closed", pa.bool_()), ("opened", pa.bool_()), ("n_lines", pa.int64()), ("is_utf8", pa.bool_())]))

        for batch in batches:
            for file, block, part in _runs(batch):
                if (file, block) != now:
                    if now is not None:
                        yield made()
                    now, states, lines, good = (file, block), (False, True), 0, True
                lines += part.num_rows
                good &= bool(pc.all(part.column("valid")).as_py())
                for line in part.column("quoted").drop_null().to_pylist():
                    after = scan_line(line, states[0])[0]
                    states = (after, after if states[0] == states[1] else scan_line(line, states[1])[0])
        if now is not None:
            yield made()

    # only lines with a quote go to Python
    quoted = F.when(F.contains("value", F.lit('"')), F.col("value").cast("binary")).alias("quoted")
    lines = _lines(spark, path).select("source_file", "block", quoted, F.is_valid_utf8("value").alias("valid"))
    ends = written(lines.mapInArrow(run, schema), "csv-blocks")
    per_file = ends.groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("block", "closed", "opened", "n_lines"))).alias("blocks"), F.bool_and("is_utf8").alias("is_utf8"))

    def step(acc, b):  # a file has a block for some 128 MB
        state = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.when(state, b["opened"]).otherwise(b["closed"])))

    starts = F.aggregate("blocks", F.array(F.lit(False)), step)
    told = per_file.select("source_file", "is_utf8", "blocks", starts.alias("starts")).select("source_file", "is_utf8", F.explode(F.arrays_zip(F.col("blocks").alias("b"), F.slice("starts", 1, F.size("blocks")).alias("inside"), F.slice("starts", 2, F.size("blocks")).alias("open_end"))).alias("z"))
    return told.select("source_file", F.col("z.b.block").alias("block"), F.col("z.inside").alias("inside"), F.col("z.open_end").alias("open_end"), F.col("z.b.n_lines").alias("n_lines"), "is_utf8")


def _cut(values: list[bytes], inside: bool, counts: np.ndarray, quoted: np.ndarray, held: list[bytes], fields: int) -> tuple[list[tuple[bytes, int]], bool, int]:
    """Records that end in these lines with their fields, the state after them, and the delimiters of what stays open in ``held``."""
    out: list[tuple[bytes, int]] = []
    at, size = 0, len(values)
    for i in [*np.flatnonzero(quoted).tolist(), size]:
        if inside:
            held += values[at:i]
        else:
            out += zip(values[at:i], (counts[at:i] + 1).tolist(), strict=True)
        if i == size:
            break
        inside, found = scan_line(values[i], inside)
        held.append(values[i])
        fields += found
        if not inside:
            out.append((b"\n".join(held), fields + 1))
            held.clear()
            fields = 0
        at = i + 1
    return out, inside, fields


def _pieces(lines: DataFrame, header: bool, kinds: tuple[int, ...]) -> DataFrame:
    """Records and fragments of each block, of the kinds asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("source_file", pa.string()), ("block", pa.int64()), ("piece", pa.int32()), ("record", pa.binary()), ("n_fields", pa.int32()), ("is_utf8", pa.bool_())])
        now: tuple[str, int] | None = None
        inside, utf8, begun, skip, fields = False, True, True, False, 0
        held: list[bytes] = []

        def rows(of: tuple[str, int], found: list[tuple[bytes, int, int]]) -> Iterator[pa.RecordBatch]:
            found = [f for f in found if f[2] in kinds]
            if found:
                record, count, piece = zip(*found, strict=True)
                n = len(found)
                columns = [pa.array([of[0]] * n), np.full(n, of[1]), pa.array(piece, pa.int32()), pa.array(record, pa.binary()), pa.array(count, pa.int32()), pa.array([utf8] * n)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

        def rest() -> list[tuple[bytes, int, int]]:
            return [(b"\n".join(held), fields, HEAD if begun else MIDDLE)] if held else []

        for batch in batches:
            for file, block, part in _runs(batch):
                if (file, block) != now:
                    if now is not None:
                        yield from rows(now, rest())
                    now, held, fields = (file, block), [], 0
                    inside, utf8 = part.column("inside")[0].as_py(), part.column("is_utf8")[0].as_py()
                    if inside is None:
                        raise RuntimeError(f"{file} changed between two passes over it")
                    begun, skip = not inside, header and block == 0
                value = part.column("value")
                returns = pc.ends_with(value, b"\r")
                if pc.any(returns).as_py():
                    value = pc.if_else(returns, pc.binary_slice(value, 0, -1), value)
                quoted = pc.find_substring(value, b'"').to_numpy(zero_copy_only=False) >= 0
                counts = pc.count_substring(value, b",").to_numpy(zero_copy_only=False)
                found, inside, fields = _cut(value.to_pylist(), inside, counts, quoted, held, fields)
                out = [(r, n, WHOLE) for r, n in found]
                if out and not begun:
                    out[0], begun = (out[0][0], out[0][1] - 1, TAIL), True
                begun = begun or not held
                out = [r for r in out if r[0] or r[2] != WHOLE]
                if skip and out:
                    out, skip = out[1:], False
                yield from rows(now, out)
        if now is not None:
            # a field that is never closed ends with its file
            yield from rows(now, rest())

    return lines.mapInArrow(run, _RECORD)


def csv_records(spark: SparkSession, path: str | list[str], states: DataFrame, header: bool = True) -> DataFrame:
    """All records of the files: record (text, without its line end), n_fields and source_file.

    ``states`` are the written :func:`block_states`. Valid UTF-8 is taken as it is, any other file as Latin-1. A carriage return before
    a line end belongs to it. Empty lines are no records. With ``header`` the first record of each file goes. A field that is never
    closed reaches to the end of its file.
    """
    lines = _lines(spark, path).withColumn("value", F.col("value").cast("binary"))
    told = F.broadcast(states.select("source_file", "block", "inside", "is_utf8"))  # a row per block, checked by the caller
    records = _pieces(lines.join(told, ["source_file", "block"], "left"), header, (WHOLE,))
    whole = records.select("source_file", "record", "n_fields", "is_utf8")
    near = states.filter("inside OR open_end").select("source_file", "block", "inside", "is_utf8")
    decoded = F.when(F.col("is_utf8"), F.col("record").cast("string")).otherwise(F.decode("record", "ISO-8859-1"))
    if not near.limit(1).count():
        return whole.select(decoded.alias("record"), "n_fields", "source_file")
    pieces = _pieces(lines.join(F.broadcast(near), ["source_file", "block"]), header, (TAIL, HEAD, MIDDLE))
    order = Window.partitionBy("source_file").orderBy("block", F.col("piece") != TAIL).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = pieces.withColumn("of", F.max(F.when(F.col("piece") == HEAD, F.col("block"))).over(order))
    joined = parts.groupBy("source_file", "of").agg(F.array_sort(F.collect_list(F.struct("block", "record", "n_fields"))).alias("p"), F.first("is_utf8").alias("is_utf8"))
    text = F.aggregate("p", F.lit(None).cast("binary"), lambda a, x: F.when(a.isNull(), x["record"]).otherwise(F.concat(a, F.lit(b"\n"), x["record"])))
    fields = F.aggregate("p", F.lit(1), lambda a, x: a + x["n_fields"])
    every = whole.unionByName(joined.select("source_file", text.alias("record"), fields.alias("n_fields"), "is_utf8"))
    decoded = F.when(F.col("is_utf8"), F.col("record").cast("string")).otherwise(F.decode("record", "ISO-8859-1"))
    return every.select(decoded.alias("record"), "n_fields", "source_file")
