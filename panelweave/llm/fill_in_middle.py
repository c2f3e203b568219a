"""Fill-in-the-middle order of documents: two cuts between tokens, found in an indexable skip list.

The tokens of a text (a run of ASCII letters, or any other code point) are the nodes of a skip list. The lowest lane
links all of them; every express lane keeps about a quarter of the nodes below, told by a hash of their rank.
Every link carries two widths: the units it passes, and their code points. A cut after u units is reached by descending
from the highest lane: links are taken while the units passed stay within u and the code points add up on the
way, so the sum at the end is the exact place of the cut. A descent takes a few links a lane; all lanes together
hold four thirds of a number pair per token.

Cuts and form come from a hash of the document id, so a rerun after a lost executor gives the same rows. Texts
are worked on one by one inside Arrow batches; no row depends on another.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import by_batch, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT = 10, 20
_LANE_BITS, _MOST_LANES = 2, 24


class WidthList:
    """Indexable skip list over tokens, given by the code points of each."""

    def __init__(self, lengths: np.ndarray):
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        nodes = np.arange(len(ends), dtype=np.int64)  # node r ends r tokens; node 0 is the head and stands on every lane
        mixed = (nodes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        below = None
        #: From the lowest: units and code points of the links, and the place of every node in the lane below.
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = []
        while True:
            self.lanes.append((np.diff(nodes), np.diff(ends[nodes]), below))
            bits = (mixed[nodes] >> np.uint64(_LANE_BITS * (len(self.lanes) - 1))) & np.uint64((1 << _LANE_BITS) - 1)
            bits[0] = 0
            below = np.flatnonzero(bits == 0)
            if len(below) == 1 or len(self.lanes) == _MOST_LANES:
                break
            nodes = nodes[below]

    def points_before(self, units: int) -> int:
        """Code points of the first ``units`` tokens, by descending the lanes."""
        passed = points = at = 0
        for widths, heights, below in reversed(self.lanes):
            while at < len(widths) and passed + widths[at] <= units:
                passed += int(widths[at])
                points += int(heights[at])
                at += 1
            if below is not None:
                at = int(below[at])
        return points


def token_lengths(text: str) -> np.ndarray:
    """Code points of every token, from left to right."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    letter = ((points | 32) - np.uint32(97)) < 26
    starts = np.flatnonzero(~letter | ~np.concatenate([[False], letter[:-1]]))
    return np.diff(starts, append=len(points))


def _one(doc_id: int | None, text: str, seed: int, plain_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    lengths = token_lengths(text)
    n = len(lengths)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - plain_percent:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    ranks = WidthList(lengths)
    a, b = ranks.points_before(low), ranks.points_before(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row per document: doc_id, n (tokens), form, prefix_chars, middle_chars (null if plain) and the output text.

    Null and empty texts, and texts that hold a mark, stay plain. Rows that repeat an id and a text are cut at the same
    places; a null id has the hash of an empty one. Parts may be empty; equal cuts leave an empty middle. An empty table
    gives no rows; other columns are ignored. A text is held a few times over as numbers of its code points, however long it is.
    """

    def work(cols: dict[str, list]) -> dict[str, list]:
        made = [_one(i, t, seed, plain_percent, spm_percent) for i, t in zip(cols["doc_id"], cols["text"], strict=True)]
        n, form, prefix, middle, output = map(list, zip(*made, strict=True)) if made else ([], [], [], [], [])
        return {"doc_id": cols["doc_id"], "n": n, "form": form, "prefix_chars": prefix, "middle_chars": middle, "output": output}

    return by_batch(texts(docs), work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text an output was made from. No text with a mark is ever reordered, so the marks cut the output exactly."""
    parts = F.split(output, "<[PSM]>", -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, **how: int) -> DataFrame:
    """The rows of :func:`fill_in_middle` with hashes in place of texts: of the output and of what is restored from it."""
    made = fill_in_middle(docs, **how)
    back = restored(F.col("form"), F.col("output"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )
