"""Jaro similarity of two text columns.

The match-and-transpose rule walks both strings with a used-flag per character, which no built-in
function expresses; as a lambda over arrays it runs interpreted, one pair at a time. Here one Arrow
batch of pairs is compared at once with numpy (measured numbers in README.md).
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType


# rough cost of a character: a pair on its own, and a step over a whole batch
_PAIR_STEP, _BATCH_STEP = 0.5, 5.0
_PAIRS = 20_000  # pairs that are compared at once
_BOUNDS = 1_000_000  # pairs whose bounds are held at once
_LETTERS, _MARKS = 63, 4  # letters that are told apart in a bound, and how many of each
_FIRST = 16  # others a text is compared with before the bounds decide
_SLACK = 1e-5  # more than the error of a bound in single precision
_EQUAL = 2e-12  # distances no farther apart may be equal at 12 places
_FOUND = StructType().add("text", StringType()).add("distance", DoubleType()).add("place", IntegerType())


def _code_points(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Code points, one row per character position and one column per text, and the lengths."""
    lengths = texts.str.len().to_numpy(dtype=np.int64)
    width = max(int(lengths.max(initial=0)), 1)
    codes = np.array(texts.tolist(), dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)
    if codes.max(initial=0) < 256:
        codes = codes.astype(np.uint8)  # the common case; a quarter of the memory traffic
    return np.ascontiguousarray(codes.T), lengths


def _in_order(codes: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The used characters of each text moved to the front, in their order."""
    out = np.zeros_like(codes)
    place = np.zeros(codes.shape[1], dtype=np.int64)
    for i in range(codes.shape[0]):
        hit = np.flatnonzero(used[i])
        out[place[hit], hit] = codes[i, hit]
        place[hit] += 1
    return out


def jaro_batch(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Jaro similarity per row; half-transpositions are floored; two empty strings are equal."""
    a, len_a = _code_points(left)
    b, len_b = _code_points(right)
    window = np.maximum(np.maximum(len_a, len_b) // 2 - 1, 0)
    reach = int(window.max(initial=0))
    in_window = [window >= off for off in range(reach + 1)]
    free = np.arange(b.shape[0])[:, None] < len_b[None, :]
    used_a = np.zeros(a.shape, dtype=bool)
    for i in range(a.shape[0]):
        open_ = i < len_a
        for j in range(max(0, i - reach), min(b.shape[0], i + reach + 1)):
            hit = (a[i] == b[j]) & free[j] & open_ & in_window[abs(i - j)]
            free[j] ^= hit
            open_ ^= hit
            used_a[i] |= hit
    used_b = (np.arange(b.shape[0])[:, None] < len_b[None, :]) & ~free
    matches = used_a.sum(axis=0)
    height = min(a.shape[0], b.shape[0])
    compared = np.arange(height)[:, None] < matches[None, :]
    differs = _in_order(a, used_a)[:height] != _in_order(b, used_b)[:height]
    transposed = (differs & compared).sum(axis=0) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (matches / len_a + matches / len_b + (matches - transposed) / matches) / 3.0
    score = np.where(matches > 0, score, 0.0)
    return np.where((len_a == 0) & (len_b == 0), 1.0, score)


def jaro_pair(a: str, b: str) -> float:
    """Jaro similarity of one pair in time proportional to its length.

    Characters of ``a`` take the first free equal character of ``b`` in their window. Windows only move
    forward, so the places of a character in ``b`` are a queue: those left behind are never needed again.
    """
    if not a or not b:
        return float(a == b)
    window = max(max(len(a), len(b)) // 2 - 1, 0)
    places: dict[str, deque[int]] = {}
    for j, c in enumerate(b):
        places.setdefault(c, deque()).append(j)
    first, taken = [], []
    for i, c in enumerate(a):
        queue = places.get(c)
        while queue and queue[0] < i - window:
            queue.popleft()
        if queue and queue[0] <= i + window:
            first.append(c)
            taken.append(queue.popleft())
    m = len(first)
    if not m:
        return 0.0
    half = sum(c != b[j] for c, j in zip(first, sorted(taken), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - half) / m) / 3.0


def jaro_by_length(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Jaro similarity per row, class by class of the longer text's length, so no text sets the cost of others.

    A class of many short texts is compared at once, a class of few long ones pair by pair.
    """
    out = np.empty(len(left))
    longest = np.maximum(left.str.len().to_numpy(dtype=np.int64), right.str.len().to_numpy(dtype=np.int64))
    classes = np.ceil(np.log2(np.maximum(longest, 8)) * 2).astype(np.int64)
    for c in np.unique(classes):
        rows = np.flatnonzero(classes == c)
        width = int(longest[rows].max())
        if len(rows) * _PAIR_STEP < width * _BATCH_STEP:
            out[rows] = [jaro_pair(a, b) for a, b in zip(left.iloc[rows], right.iloc[rows], strict=True)]
        else:
            out[rows] = jaro_batch(left.iloc[rows], right.iloc[rows])
    return out


@F.pandas_udf(DoubleType())
def _jaro(left: pd.Series, right: pd.Series) -> pd.Series:
    out = np.full(len(left), np.nan)
    known = (left.notna() & right.notna()).to_numpy()
    if known.any():
        out[known] = jaro_by_length(left[known], right[known])
    return pd.Series(out).where(known)


def _bags(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, letters of each text as marks (the k-th of a letter has its own), and how many found no mark."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    place = np.minimum(np.searchsorted(letters, codes), len(letters) - 1)
    place = np.where(letters[place] == codes, place, len(letters))  # all other letters count as one
    cells = np.repeat(np.arange(len(texts)), lengths) * (len(letters) + 1) + place
    counts = np.bincount(cells, minlength=len(texts) * (len(letters) + 1)).reshape(len(texts), -1)
    marks = (counts[:, :, None] > np.arange(_MARKS)).reshape(len(texts), -1).astype(np.float32)
    return lengths.astype(np.float32), marks, np.maximum(counts - _MARKS, 0).sum(axis=1).astype(np.float32)


def nearest_of(texts: list[str], others: list[str]) -> list[list[tuple[float, int]]]:
    """Per text the distance and place of the nearest of ``others``, of equal ones the first.

    With o letters in common the similarity is at most (o / |a| + o / |b| + 1) / 3, and o for all pairs is one product of
    matrices. Pairs with the best bounds are compared first; after them only those whose bound reaches what was found.
    Distances that may be equal once they are rounded are all given, each with its first place. No text may be empty.
    """
    if not texts or not others:
        return [[] for _ in texts]
    seen, often = np.unique(np.frombuffer("".join(others).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_counts=True)
    letters = np.sort(seen[np.argsort(-often, kind="stable")[:_LETTERS]])
    size_b, marks_b, over_b = _bags(others, letters)
    left, right = np.array(texts, dtype=object), np.array(others, dtype=object)
    out, many = [], max(_BOUNDS // len(others), 1)
    for start in range(0, len(texts), many):
        size_a, marks_a, over_a = _bags(texts[start:start + many], letters)
        common = marks_a @ marks_b.T + np.minimum(over_a[:, None], over_b[None, :])
        bound = (common / size_a[:, None] + common / size_b[None, :] + 1) / 3

        def compared(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
            cuts = range(0, len(rows), _PAIRS)
            parts = [jaro_by_length(pd.Series(left[start + rows[i:i + _PAIRS]]), pd.Series(right[places[i:i + _PAIRS]])) for i in cuts]  # noqa: B023
            return 1 - np.concatenate(parts) if parts else np.empty(0)

        n, few = len(bound), min(_FIRST, len(others))
        rows, places = np.repeat(np.arange(n), few), np.argpartition(-bound, few - 1, axis=1)[:, :few].ravel()
        apart = compared(rows, places)
        low = apart.reshape(n, few).min(axis=1)
        more = np.nonzero(bound >= 1 - low[:, None] - _SLACK)
        rows, places, apart = np.r_[rows, more[0]], np.r_[places, more[1]], np.r_[apart, compared(*more)]
        np.minimum.at(low, rows, apart)
        order = np.lexsort((places, apart, rows))
        order = order[apart[order] <= low[rows[order]] + _EQUAL]
        rows, places, apart = rows[order], places[order], apart[order]
        first = np.r_[True, (np.diff(rows) != 0) | (np.diff(apart) != 0)]
        found = [*zip(apart[first].tolist(), places[first].tolist(), strict=True)]
        ends = np.searchsorted(rows[first], np.arange(n + 1)).tolist()
        out += [found[i:j] for i, j in zip(ends, ends[1:], strict=False)]
    return out


@F.pandas_udf(ArrayType(_FOUND))
def jaro_nearest(texts: pd.Series, others: pd.Series) -> pd.Series:
    """Two columns of text arrays: per text of the first the nearest of the second, as :func:`nearest_of` gives them."""
    return pd.Series([
        [(t, d, i) for t, found in zip(a, nearest_of(list(a), list(b)), strict=True) for d, i in found] for a, b in zip(texts, others, strict=True)
    ])


def jaro_similarity(left: Column, right: Column) -> Column:
    """Jaro similarity in [0, 1]; NULL when either side is NULL."""
    return _jaro(left, right)


def jaro_distance(left: Column, right: Column) -> Column:
    """One minus the similarity, rounded to 12 places so that equal distances compare equal."""
    return F.round(1 - _jaro(left, right), 12)
