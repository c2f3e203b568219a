"""Lossless blocking keys for a Jaro distance bound.

With m matched characters, similarity is at most (m/|a| + m/|b| + 1) / 3, and m is at most the
overlap of the two character multisets. A distance of at most d therefore needs an overlap of
(2 - 3d) |a||b| / (|a| + |b|), which also bounds the length ratio by 1 - 3d.

A string is the set of its (character, occurrence) tokens in one fixed order, rare ones first. Two
sets with overlap O must share at least l tokens among the first |x| - O + l of each (the prefix
filter of set-similarity joins, extended from 1 to l tokens), so every qualifying pair meets in at
least one l-subset of those prefixes.

Lengths are grouped into bands, a sixteenth to a thirty-second of the length wide (one length each below
32). The overlap grows with both lengths, so the smallest lengths of two bands give an O that holds for
every pair from them. O and l depend on the pair of bands alone, both sides know them, and the pair is part
of the key. A string meets some ten bands whatever its length, and has at most a few dozen keys for each
(one per token where many misses are allowed), so the number of keys grows in proportion to the length.

The keys two strings share are the l-subsets of the tokens both prefixes have. One of them is taken as theirs: the first l of
these tokens in the common order (:func:`meets_first`). A join on keys that keeps only this one gives each pair once.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LETTERS = 200  # letters that are ranked by frequency; all others sort before them
_REPEAT_STEP = 6  # a further occurrence of a letter ranks this many places rarer
_WHOLE = 12  # key length when no miss is allowed
_SUBSET_SIZE = {1: 6, 2: 5, 3: 4, 4: 3, 5: 3, 6: 2, 7: 2, 8: 2, 9: 2, 10: 2, 11: 2, 12: 2}  # allowed misses -> l; beyond: 1


def letter_order(df: DataFrame, key: str) -> str:
    """The most frequent letters of ``df[key]``, rare to common: a good order for the tokens of both sides."""
    letters = df.select(F.explode(F.split(key, "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    common = letters.orderBy(F.desc("n"), "c").limit(_LETTERS).collect()
    return "".join(r["c"] for r in reversed(common))


def _subset_table() -> str:
    """SQL map ``'prefix_l' -> all l-subsets of positions 1..prefix``."""
    entries = []
    for size in sorted(set(_SUBSET_SIZE.values())):
        for prefix in range(size, max(k for k, v in _SUBSET_SIZE.items() if v >= size) + size + 1):
            subsets = ",".join(f"array({','.join(map(str, c))})" for c in combinations(range(1, prefix + 1), size))
            entries.append(f"'{prefix}_{size}',array({subsets})")
    return f"map({','.join(entries)})"


def max_blocked_distance() -> float:
    """From here on the bound no longer limits the length ratio, so blocking cannot help."""
    return 1.0 / 3.0


def _width(length: str) -> str:
    """Width of the band of a length: a power of two, 1 below 32."""
    return f"shiftleft(1, greatest(length(bin({length})) - 5, 0))"


def _low(length: str) -> str:
    """Smallest length of the band of a length."""
    return f"({length} - {length} % {_width(length)})"


def with_signatures(df: DataFrame, key: str, max_distance: float, role: str, letters: str = "") -> DataFrame:
    """One row per blocking key of ``df[key]``, in the column ``sig``.

    ``role`` is ``"query"`` or ``"reference"``; the two sides order the pair of bands differently. ``letters``
    (rare to common, see :func:`letter_order`) must be the same on both sides. ``_ids``, ``_band``, ``_partner``
    and ``_size`` are what :func:`meets_first` needs.
    """
    if not 0 <= max_distance < max_blocked_distance():
        raise ValueError("max_distance must lie in [0, 1/3)")
    if role not in ("query", "reference"):
        raise ValueError("role must be 'query' or 'reference'")
    slack = 1e-9
    ratio = 1.0 - 3.0 * max_distance
    weight = 2.0 - 3.0 * max_distance
    carried = [c for c in df.columns]
    own, other = ("_band", "_partner") if role == "query" else ("_partner", "_band")
    size_rule = " ".join(f"when {k} then {v}" for k, v in _SUBSET_SIZE.items())
    quoted = letters.replace("\\", "\\\\").replace("'", "\\'")
    rank = f"greatest(500 + instr('{quoted}', c) - {_REPEAT_STEP} * (i + 1 - array_position(_chars, c)), 0)"
    near = f"sequence(cast(ceil({ratio!r}D * _len - {slack!r}D) as int), cast(floor(_len / {ratio!r}D + {slack!r}D) as int))"
    pairs = (
        df.withColumn("_len", F.length(key))
        .where(F.col("_len") > 0)
        .withColumn("_chars", F.expr(f"array_sort(transform(sequence(1, _len), i -> substring(`{key}`, i, 1)))"))
        .withColumn(
            "_tokens",
            F.expr(
                f"array_sort(transform(_chars, (c, i) -> concat(lpad(cast({rank} as string), 3, '0'), c,"
                " cast(i + 1 - array_position(_chars, c) as string))))"
            ),
        )
        .withColumn("_band", F.expr(_low("_len")))
        .withColumn("_partner", F.explode(F.expr(f"array_distinct(transform(filter({near}, p -> p > 0), p -> {_low('p')}))")))
        .withColumn("_need", F.expr(f"cast(ceil({weight!r}D * _band * _partner / (_band + _partner) - {slack!r}D) as int)"))
        .withColumn("_longest", F.expr(f"greatest(_band + {_width('_band')}, _partner + {_width('_partner')}) - 1"))
        .where(f"_need <= least(_len, _partner + {_width('_partner')} - 1)")
        .withColumn("_size", F.expr(f"least(_need, case _longest - _need when 0 then {_WHOLE} {size_rule} else 1 end)"))
        .withColumn("_ids", F.expr("transform(slice(_tokens, 1, _len - _need + _size), t -> xxhash64(t))"))
    )
    key_of = lambda ids: f"xxhash64({own}, {other}, {ids})"
    sigs = F.expr(
        "case"
        f" when _longest = _need then array({key_of('_ids')})"
        f" when _size = 1 then transform(_ids, t -> {key_of('array(t)')})"
        f" else transform(element_at({_subset_table()}, concat(size(_ids), '_', _size)),"
        f" s -> {key_of('transform(s, p -> element_at(_ids, p))')}) end"
    )
    bands = [F.col(own).alias("_band"), F.col(other).alias("_partner")]
    return pairs.select(*carried, "_ids", *bands, "_size", F.explode(sigs).alias("sig"))


def meets_first(sig: Column, own_ids: Column, other_ids: Column, band: Column, partner: Column, size: Column) -> Column:
    """Whether ``sig`` is the one of the keys two strings share that counts as theirs; bands as the query sees them."""
    return F.xxhash64(band, partner, F.slice(F.array_intersect(own_ids, other_ids), 1, size)) == sig
