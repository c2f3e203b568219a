"""Company linkage: exact key first, then the nearest key within a Jaro distance."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.jaro import jaro_distance, jaro_nearest
from panelweave.functions.names import company_key
from panelweave.functions.signatures import letter_order, meets_first, with_signatures
from panelweave.operators.skew import hot_split_join
from panelweave.session import written

STRICT, LOOSE = 0.03, 0.06
BLOCK = 2000  # rows of one blocking key that meet in a task, on either side


def company_reference(register: DataFrame, name: str = "real_name", code: str = "sic", order: str = "cik") -> DataFrame:
    """Register rows with a code and a non-empty key, the first by ``order`` per key, as ``ref_norm``.

    A grouped minimum replaces a window: it combines before the shuffle, so a key that many rows
    share costs one row per task. Rows are grouped by name first, so a name that many rows repeat is made a key once.
    """
    columns = register.columns
    ranked = [order, name] + [c for c in columns if c not in (order, name)]
    named = register.where(F.col(code).isNotNull() & F.col(name).isNotNull()).groupBy(F.col(name).alias("_name")).agg(F.min(F.struct(*ranked)).alias("_r"))
    keyed = named.withColumn("ref_norm", company_key(F.col("_name"))).where(F.col("ref_norm") != "")
    first = keyed.groupBy("ref_norm").agg(F.min("_r").alias("_r"))
    return first.select("ref_norm", *[F.col(f"_r.{c}").alias(c) for c in columns])


@dataclass(frozen=True)
class Matcher:
    """A register made ready once and reused by every batch of strings: reference rows, letters and blocking keys."""

    reference: DataFrame
    index: DataFrame
    letters: str
    loose: float


def build_matcher(register: DataFrame, loose: float = LOOSE, *, name: str = "real_name", code: str = "sic",
                  order: str = "cik") -> Matcher:
    """Deduplicate a register and write it and its blocking keys for ``loose`` to the shared folder."""
    return matcher_of(written(company_reference(register, name, code, order), "reference"), loose)


def matcher_of(reference: DataFrame, loose: float, key: str = "ref_norm") -> Matcher:
    """Write the blocking keys of a reference that is written already, for the distance ``loose``."""
    letters = letter_order(reference, key)
    index = written(with_signatures(reference.select(key), key, loose, "reference", letters), "reference-index")
    return Matcher(reference, index, letters, loose)


def candidate_pairs(queries: DataFrame, reference: DataFrame | Matcher, max_distance: float, *,
                    query_key: str = "query_norm", ref_key: str = "ref_norm", block: int = BLOCK) -> DataFrame:
    """All (query, reference) key pairs within ``max_distance``, with ``distance``, each once.

    Each key value must occur once per side. A matcher's index must have been built for the same distance.
    Blocking keys of both sides are written (this runs jobs) and counted. Where both sides of a blocking key
    are large, they are cut into blocks of ``block`` rows that meet in a grid, so no task compares a large
    group with a large group. A pair that shares several blocking keys is taken at the first of them only, told from
    the rows themselves, so pairs are neither gathered nor shuffled.
    """
    if isinstance(reference, Matcher):
        if reference.loose != max_distance:
            raise ValueError(f"the matcher was built for distance {reference.loose}, not {max_distance}")
        matcher = reference
    else:
        matcher = matcher_of(reference, max_distance, ref_key)
    left = written(with_signatures(queries.select(query_key), query_key, max_distance, "query", matcher.letters), "query-index")
    n_left, n_right = (side.groupBy("sig").agg(F.count("*").alias(n)) for side, n in ((left, "_l"), (matcher.index, "_r")))
    large = n_left.join(n_right, "sig").where(F.col("_l") * F.col("_r") > block * block)
    cuts = [F.ceil(F.col(n) / block).cast("int").alias(c) for n, c in (("_l", "_rows"), ("_r", "_columns"))]
    large = written(large.select("sig", *cuts), "large-signatures")

    def dealt(side: DataFrame, key: str, own: str, across: str, *more: Column) -> DataFrame:
        marked = side.join(large, "sig", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_rows", "_columns")})
        place = F.pmod(F.xxhash64(key), F.col("_rows" if own == "_i" else "_columns")).cast("int")
        copies = F.sequence(F.lit(0), F.col("_columns" if own == "_i" else "_rows") - 1)
        return marked.withColumn(own, place).withColumn(across, F.explode(copies)).select("sig", "_i", "_j", key, *more)

    queried = dealt(left, query_key, "_i", "_j", F.col("_ids"), F.col("_band"), F.col("_partner"), F.col("_size"))
    met = queried.join(dealt(matcher.index, ref_key, "_j", "_i", F.col("_ids").alias("_ref_ids")), ["sig", "_i", "_j"])
    first = meets_first(F.col("sig"), F.col("_ids"), F.col("_ref_ids"), F.col("_band"), F.col("_partner"), F.col("_size"))
    return (
        met.where(first).select(query_key, ref_key)
        .withColumn("distance", jaro_distance(F.col(query_key), F.col(ref_key)))
        .where(F.col("distance") <= max_distance + 1e-12)
    )


def nearest(pairs: DataFrame, reference: DataFrame, *, query_key: str = "query_norm", ref_key: str = "ref_norm",
            order: str = "cik") -> DataFrame:
    """Per query the pair with the smallest distance; ties go to the first reference row by ``order``."""
    ordered = pairs.join(reference.select(ref_key, order), ref_key)
    return (
        ordered.groupBy(query_key)
        .agg(F.min(F.struct("distance", order, ref_key)).alias("_b"))
        .select(query_key, F.col("_b.distance").alias("distance"), F.col(f"_b.{ref_key}").alias(ref_key))
    )


def closest(queries: DataFrame, *matchers: Matcher, query_key: str = "query_norm", ref_key: str = "ref_norm",
            order: str = "cik", block: int = BLOCK) -> DataFrame:
    """Per query key the nearest reference key at whatever distance; ties go to the first reference row by ``order``.

    Matchers of one reference, narrow ones first, each find what lies within their distance and leave the rest to the next,
    whose blocking keys are more and costlier. Only queries without a key there meet the whole reference: both are cut into
    blocks of some ``block`` keys, every pair of blocks is a row of its own, and the nearest key of each query leaves it, so
    pairs are never rows. Their number is the product of both sides; most are told apart by the letters they have in common.
    """
    keys = {"query_key": query_key, "ref_key": ref_key}
    rows, near, rest = matchers[0].reference, [], queries.where(F.length(query_key) > 0).select(query_key)
    for matcher in matchers:
        pairs = candidate_pairs(rest, matcher, matcher.loose, **keys, block=block)
        near.append(written(nearest(pairs, rows, **keys, order=order), "near"))
        rest = written(rest.join(near[-1], query_key, "left_anti"), "far")
    near = reduce(DataFrame.unionByName, near)
    n_left, n_right = rest.count(), rows.count()
    if not n_left or not n_right:
        return near
    cut = [math.ceil(n / block) for n in (n_left, n_right)]
    # sorted, so that the first of equally near keys is the one to take, and a task that runs again makes the same blocks
    gathered = lambda row, name: F.sort_array(F.collect_list(row)).alias(name)
    left = rest.groupBy(F.pmod(F.xxhash64(query_key), F.lit(cut[0]))).agg(gathered(query_key, "_texts")).select("_texts")
    right = rows.groupBy(F.pmod(F.xxhash64(ref_key), F.lit(cut[1]))).agg(gathered(F.struct(order, ref_key), "_rows")).select("_rows")
    cells = left.crossJoin(right).repartition(cut[0] * cut[1])
    named = lambda f: F.struct(
        f["text"].alias(query_key), F.struct(F.round(f["distance"], 12).alias("distance"), F.get("_rows", f["place"]).alias("row")).alias("_b"))
    found = cells.select(F.inline(F.transform(jaro_nearest(F.col("_texts"), F.col(f"_rows.{ref_key}")), named)))
    best = found.groupBy(query_key).agg(F.min("_b").alias("_b"))
    return near.unionByName(best.select(query_key, F.col("_b.distance").alias("distance"), F.col(f"_b.row.{ref_key}").alias(ref_key)))


def match_status(match_type: Column, distance: Column, strict: float = STRICT, loose: float = LOOSE) -> Column:
    """``auto_accept``, ``needs_review`` or ``no_match`` from the tier and the distance."""
    return (
        F.when(match_type == "exact", "auto_accept")
        .when((match_type == "fuzzy") & (distance <= strict), "auto_accept")
        .when((match_type == "fuzzy") & (distance <= loose), "needs_review")
        .otherwise("no_match")
    )


def _rows_of(reference: DataFrame | Matcher) -> DataFrame:
    return reference.reference if isinstance(reference, Matcher) else reference


def link_keys(keys: DataFrame, reference: DataFrame | Matcher, loose: float = LOOSE, order: str = "cik") -> DataFrame:
    """Per distinct non-empty key: ``ref_norm``, ``distance`` and ``match_type`` (exact, fuzzy or none)."""
    known = _rows_of(reference).select("ref_norm").withColumn("_hit", F.lit(True))
    tiered = keys.join(known, keys.query_norm == known.ref_norm, "left").select("query_norm", "_hit")
    tiered = written(tiered, "exact-tier")
    # the costly tier sees only what the cheap tier left over
    rest = tiered.where(F.col("_hit").isNull())
    close = nearest(candidate_pairs(rest, reference, loose), _rows_of(reference), order=order)
    return tiered.join(close, "query_norm", "left").select(
        "query_norm",
        F.when(F.col("_hit"), F.col("query_norm")).otherwise(F.col("ref_norm")).alias("ref_norm"),
        F.when(F.col("_hit"), F.lit(0.0)).otherwise(F.col("distance")).alias("distance"),
        F.when(F.col("_hit"), "exact").when(F.col("ref_norm").isNotNull(), "fuzzy").otherwise("none").alias("match_type"),
    )


def link_companies(rows: DataFrame, reference: DataFrame | Matcher, column: str = "employer", *, strict: float = STRICT,
                   loose: float = LOOSE, name: str = "real_name", order: str = "cik") -> DataFrame:
    """One row per distinct raw string with its match, and ``n_rows``, how often it occurs.

    Raw strings are grouped (not collected) first, their keys grouped again, and only distinct keys
    are linked. Reference columns come along; ``name`` is renamed ``matched_name``. With a
    :class:`Matcher`, ``loose`` must be the distance it was built for; another reference is written first.
    """
    if loose < strict:
        raise ValueError("loose must not be smaller than strict")
    if not isinstance(reference, Matcher):
        reference = written(reference, "reference")  # both tiers and the attributes read it
    raw = (
        rows.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("employer_raw"))
        .agg(F.count("*").alias("n_rows"))
        .withColumn("query_norm", company_key(F.col("employer_raw")))
    )
    keys = raw.where(F.col("query_norm") != "").select("query_norm").distinct()
    linked = link_keys(keys, reference, loose, order)
    attributes = _rows_of(reference).withColumnRenamed(name, "matched_name")
    matched = linked.join(attributes, "ref_norm", "left")
    match_type = F.coalesce("match_type", F.lit("none"))
    return (
        raw.join(matched, "query_norm", "left")
        .withColumn("match_type", match_type)
        .withColumn("status", match_status(F.col("match_type"), F.col("distance"), strict, loose))
        .drop("query_norm", "ref_norm")
    )


def accepted(matches: DataFrame) -> DataFrame:
    """Accepted matches with a non-empty raw string; already one row per raw string."""
    return matches.where((F.col("status") == "auto_accept") & (F.length("employer_raw") > 0))


def attach_matches(rows: DataFrame, matches: DataFrame, column: str = "employer", how: str = "left",
                   keep: Sequence[str] | None = None) -> DataFrame:
    """Join all match results back to all rows by raw string; ``how="inner"`` keeps accepted matches only.

    One raw string may hold a third of all rows, matched or not. ``matches`` must therefore be the
    full result of :func:`link_companies`: its ``n_rows`` says which strings are frequent, so their
    rows are joined to a short broadcast list and never meet in one task.
    """
    keep = list(keep or [c for c in matches.columns if c not in ("employer_raw", "n_rows")])
    wanted = keep if "status" in keep else [*keep, "status"]
    right = matches.select(F.col("employer_raw").alias(column), "n_rows", *wanted)
    joined = hot_split_join(rows, right, [column], count="n_rows")
    if how == "inner":
        joined = joined.where((F.col("status") == "auto_accept") & (F.length(column) > 0))
    return joined.select(*rows.columns, *keep)


def status_counts(matches: DataFrame) -> DataFrame:
    """Match coverage: rows per status and tier, most frequent first."""
    return matches.groupBy("status", "match_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status", "match_type")


def match_propensity(rows: DataFrame, matches: DataFrame, column: str = "employer") -> DataFrame:
    """Share of all rows whose string was accepted, from the counts carried by the matches."""
    total = rows.agg(F.count("*").alias("n_total"))
    hit = accepted(matches).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_matched"))
    n_total, n_matched = total.scalar(), F.col("n_matched")
    return hit.select(
        n_matched.cast("long").alias("n_matched"),
        n_total.cast("long").alias("n_total"),
        (n_matched / n_total).alias("match_propensity"),
    )
