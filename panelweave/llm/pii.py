"""Personal data: fixed patterns, and terms that disclose a protected entity by information content.

The patterns give the protected entities (an address, a number). Beyond them, a term can give an entity away
by the company it keeps. Most entities occur once, so evidence is gathered for two keys of each: the value itself and the
group it belongs to (the domain of an address, the first three parts of an ip, the first digits of a number). For a key
e and a term t, with counts over the whole corpus and one context of an entity counted once however often it is copied,

    PMI(t; e) = log2( P(t | context of e) / P(t in any window) ),   IC(e) = -log2 P(e),

where P(t | context of e) is smoothed by one context of chance. PMI / IC is the share of the key's information that the
term reveals. A pair is evidence when coincidences as strong, over all pairs of the corpus, are expected less than
``CHANCE`` times (Chernoff's bound of the Poisson tail), so the support that is needed follows from the counts. A term with
evidence that reaches ``GENERALISE`` is replaced by its class in every document that holds an entity of the key; one that reaches
``REMOVE`` is removed.

Everything is DataFrame operations. The pairs counted are those of an entity and the at most ``2 * REACH``
terms around it, so they grow with the text. Terms are counted over all words of all documents before they
meet the candidate pairs, hence no frequent word or entity ever gathers in one task; a key that many documents hold is split
when its terms are handed to them. Positions inside a text are running sums, by blocks of ``_BLOCK`` matches, so a text with many
matches takes time in proportion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.llm.common import texts
from panelweave.operators.skew import hot_split_join
from panelweave.session import written

#: Terms on either side of an entity that count as its context.
REACH = 8
#: Coincidences as strong as a pair that counts, expected over all pairs.
CHANCE = 0.01
#: Shares of an entity's information from which a term is generalised or removed.
GENERALISE, REMOVE = 0.7, 0.95
#: Terms shorter than this disclose nothing.
LEAST_LETTERS = 3
_BLOCK = 256

KINDS = ("email", "ip", "card", "phone", "term")
# The patterns of the contract, with possessive runs and guards that spare failing starts.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A word: a run without ASCII characters other than letters and digits.
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _valid(kind: str, hit: Column) -> Column:
    """Whether a match of the pattern counts."""
    if kind == "ip":
        parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, r"^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(F.lit(False)))
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it, inside further lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _located(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column]) -> Column:
    """Matches that count, in order: start, kind, end, value and the words next to it on both sides.

    The pieces between matches give the positions. They are added up by blocks: first the blocks' sizes, then inside
    each block, since a running total in an array copies what it has so far.
    """
    length = lambda c: c["gap"] + F.coalesce(F.length(c["hit"]), F.lit(0))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string,before:array<string>,after:array<string>>>")

    def step(acc: Column, cell: Column) -> Column:
        start, end = acc["at"] + cell["gap"], acc["at"] + length(cell)
        found = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), cell["hit"].alias("value"), cell["before"].alias("before"), cell["after"].alias("after"))
        taken = F.when(cell["hit"].isNotNull(), keep(cell["hit"])).otherwise(F.lit(False))
        return F.struct(end.alias("at"), F.when(taken, F.concat(acc["found"], F.array(found))).otherwise(acc["found"]).alias("found"))

    def inside(block: Column, begin: Column) -> Column:
        return F.aggregate(block, F.struct(begin.alias("at"), none.alias("found")), step, lambda acc: acc["found"])

    def beside(gaps: Column) -> Column:
        words = F.transform(gaps, lambda g: F.struct(F.length(g).alias("gap"), F.filter(F.split(g, _BREAK), lambda w: F.length(w) > 0).alias("w")))
        return F.transform(words, lambda g: F.struct(
            g["gap"].alias("gap"), F.slice(g["w"], F.greatest(F.size(g["w"]) - REACH + 1, F.lit(1)), REACH).alias("before"), F.slice(g["w"], 1, REACH).alias("after"),
        ))

    def cells(sides: Column) -> Column:
        joined = F.arrays_zip(sides.alias("side"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.slice(sides, 2, 1 << 30).alias("next"))
        return F.transform(joined, lambda c: F.struct(c["side"]["gap"].alias("gap"), c["hit"].alias("hit"), c["side"]["before"].alias("before"), c["next"]["after"].alias("after")))

    def blocks(every: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / _BLOCK).cast("int")), lambda b: F.slice(every, b * _BLOCK + 1, _BLOCK))

    def placed(parts: Column) -> Column:
        sizes = F.transform(parts, lambda b: F.aggregate(b, F.lit(0), lambda n, c: n + length(c)))
        begins = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.flatten(F.zip_with(parts, F.slice(begins, 1, F.size(parts)), inside))

    run = _let(beside(F.split(text, pattern, -1)), lambda sides: _let(cells(sides), lambda every: _let(blocks(every), placed)))
    return F.when(text.rlike(pattern), run).otherwise(none)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame) -> DataFrame:
    """Per document the base spans; the text, its key and the contexts only where there is a span."""
    found = texts(docs).select(
        "doc_id", "text",
        *[_located(F.col("text"), p, i, lambda h, k=k: _valid(k, h)).alias(f"_{k}") for i, (k, p) in enumerate(PATTERNS.items())],
    )
    rows = found.withColumn("entities", F.concat(*[F.col(f"_{k}") for k in PATTERNS]))
    any_found = F.size("entities") > 0
    return rows.select(
        "doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.array_sort(_plain(F.col("entities"))).alias("base"),
        F.when(any_found, F.col("entities")).alias("entities"),
        F.when(any_found, F.col("text")).alias("text"),
        F.when(any_found, F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 256)).alias("row"),
    )


def _keys(entity: Column) -> Column:
    """What evidence is gathered for: the value and its group, marked by the kind."""
    value, digits = entity["value"], F.regexp_replace(entity["value"], "[^0-9]", "")
    group = (
        F.when(entity["kind"] == 0, F.lower(F.substring_index(value, "@", -1)))
        .when(entity["kind"] == 1, F.substring_index(value, ".", 3))
        .when(entity["kind"] == 2, F.substring(digits, 1, 6))
        .otherwise(F.substring(digits, 1, 5))
    )
    mark = F.get(F.array(*[F.lit(k) for k in KINDS]), entity["kind"])
    return F.array(F.concat_ws("=", mark, value), F.concat_ws("~", mark, group))


def _terms_beside(entity: Column) -> Column:
    """The terms within reach of an entity, each once."""
    near = F.transform(F.concat(entity["before"], entity["after"]), F.lower)
    return F.array_sort(F.array_distinct(F.filter(near, lambda w: F.length(w) >= LEAST_LETTERS)))


def disclosing_terms(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """Pairs (key, term, share) with evidence that the term reveals at least ``GENERALISE`` of the key. Runs jobs."""
    met = scanned.filter(F.col("entities").isNotNull()).select(F.explode("entities").alias("e"))
    met = met.select(F.explode(_keys(F.col("e"))).alias("key"), _terms_beside(F.col("e")).alias("terms")).distinct()
    met = written(met, "pii-contexts")
    of_key = met.groupBy("key").agg(F.count("*").alias("n_key"))
    joint = met.select("key", F.explode("terms").alias("term")).groupBy("key", "term").agg(F.count("*").alias("n_joint"))
    joint = written(joint.join(of_key, "key"), "pii-pairs")
    pairs = joint.count() or 1
    words = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), _BREAK)).alias("term")).filter(F.length("term") > 0)
    counts = written(words.groupBy("term").agg(F.count("*").alias("n_term")), "pii-words")
    per_word = 2.0 * REACH / (counts.agg(F.sum("n_term")).first()[0] or 1)  # windows a word may be met in
    joined = counts.join(joint, "term")
    p_term = F.least(F.lit(1.0), F.col("n_term") * per_word)
    p_key = F.least(F.lit(1.0), F.col("n_key") * per_word)
    by_chance = F.col("n_key") * p_term
    tail = F.col("n_joint") - by_chance + F.col("n_joint") * F.log(by_chance / F.col("n_joint"))
    evidence = (F.col("n_joint") > by_chance) & (tail + F.log(F.lit(float(pairs))) <= F.log(F.lit(CHANCE)))
    pmi = F.log2((F.col("n_joint") + p_term) / (F.col("n_key") + 1) / p_term)
    share = F.when(p_key < 1.0, F.least(F.lit(1.0), pmi / -F.log2(p_key))).otherwise(F.lit(0.0))
    return joined.filter(evidence).select("key", "term", share.alias("share")).filter(F.col("share") >= GENERALISE)


def _with_terms(scanned: DataFrame, terms: DataFrame) -> DataFrame:
    """Documents that hold an entity, with the spans of the terms that disclose one of their entities.

    Only documents with a key that has terms are read word by word. A key's terms are one row: each met the key in
    several contexts of at most ``2 * REACH`` terms.
    """
    rows = scanned.filter(F.col("row").isNotNull())
    hints = terms.groupBy("key").agg(F.collect_list(F.struct("term", "share")).alias("hints"))
    holds = rows.select("row", F.explode(F.array_distinct(F.flatten(F.transform("entities", _keys)))).alias("key")).distinct()
    holds = written(holds.join(terms.select("key").distinct(), "key", "left_semi"), "pii-holders")
    by_key = hints.join(holds.groupBy("key").agg(F.count("*").alias("n")), "key")
    told = hot_split_join(holds, by_key, ["key"], count="n").select("row", F.explode("hints").alias("h"))
    told = written(told.groupBy("row", F.col("h")["term"].alias("term")).agg(F.max(F.col("h")["share"]).alias("share")), "pii-told")
    read = rows.join(told.select("row").distinct(), "row", "left_semi").select("row", "text", "base").dropDuplicates(["row"])
    pieces = F.arrays_zip(F.split("text", _WORD, -1).alias("gap"), F.array_remove(F.split("text", _BREAK), "").alias("word"))
    read = written(read, "pii-read")
    cells = read.select("row", F.posexplode(pieces).alias("i", "p")).select("row", "i", F.length("p.gap").alias("gap"), F.col("p.word").alias("value"))
    in_order = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.coalesce(F.length("value"), F.lit(0))).over(in_order)
    words = cells.select("row", "value", end.cast("int").alias("end")).filter(F.col("value").isNotNull())
    words = words.withColumn("term", F.lower("value")).join(told, ["row", "term"])
    found = words.select("row", (F.col("end") - F.length("value")).cast("int").alias("start"), "end", "value", "share", F.lit(False).alias("own"))
    known = read.select("row", F.explode("base").alias("b")).select("row", "b.start", "b.end", F.lit(None).cast("string").alias("value"), F.lit(None).cast("double").alias("share"), F.lit(True).alias("own"))
    every = found.unionByName(known)
    # the latest end of a base span that starts no later, and the earliest start of one that starts no earlier
    up = Window.partitionBy("row").orderBy("start", F.desc("own")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("own")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beside = every.withColumn("reach", F.max(F.when(F.col("own"), F.col("end"))).over(up)).withColumn("ahead", F.min(F.when(F.col("own"), F.col("start"))).over(down))
    free = beside.filter(~F.col("own") & (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("ahead"), F.col("end")) >= F.col("end")))
    span = F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end", "value", "share")
    return rows.join(free.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("terms")), "row", "left")


def find(docs: DataFrame) -> DataFrame:
    """One row per document: counts per kind, base spans, term spans with their shares, the text where there is a span."""
    source = texts(docs)
    scanned = written(scan(source), "pii-scan")
    terms = written(disclosing_terms(source, scanned), "pii-terms")
    counts = [f"n_{k}" for k in PATTERNS]
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string,share:double>>")
    without = scanned.filter(F.col("row").isNull()).select("doc_id", *counts, "base", none.alias("terms"), "text")
    held = _with_terms(scanned, terms).select("doc_id", *counts, "base", F.coalesce("terms", none).alias("terms"), "text")
    return without.unionByName(held)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, ordered by start and kind, comma-joined. Null and
    empty texts have none; repeated rows repeat; an empty table gives no rows; other columns are ignored. Spans of different
    kinds may overlap and are all told; a term inside a base span is not. A text of any length and with any number of spans is read
    whole, in time proportional to it.
    """
    found = find(docs)
    every = F.array_sort(F.concat(F.col("base"), _plain(F.col("terms"))))
    return found.select(
        "doc_id", *[f"n_{k}" for k in PATTERNS], F.size("terms").cast("long").alias("n_term"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"),
    )


def sanitised(docs: DataFrame) -> DataFrame:
    """Documents that hold personal data, with the text in which entities and disclosing terms are replaced.

    Entities become their kind in brackets. A term becomes [NUMBER], [NAME] (it starts with a capital) or
    [TERM], or nothing when its share reaches ``REMOVE``. Of overlapping spans the first stands.
    """
    rows = find(docs).filter(F.col("text").isNotNull())
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    entities = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("by")))

    def general(s: Column) -> Column:
        shape = F.when(s["value"].rlike("^[0-9]+$"), "[NUMBER]").when(s["value"].rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")
        by = F.when(s["share"] >= REMOVE, "").otherwise(shape)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), by.alias("by"))

    spans = F.array_sort(F.concat(entities, F.transform("terms", general)))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        taken = s["start"] >= acc["at"]
        return F.struct(
            F.when(taken, s["end"]).otherwise(acc["at"]).alias("at"),
            F.when(taken, F.concat(acc["out"], F.array(before, s["by"]))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    text = F.aggregate(spans, start, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(F.col("text"), acc["at"] + 1, F.lit(1 << 30)))), ""))
    return rows.select("doc_id", text.alias("text"))
