"""Company insiders: from filings to person-year rows, spells, and links to panel people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.names import looks_like_entity, with_person_parts
from panelweave.functions.picks import first_by, longest
from panelweave.functions.scores import clean_ticker, even_cycle, filing_date, padded_id
from panelweave.operators.skew import hot_split_join

YEARS = (1995, 2100)


def event_columns(filed: str = "FILING_DATE", period: str = "PERIOD_OF_REPORT") -> dict[str, Column]:
    """Dates of a filing: as filed, as reported, the event (reported, else filed) and its year.

    The year may be readable where the reported date is not.
    """
    on_file, reported = filing_date(F.col(filed)), filing_date(F.col(period))
    stated = F.right(F.trim(period), F.lit(4)).try_cast("int")
    return {"filed_date": on_file, "period_date": reported, "event": F.coalesce(reported, on_file), "year": F.coalesce(stated, F.year(on_file))}


def role_columns(relationship: str = "RPTOWNER_RELATIONSHIP") -> dict[str, Column]:
    """Officer and director flags of an owner row; no statement means neither."""
    stated = F.coalesce(F.upper(relationship), F.lit(""))
    return {"is_officer": stated.contains("OFFICER"), "is_director": stated.contains("DIRECTOR")}


def officer_filings(submissions: DataFrame, owners: DataFrame) -> DataFrame:
    """Officers and directors with what their filing says: event, year, issuer, ticker, initial statement or not.

    Either side is cut to the rows and columns that count before they meet.
    """
    number = F.col("ACCESSION_NUMBER").alias("accession")
    insider = owners.withColumns(role_columns()).where("(is_officer OR is_director) AND RPTOWNERNAME IS NOT NULL").select(
        number, padded_id(F.trim("RPTOWNERCIK")).alias("owner_cik"), F.trim("RPTOWNERNAME").alias("owner_name_raw"),
        "is_officer", "is_director", F.nullif(F.trim("RPTOWNER_TITLE"), F.lit("")).alias("owner_title"),
    )
    dates = {name: made for name, made in event_columns().items() if name in ("event", "year")}
    header = submissions.withColumns(dates).where(F.col("year").between(*YEARS)).select(
        number, *dates, padded_id(F.trim("ISSUERCIK")).alias("cik"), F.upper(F.trim("ISSUERNAME")).alias("issuer_name"),
        clean_ticker(F.col("ISSUERTRADINGSYMBOL")).alias("ticker"),
        F.upper(F.trim("DOCUMENT_TYPE")).startswith("3").alias("has_form3"),
    )
    return insider.join(header, "accession")


def person_years(submissions: DataFrame, owners: DataFrame) -> DataFrame:
    """One row per (owner, issuer, year). Picks without a natural order take the smallest value.

    Filings are dealt by owner and issuer, so years and spells (:func:`person_spells`) need no further shuffle. An owner
    has few filings a year at a firm, so aggregating before the shuffle would sort every row to save hardly any.
    """
    return (
        officer_filings(submissions, owners)
        .repartition("owner_cik", "cik")
        .groupBy("owner_cik", "cik", "year")
        .agg(
            longest(F.col("owner_name_raw")).alias("owner_name_raw"),
            F.min("issuer_name").alias("issuer_name"),
            F.max("ticker").alias("ticker"),
            F.bool_or("is_officer").alias("is_officer"),
            F.bool_or("is_director").alias("is_director"),
            F.bool_or("has_form3").alias("has_form3"),
            longest(F.col("owner_title")).alias("title_label"),
            F.min("event").alias("first_event"),
            F.max("event").alias("last_event"),
            F.count("*").alias("n_filings"),
        )
    )


def persons_only(years: DataFrame) -> DataFrame:
    """Drop entities and unparsable names; add the name parts."""
    people = years.where(~looks_like_entity(F.col("owner_name_raw")))
    named = with_person_parts(people, "owner_name_raw", surname_first=True, into=("last", "first", "middle_init"))
    return named.where(F.col("last").isNotNull() & F.col("first").isNotNull())


def _by_name(years: DataFrame, *more: str) -> DataFrame:
    """Per (owner, issuer, name) and ``more`` what :func:`_merged` needs of the years with that name.

    An owner hardly ever has two names at a firm, so a name is parsed once and not once a year.
    """
    known = F.col("ticker").isNotNull()
    return years.groupBy("owner_cik", "cik", "owner_name_raw", *more).agg(
        F.max(F.struct(F.col("n_filings"), -F.col("year"))).alias("_most"),
        F.min("year").alias("_from"),
        F.max("year").alias("_to"),
        F.min_by("issuer_name", "year").alias("issuer_name"),
        first_by(F.col("ticker"), F.col("year")).alias("ticker"),
        F.min(F.when(known, F.col("year"))).alias("_ticker_year"),
        longest(F.col("title_label")).alias("title_label"),
        F.bool_or("is_officer").alias("is_officer"),
        F.bool_or("is_director").alias("is_director"),
        F.min("first_event").alias("first_event"),
        F.max("last_event").alias("last_event"),
        F.sum("n_filings").alias("n_filings"),
        F.bool_or("has_form3").alias("has_form3"),
    )


def _merged(named: DataFrame) -> DataFrame:
    """Spells of names folded by :func:`_by_name`, with their parts."""
    earliest = F.min_by(F.struct("last", "first", "middle_init", "issuer_name"), "_from")
    out = named.groupBy("owner_cik", "cik").agg(
        F.max_by("owner_name_raw", "_most").alias("owner_name_raw"),
        earliest.alias("_e"),
        first_by(F.col("ticker"), F.col("_ticker_year")).alias("ticker"),
        longest(F.col("title_label")).alias("title_label"),
        F.bool_or("is_officer").alias("ever_officer"),
        F.bool_or("is_director").alias("ever_director"),
        F.min("first_event").alias("insider_from"),
        F.max("last_event").alias("insider_to"),
        F.min(even_cycle(F.col("_from"))).alias("cycle_from"),
        F.max(even_cycle(F.col("_to"))).alias("cycle_to"),
        F.sum("n_filings").alias("n_filings"),
        F.bool_or("has_form3").alias("has_form3"),
    )
    return out.select("*", "_e.*").drop("_e")


def spells(persons: DataFrame) -> DataFrame:
    """One row per (owner, issuer): validity in dates and cycles, and descriptive labels.

    Labels without a natural order come from the earliest year; the name from the year with most filings.
    """
    return _merged(_by_name(persons, "last", "first", "middle_init"))


def person_spells(years: DataFrame) -> DataFrame:
    """:func:`spells` of the persons among person-years, each name of an owner at a firm parsed once."""
    return _merged(persons_only(_by_name(years)))


def role_name(officer: Column, director: Column) -> Column:
    """``officer_director``, ``officer`` or ``director``."""
    return (
        F.when(officer & director, "officer_director").when(officer, "officer").when(director, "director")
    )


def _owner_buckets(reference: DataFrame) -> DataFrame:
    """Per (firm, surname, first name) the insiders by middle initial.

    Each initial keeps its smallest owner with attributes, its largest owner id and its counts: enough
    to tell whether exactly one owner fits. A key has at most one bucket per letter, so the array is
    short. The reference has one row per owner and firm; a name that many owners of a firm share is parsed once.
    """
    owner = F.struct(
        "owner_cik", "owner_name_raw", "issuer_name", "title_label", "ever_officer", "ever_director",
        "cycle_from", "cycle_to",
    )
    by_name = reference.groupBy(padded_id(F.col("cik")).alias("cik_j"), "owner_name_raw").agg(
        F.min(owner).alias("lo"), F.max("owner_cik").alias("hi"), F.count("*").alias("n")
    )
    named = with_person_parts(by_name, "owner_name_raw", surname_first=True, into=("c_last", "c_first", "i_mi"))
    named = named.where(F.col("c_last").isNotNull() & F.col("c_first").isNotNull())
    by_initial = named.groupBy("cik_j", "c_last", "c_first", "i_mi").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")
    )
    return by_initial.groupBy("cik_j", "c_last", "c_first").agg(
        F.collect_list(F.struct("i_mi", "lo", "hi", "n")).alias("buckets")
    )


def fitting_owners(people: DataFrame, reference: DataFrame) -> DataFrame:
    """Per (cid, cycle, firm) with a fitting insider: smallest (``lo``) and largest owner, and counts.

    An owner fits with the same firm, surname and first name, and initials that do not contradict; a
    missing initial fits any. ``people`` needs cid, cycle, cik and name. Distinct names per firm are parsed and
    resolved once, then joined back as they are written, so neither a common name nor a big firm multiplies rows.
    """
    rows = people.select("cid", "cycle", padded_id(F.col("cik")).alias("cik_j"), "name")
    names = rows.groupBy("cik_j", "name").agg(F.count("*").alias("n_rows"))
    parsed = with_person_parts(names, "name", into=("c_last", "c_first", "c_mi"))
    fits = F.filter("buckets", lambda b: F.col("c_mi").isNull() | b["i_mi"].isNull() | (b["i_mi"] == F.col("c_mi")))
    resolved = (
        parsed.join(_owner_buckets(reference), ["cik_j", "c_last", "c_first"], "left")
        .withColumn("fits", fits)
        .select(
            "cik_j", "name", "n_rows",
            F.array_min(F.transform("fits", lambda b: b["lo"])).alias("lo"),
            F.array_max(F.transform("fits", lambda b: b["hi"])).alias("hi"),
            F.aggregate("fits", F.lit(0).cast("long"), lambda total, b: total + b["n"]).alias("n_fit"),
        )
    )
    found = hot_split_join(rows, resolved, ["cik_j", "name"], count="n_rows").where(F.col("lo").isNotNull())
    return found.groupBy("cid", "cycle", "cik_j").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("name").alias("name"), F.sum("n_fit").alias("n_fitting"),
        F.max("n_fit").alias("n_owners"),
    )


def link_insiders(people: DataFrame, reference: DataFrame) -> DataFrame:
    """Panel people who are exactly one insider of their firm; see :func:`fitting_owners`.

    A person with two different fitting insiders is dropped altogether.
    """
    unique = fitting_owners(people, reference).where(F.col("lo.owner_cik") == F.col("hi"))
    return unique.select(
        "cid", "cycle", "cik_j", "name", "lo.*",
        F.lit(True).alias("is_sec_insider"),
        role_name(F.col("lo.ever_officer"), F.col("lo.ever_director")).alias("insider_role"),
    )


def coding_check(people: DataFrame, matched: DataFrame) -> DataFrame:
    """Occupation classes of linked insiders, with their share."""
    keys = ["cid", "cycle", "cik_j"]
    rows = people.withColumn("cik_j", padded_id(F.col("cik"))).join(matched.select(*keys).distinct(), keys, "left_semi")
    counts = rows.where(F.col("occupation_std").isNotNull()).groupBy("occupation_std").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("occupation_std", "n", (F.col("n") / total).alias("share")).orderBy(F.desc("n"), "occupation_std")
