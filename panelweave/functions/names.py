"""Name normalisation as column expressions: company keys and person name parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Legal-form words, titles and suffixes that carry no identity, and the words that
# mark an owner as an entity and not a person.
LEGAL_FORMS = (
    "inc", "incorporated", "corp", "corporation", "co", "company",
    "llc", "llp", "ltd", "limited", "plc", "lp",
)
NAME_AFFIXES = ("JR", "SR", "II", "III", "IV", "V", "MD", "PHD", "DR", "MR", "MRS", "MS")
ENTITY_WORDS = (
    r"L\.?L\.?C", r"L\.?L\.?P", r"L\.?P", "INC", "CORP", "COMPANY", "TRUST", "TR", "PARTNERS",
    "PARTNERSHIP", "FUND", "FUNDS", "CAPITAL", "HOLDINGS", "GROUP", "VENTURES", "MANAGEMENT",
    "ASSOCIATES", "ASSET", "ADVISORS", "LTD", "PLC", "GMBH", r"N\.?V", r"S\.?A", "FOUNDATION",
    "ENDOWMENT", "FAMILY",
)
APOSTROPHES = "'’`"


def squish(text: Column) -> Column:
    """Collapse runs of white space and trim both ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _whole_word(words: tuple[str, ...]) -> str:
    return r"(?U)\b(" + "|".join(words) + r")\b"


def company_key(name: Column) -> Column:
    """Comparison key of a company: lower case, no punctuation, no legal form, single spaces.

    Only Unicode punctuation (class P) is removed; symbols such as ``+`` or ``$`` stay.
    """
    spaced = F.regexp_replace(F.lower(name), r"\p{P}", " ")
    return squish(F.regexp_replace(spaced, _whole_word(LEGAL_FORMS), ""))


def _person_text(name: Column, surname_first: bool) -> Column:
    """Upper-case ``SURNAME, GIVEN NAMES`` text.

    Marks inside a token are deleted (O'BRIEN becomes OBRIEN), anything else that is not a letter,
    comma or space separates tokens. Register names have no comma: one goes after the first token.
    """
    joined = F.regexp_replace(F.upper(name), f"[.{APOSTROPHES}-]", "")
    spaced = F.regexp_replace(joined, "[^A-Z, ]", " ")
    text = squish(F.regexp_replace(spaced, _whole_word(NAME_AFFIXES), ""))
    return F.regexp_replace(text, r"^(\S+)\s+", "$1, ") if surname_first else text


def with_person_parts(df: DataFrame, name: str, surname_first: bool = False,
                      into: tuple[str, str, str] = ("last", "first", "mi")) -> DataFrame:
    """Append surname, first name and middle initial of a person, each NULL when absent.

    ``surname_first=False`` reads ``SMITH, JOHN A``; ``True`` reads the register form ``Smith John A``.
    The shared text is a column of its own, so that its chain of patterns runs once per row. The parts
    leave through a generator: a later test on them then stays above it, where a test moved down to
    the scan would run the whole chain again.
    """
    staged = df.withColumn("_text", _person_text(F.col(name), surname_first))
    staged = staged.withColumn("_given", F.trim(F.regexp_replace("_text", r"^[^,]*,?", "")))
    token = lambda i: F.split_part("_given", F.lit(" "), F.lit(i))
    raw = (F.trim(F.regexp_extract("_text", r"^([^,]*)", 1)), token(1), F.substring(token(2), 1, 1))
    parts = staged.select(*df.columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in zip(into, raw, strict=True)]))))
    return parts.withColumns({n: F.when(F.col(n) != "", F.col(n)) for n in into})


def looks_like_entity(name: Column) -> Column:
    """True for trusts, funds and companies that file under an owner name."""
    return F.upper(name).rlike(_whole_word(ENTITY_WORDS))
