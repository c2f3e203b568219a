"""Occupation classes from free text by keyword."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword lists, matched anywhere in the text and case-sensitive.
ENGINEER_WORDS = (
    "engineer", "software", "data", "java", "python", "full stack", "backend", "frontend",
    "it security", "developer", "devops", "systems administrator", "information systems",
    "programmer", "statistician", "machine learning", "computer",
)
MANAGER_WORDS = ("manager", "ceo", "cfo", "president", "director", "officer")


def mentions(text: Column, words: tuple[str, ...]) -> Column:
    """True where any of the words occurs in the text; NULL stays NULL."""
    return text.rlike("|".join(words))


def occupation_flags(text: Column) -> dict[str, Column]:
    """``occupation_std`` and its flags; every one is NULL for a NULL text."""
    engineer, manager = mentions(text, ENGINEER_WORDS), mentions(text, MANAGER_WORDS)
    return {
        "occupation_std": F.when(manager, "manager").when(engineer, "engineer").when(text.isNotNull(), "other"),
        "engineer": engineer,
        "manager": manager,
        "other": ~manager & ~engineer,
    }
