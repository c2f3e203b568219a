"""Model terms with explicit levels, and the columns they expand to."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Factor:
    """A categorical column; the first level is the reference."""

    name: str
    levels: tuple

    def reordered(self, reference) -> Factor:
        """The same factor with another reference level."""
        return Factor(self.name, (reference, *[v for v in self.levels if v != reference]))


@dataclass(frozen=True)
class Numeric:
    """A numeric covariate."""

    name: str


Variable = Factor | Numeric
Term = tuple[Variable, ...]


def main(*variables: Variable) -> list[Term]:
    """One main effect per variable."""
    return [(v,) for v in variables]


def crossed(*variables: Variable, order: int | None = None) -> list[Term]:
    """All products of the variables up to ``order`` (all orders by default), main effects first."""
    top = order or len(variables)
    return [c for size in range(1, top + 1) for c in combinations(variables, size)]


@dataclass(frozen=True)
class Column:
    """One column of the design: an indicator over factor levels times at most one covariate."""

    label: str
    levels: tuple[tuple[str, object], ...]
    numeric: str | None


def _label_value(value) -> str:
    return str(value).upper() if isinstance(value, bool) else str(value)


def _expand(term: Term) -> list[Column]:
    covariates = [v.name for v in term if isinstance(v, Numeric)]
    if len(covariates) > 1:
        raise ValueError("a term may hold one covariate; make a product column for more")
    choices = [[(v.name, level) for level in v.levels[1:]] for v in term if isinstance(v, Factor)]
    columns = []
    # the first factor varies fastest
    for pick in product(*reversed(choices)):
        chosen = tuple(reversed(pick))
        named = dict(chosen)
        label = ":".join(v.name + _label_value(named[v.name]) if isinstance(v, Factor) else v.name for v in term)
        columns.append(Column(label, chosen, covariates[0] if covariates else None))
    return columns


@dataclass(frozen=True)
class Design:
    """Intercept and terms in order; treatment coding against each factor's reference."""

    terms: tuple[Term, ...]

    @classmethod
    def of(cls, terms: Sequence[Term]) -> Design:
        unique = list(dict.fromkeys(tuple(t) for t in terms))
        return cls(tuple(sorted(unique, key=len)))

    @property
    def columns(self) -> list[Column]:
        out = [Column("(Intercept)", (), None)]
        for term in self.terms:
            out += _expand(term)
        return out

    @property
    def factors(self) -> list[Factor]:
        return list(dict.fromkeys(v for t in self.terms for v in t if isinstance(v, Factor)))

    @property
    def numerics(self) -> list[str]:
        return list(dict.fromkeys(v.name for t in self.terms for v in t if isinstance(v, Numeric)))

    def positions(self, labels: Sequence[str]) -> list[int]:
        """Column positions of the given labels."""
        names = [c.label for c in self.columns]
        return [names.index(label) for label in labels]


def coded(df: DataFrame, design: Design) -> DataFrame:
    """Append the design columns (treatment coding) to the rows, named by their labels."""
    out = {}
    for c in design.columns:
        value = F.lit(1.0)
        for name, level in c.levels:
            value = value * F.when(F.col(name) == F.lit(level), 1.0).when(F.col(name).isNotNull(), 0.0)
        out[c.label] = value * F.col(c.numeric).cast("double") if c.numeric else value
    return df.withColumns(out)
