"""Sufficient statistics: one grouping of the data serves every model over the same variables.

All categorical predictors of a row form its cell. Per cell, Spark keeps the row count, the means and
the covariances of the covariates and the outcome; any linear model in those variables, with any
interactions, is a function of these numbers. The cells stay a table; what a model needs of them is
summed in Spark, and only its matrix, a row and column per coefficient, comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.models.design import Column as DesignColumn
from panelweave.models.design import Design, Factor
from panelweave.session import written

def known_rows(df: DataFrame, outcome: str, factors: Sequence[Factor], numerics: Sequence[str],
               group: str | None = None) -> DataFrame:
    """Rows with every model variable present and every factor at a known level."""
    test = F.col(outcome).isNotNull()
    for f in factors:
        test = test & F.coalesce(F.col(f.name).isin(*f.levels), F.lit(False))
    for c in [*numerics, *([group] if group else [])]:
        test = test & F.col(c).isNotNull()
    return df.where(test)


def cell_table(df: DataFrame, outcome: str, factors: Sequence[Factor], numerics: Sequence[str],
               group: str | None = None) -> DataFrame:
    """One row per (group and) cell: ``n``, means ``m_i`` and population covariances ``c_i_j``.

    The moment aggregates merge partial results stably, so large means do no harm, and every task
    sends one row per cell.
    """
    values = [F.col(c).cast("double") for c in (*numerics, outcome)]
    keys = [*([group] if group else []), *[f.name for f in factors]]
    rows = known_rows(df, outcome, factors, numerics, group)
    aggregates = [F.count("*").alias("n")]
    aggregates += [F.avg(v).alias(f"m_{i}") for i, v in enumerate(values)]
    aggregates += [
        F.covar_pop(v, w).alias(f"c_{i}_{j}") for i, v in enumerate(values) for j, w in enumerate(values) if i <= j
    ]
    return rows.groupBy(*keys).agg(*aggregates)


@dataclass
class Cells:
    """The stored cells, per group when there are groups, with the mean of every variable and the number of rows.

    Sums over cells that designs ask for (see :meth:`gram`) are kept, so designs that share columns share jobs.
    """

    outcome: str
    factors: tuple[Factor, ...]
    numerics: tuple[str, ...]
    group: str | None
    table: DataFrame
    shift: np.ndarray
    n_rows: int
    known: dict[tuple, float] = field(default_factory=dict)

    @property
    def by_group(self) -> DataFrame:
        return self.table

    def value_index(self, name: str) -> int:
        return (*self.numerics, self.outcome).index(name)

    def prepare(self, designs: Iterable[Design]) -> Cells:
        """Sum what all of these designs need in one job; returns the cells."""
        self.gram(list(dict.fromkeys(c for d in designs for c in d.columns)))
        return self

    def gram(self, columns: Sequence[DesignColumn]) -> np.ndarray:
        """Cross-products of the design columns and, in the last place, the outcome, in shifted coordinates.

        A cell is active in few columns, those whose levels it has. Spark sums its moments into every pair of
        active columns; only the numbers of the matrix reach the driver, however many cells there are.
        """
        places = [(c.levels, c.numeric) for c in columns]
        wanted = [*places, None]
        pairs = [(a, b) for i, a in enumerate(wanted) for b in wanted[i:]]
        if any((a, b) not in self.known and (b, a) not in self.known for a, b in pairs):
            self._sum(columns)
        value = lambda a, b: self.known.get((a, b), self.known.get((b, a), 0.0))
        return np.array([[value(a, b) for b in wanted] for a in wanted])

    def _sum(self, columns: Sequence[DesignColumn]) -> None:
        size, shift = len(self.shift) + 1, self.shift.tolist()
        index = [None, *range(len(shift))]
        names = [f.name for f in self.factors]
        moments = F.array(*[F.sum(moment(a, b, shift)) for a in index for b in index])
        cells = self.table.groupBy(*names).agg(moments.alias("_moments"))
        kinds = [0 if c.numeric is None else 1 + self.value_index(c.numeric) for c in columns]
        marks = []
        for i, (c, kind) in enumerate(zip(columns, kinds, strict=True)):
            test = F.lit(True)
            for name, level in c.levels:
                test = test & (F.col(name) == F.lit(level))
            marks.append(F.when(test, F.struct(F.lit(i).alias("i"), F.lit(kind).alias("k"))))
        marks.append(F.struct(F.lit(len(columns)).alias("i"), F.lit(size - 1).alias("k")))
        active = cells.select("_moments", F.filter(F.array(*marks), lambda m: m.isNotNull()).alias("_a"))
        pairs = active.select("_moments", "_a", F.explode("_a").alias("a")).select("_moments", "a", F.explode("_a").alias("b"))
        value = F.element_at("_moments", F.col("a.k") * size + F.col("b.k") + 1)
        sums = pairs.where("a.i <= b.i").groupBy(F.col("a.i").alias("a"), F.col("b.i").alias("b")).agg(F.sum(value).alias("v"))
        wanted = [*[(c.levels, c.numeric) for c in columns], None]
        for i, a in enumerate(wanted):
            for b in wanted[i:]:
                self.known.setdefault((a, b), 0.0)
        for r in sums.collect():  # one row per entry of the matrix
            self.known[wanted[r["a"]], wanted[r["b"]]] = r["v"]


def collect_cells(df: DataFrame, outcome: str, factors: Sequence[Factor], numerics: Sequence[str] = (),
                  group: str | None = None) -> Cells:
    """Read the data once and return its cells, stored in the shared folder.

    Covariates and outcome are taken relative to their means, which keeps cross-products well
    conditioned; ``Moments`` undoes the shift in the coefficients. With ``group``, cells are kept per group
    and feed both the totals and the group blocks.
    """
    factors, numerics = tuple(factors), tuple(numerics)
    table = written(cell_table(df, outcome, factors, numerics, group), "cells")
    k = len(numerics) + 1
    centre = table.agg(F.sum("n").alias("n"), *[(F.sum(F.col("n") * F.col(f"m_{i}")) / F.sum("n")).alias(f"a_{i}") for i in range(k)]).first()
    if not centre["n"]:
        raise ValueError("no complete rows")
    return Cells(outcome, factors, numerics, group, table, np.array([float(centre[f"a_{i}"]) for i in range(k)]), int(centre["n"]))


def moment(i: int | None, j: int | None, shift: Sequence[float]) -> Column:
    """Sum over a cell's rows of value i times value j, both shifted; ``None`` stands for one."""
    n = F.col("n")
    if i is None and j is None:
        return n.cast("double")
    if i is None or j is None:
        v = i if i is not None else j
        return n * (F.col(f"m_{v}") - shift[v])
    a, b = min(i, j), max(i, j)
    return n * (F.col(f"c_{a}_{b}") + (F.col(f"m_{a}") - shift[a]) * (F.col(f"m_{b}") - shift[b]))


class Moments:
    """X'X, X'y and y'y of one design, from cells, in shifted coordinates."""

    def __init__(self, cells: Cells, design: Design):
        names = [f.name for f in cells.factors]
        missing = [f.name for f in design.factors if f.name not in names]
        missing += [c for c in design.numerics if c not in cells.numerics]
        if missing:
            raise ValueError(f"not in the cells: {missing}")
        self.cells, self.design = cells, design
        self.columns = design.columns
        self.shift = cells.shift
        whole = cells.gram(self.columns)
        self.xtx, self.xty, self.yty = whole[:-1, :-1], whole[:-1, -1], float(whole[-1, -1])
        self.n = cells.n_rows
        self.kept = independent_columns(self.xtx)

    def unshift(self) -> np.ndarray:
        """Matrix that maps shifted coefficients to the original covariates (outcome shift apart)."""
        p = len(self.columns)
        back = np.eye(p)
        index = {(c.levels, c.numeric): i for i, c in enumerate(self.columns)}
        for i, c in enumerate(self.columns):
            if c.numeric is not None:
                base = index.get((c.levels, None))
                if base is None:
                    raise ValueError(f"{c.label} needs its main effect in the model")
                back[base, i] = -self.shift[self.cells.value_index(c.numeric)]
        return back

    def original(self, beta: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients and covariance for unshifted variables; dropped columns are NaN."""
        p = len(self.columns)
        full, var = np.zeros(p), np.zeros((p, p))
        full[self.kept] = beta
        var[np.ix_(self.kept, self.kept)] = cov
        back = self.unshift()
        full, var = back @ full, back @ var @ back.T
        full[0] += self.shift[-1]
        gone = [i for i in range(p) if i not in set(self.kept)]
        full[gone] = np.nan
        var[gone, :] = var[:, gone] = np.nan
        return full, var


def independent_columns(gram: np.ndarray, tolerance: float = 1e-9) -> list[int]:
    """Columns that are not linear combinations of earlier ones."""
    kept: list[int] = []
    for j in range(gram.shape[0]):
        if gram[j, j] <= 0:
            continue
        rest = gram[j, j]
        if kept:
            block = gram[np.ix_(kept, kept)]
            rest -= gram[kept, j] @ np.linalg.solve(block, gram[kept, j])
        if rest > tolerance * gram[j, j]:
            kept.append(j)
    return kept
