"""Linear mixed models with one grouping factor, from per-group statistics.

With a relative covariance factor Lambda, everything the profiled likelihood needs from group g is
Z'Z, Z'X and Z'y (Bates, Maechler, Bolker and Walker, 2015). Spark reduces the data to these blocks
once; a likelihood evaluation is then a sum over groups. The blocks stay a written table, and one job
evaluates a whole list of factors: any number of random-intercept models over the same cells take five jobs
over it together, a model with random slopes two for every Newton step, some twenty in all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.models.cells import Cells, Moments, moment
from panelweave.models.design import Column as DesignColumn
from panelweave.models.design import Design
from panelweave.models.distributions import chi_square_tail, normal_two_sided
from panelweave.session import written


def _indicator(levels) -> Column:
    out = F.lit(1.0)
    for name, level in levels:
        out = out * F.when(F.col(name) == F.lit(level), 1.0).otherwise(0.0)
    return out


def group_blocks(cells: Cells, columns: Sequence[DesignColumn], random: Sequence[int]) -> DataFrame:
    """Per group the flattened rows of [Z'X | Z'y], with X the design columns and Z the ``random`` ones of them."""
    index = lambda c: None if c.numeric is None else cells.value_index(c.numeric)
    y, shift = len(cells.numerics), cells.shift.tolist()
    sums = []
    for z in (columns[r] for r in random):
        for x in columns:
            sums.append(F.sum(_indicator((*z.levels, *x.levels)) * moment(index(z), index(x), shift)))
        sums.append(F.sum(_indicator(z.levels) * moment(index(z), y, shift)))
    return cells.table.groupBy(cells.group).agg(F.array(*sums).alias("block"))


def _terms(blocks: np.ndarray, lam: np.ndarray, zpos: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cholesky factors and whitened [Z'X | Z'y] for a stack of groups."""
    ztz = blocks[:, :, list(zpos)]
    q = lam.shape[0]
    factor = np.linalg.cholesky(lam.T @ ztz @ lam + np.eye(q))
    white = np.linalg.solve(factor, lam.T @ blocks)
    return ztz, factor, white


def _sum_terms(blocks: np.ndarray, lam: np.ndarray, zpos: Sequence[int]) -> np.ndarray:
    """Log determinant and cross-products of the whitened blocks, summed over groups, flattened."""
    _, factor, white = _terms(blocks, lam, zpos)
    logdet = 2 * np.log(np.diagonal(factor, axis1=1, axis2=2)).sum()
    cross = np.einsum("gqa,gqb->ab", white, white)
    return np.concatenate([[logdet], cross.ravel()])


def _random_effects(blocks: np.ndarray, lam: np.ndarray, zpos: Sequence[int], beta: np.ndarray) -> np.ndarray:
    """Conditional modes of the random effects per group."""
    _, factor, white = _terms(blocks, lam, zpos)
    resid = white[:, :, -1] - white[:, :, :-1] @ beta
    u = np.linalg.solve(np.swapaxes(factor, 1, 2), resid[:, :, None])[:, :, 0]
    return u @ lam.T


def _fit_terms(blocks: np.ndarray, lam: np.ndarray, zpos: Sequence[int], beta: np.ndarray) -> np.ndarray:
    """Number of groups, change of the residual sum of squares by the random effects, and the sum of Z'Z, flattened."""
    b = _random_effects(blocks, lam, zpos, beta)
    ztz = blocks[:, :, list(zpos)]
    zr = blocks[:, :, -1] - blocks[:, :, :-1] @ beta
    change = -2 * (b * zr).sum() + np.einsum("gi,gij,gj->", b, ztz, b)
    return np.concatenate([[len(blocks), change], ztz.sum(axis=0).ravel()])


class Groups:
    """Group blocks as a written table. Whatever is summed over groups is summed by a job, for many factors at once."""

    def __init__(self, frame: DataFrame, q: int, width: int):
        self.q, self.width = q, width
        self.name = frame.columns[0]
        self.frame = written(frame, "group-blocks")

    def totals(self, part: Callable[[np.ndarray, object], np.ndarray], factors: Sequence[object]) -> np.ndarray:
        """Sum of ``part(blocks, factor)`` over all groups, a row per factor.

        Tasks add up their own groups; then the tasks' sums are added up, dealt by factor. The driver gets a row
        per factor whatever the number of groups.
        """
        q, width = self.q, self.width

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = None
            for pdf in batches:
                if len(pdf):
                    blocks = np.stack(pdf["block"].to_numpy()).reshape(len(pdf), q, width)
                    own = np.stack([part(blocks, factor) for factor in factors])
                    sums = own if sums is None else sums + own
            if sums is not None:
                yield pd.DataFrame({"t": np.arange(len(factors)), "v": list(sums)})

        def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, np.ndarray] = {}
            for pdf in batches:
                for t, v in zip(pdf["t"], pdf["v"], strict=True):
                    sums[t] = sums[t] + v if t in sums else np.asarray(v)
            if sums:
                yield pd.DataFrame({"t": list(sums), "v": list(sums.values())})

        kind = "t int, v array<double>"
        parts = self.frame.select("block").mapInPandas(add, kind)
        found = {r["t"]: r["v"] for r in parts.repartition("t").mapInPandas(merge, kind).collect()}  # one row per factor
        return np.array([found[t] for t in range(len(factors))])


@dataclass
class MixedFit:
    """A fitted mixed model; ``beta`` and ``cov`` refer to the original variables."""

    design: Design
    cells: Cells
    moments: Moments
    groups: Groups
    random: list[int]
    places: list[int]
    reml: bool
    theta: np.ndarray
    lam: np.ndarray
    sigma: float
    block_beta: np.ndarray
    beta: np.ndarray
    cov: np.ndarray
    measures: dict[str, float]
    random_sd: dict[str, float]
    random_cor: np.ndarray

    @property
    def terms(self) -> list[str]:
        return [c.label for c in self.moments.columns]

    @property
    def n_par(self) -> int:
        return len(self.moments.kept) + len(self.theta) + 1

    def rows(self, model: str) -> list[tuple]:
        out = []
        for i, term in enumerate(self.terms):
            b, v = float(self.beta[i]), self.cov[i, i]
            se = math.sqrt(v) if v >= 0 else math.nan
            z = b / se if se else math.nan
            out.append((model, term, b, se, z, normal_two_sided(z) if not math.isnan(z) else math.nan))
        for label, sd in self.random_sd.items():
            out.append((model, f"sd__{label}", sd, None, None, None))
        out.append((model, "sd__Observation", self.sigma, None, None, None))
        return out

    def random_effects(self) -> DataFrame:
        """Per group and random term the predicted deviation; one map over the group table."""
        return _map_groups(self, deviations_only=True)

    def group_coefficients(self) -> DataFrame:
        """Per group and term the fixed coefficient plus the group's deviation."""
        return _map_groups(self, deviations_only=False)


def _lower(theta: np.ndarray, q: int) -> np.ndarray:
    lam = np.zeros((q, q))
    lam[np.tril_indices(q)] = theta
    return lam


class _Problem:
    """One model over shared blocks: its deviance for a factor, and its estimates."""

    def __init__(self, cells: Cells, design: Design, shared: Sequence[DesignColumn], random: Sequence[str], reml: bool):
        self.m, self.design, self.reml = Moments(cells, design), design, reml
        self.random = design.positions(random)
        gone = [self.m.columns[r].label for r in self.random if r not in self.m.kept]
        if gone:
            raise ValueError(f"random terms without variation: {gone}")
        kept = self.m.kept
        self.own = [shared.index(self.m.columns[i]) for i in kept]  # places in the blocks
        self.width, self.q, self.p, self.n = len(shared) + 1, len(self.random), len(kept), self.m.n
        self.free = self.n - self.p if reml else self.n
        self.xtx, self.xty, self.yty = self.m.xtx[np.ix_(kept, kept)], self.m.xty[kept], self.m.yty

    def solve(self, total: np.ndarray):
        """Deviance, the matrix of the fixed part, its coefficients and the residual sum, from the sums over groups."""
        index = [*self.own, self.width - 1]
        cross = total[1:].reshape(self.width, self.width)[np.ix_(index, index)]
        p = self.p
        a, b = self.xtx - cross[:p, :p], self.xty - cross[:p, p]
        chol = np.linalg.cholesky(a)
        half = np.linalg.solve(chol, b)
        r2 = self.yty - cross[p, p] - half @ half
        deviance = total[0] + self.free * (1 + math.log(2 * math.pi * r2 / self.free))
        if self.reml:
            deviance += 2 * np.log(np.diag(chol)).sum()
        return deviance, a, np.linalg.solve(chol.T, half), r2

    def deviance(self, total: np.ndarray) -> float:
        try:
            return self.solve(total)[0]
        except (np.linalg.LinAlgError, ValueError):  # no such model: not a minimum
            return math.inf

    def block_beta(self, beta: np.ndarray) -> np.ndarray:
        """Coefficients in the places of the blocks' columns."""
        out = np.zeros(self.width - 1)
        out[self.own] = beta
        return out


def fit_mixed(cells: Cells, design: Design, random: Sequence[str] = ("(Intercept)",), reml: bool = False,
              start: MixedFit | None = None) -> MixedFit:
    """Fit by maximum likelihood, or by restricted likelihood with ``reml``.

    ``random`` lists labels of design columns whose coefficients vary by group. ``start`` may hand in an
    earlier fit with the same design and random terms, whose blocks and factor are taken over.
    """
    return fit_mixed_many(cells, {"": (design, reml)}, random, start)[""]


def fit_mixed_many(cells: Cells, models: Mapping[str, tuple[Design, bool]], random: Sequence[str] = ("(Intercept)",),
                   start: MixedFit | None = None) -> dict[str, MixedFit]:
    """Fit several designs (with their ``reml`` choice) that share the random terms, in the jobs of one.

    The blocks hold the columns of all designs; a likelihood takes its own rows and columns out of the sums.
    """
    shared = list(dict.fromkeys(c for design, _ in models.values() for c in design.columns))
    cells.prepare(design for design, _ in models.values())
    problems = [_Problem(cells, design, shared, random, reml) for design, reml in models.values()]
    q, width = problems[0].q, problems[0].width
    zpos = [shared.index(problems[0].m.columns[r]) for r in problems[0].random]
    groups = start.groups if start else Groups(group_blocks(cells, shared, zpos), q, width)

    def terms(thetas: Sequence[np.ndarray]) -> np.ndarray:
        return groups.totals(lambda blocks, lam: _sum_terms(blocks, lam, zpos), [_lower(t, q) for t in thetas])

    if q == 1:
        thetas = _minimise_scalars(lambda grids: [
            np.array([problem.deviance(total) for total in own])
            for problem, own in zip(problems, np.split(terms([np.array([x]) for g in grids for x in g]), np.cumsum([len(g) for g in grids])[:-1]), strict=True)
        ], len(problems))
    else:
        first = start.theta if start else np.eye(q)[np.tril_indices(q)] * 0.5
        thetas = [_minimise(lambda points, own=problem: np.array([own.deviance(t) for t in terms(points)]), first) for problem in problems]
    lams = []
    for theta in thetas:  # one sign per column: the diagonal is made non-negative
        lam = _lower(theta, q)
        lams.append(lam * np.where(np.diag(lam) < 0, -1.0, 1.0)[None, :])
    solved = [problem.solve(total) for problem, total in zip(problems, terms([lam[np.tril_indices(q)] for lam in lams]), strict=True)]
    betas = [problem.block_beta(found[2]) for problem, found in zip(problems, solved, strict=True)]
    shares = groups.totals(lambda blocks, own: _fit_terms(blocks, own[0], zpos, own[1]), list(zip(lams, betas, strict=True)))
    return {
        name: _finished(cells, problem, groups, zpos, lam, beta, found, share)
        for name, problem, lam, beta, found, share in zip(models, problems, lams, betas, solved, shares, strict=True)
    }


def _finished(cells: Cells, problem: _Problem, groups: Groups, zpos: list[int], lam: np.ndarray, block_beta: np.ndarray, found: tuple,
              share: np.ndarray) -> MixedFit:
    """Estimates and measures of a fitted model."""
    deviance, a, beta_shifted, r2 = found
    m, q, p, n = problem.m, problem.q, problem.p, problem.n
    xtx, xty, yty = problem.xtx, problem.xty, problem.yty
    theta = lam[np.tril_indices(q)]
    sigma2 = r2 / problem.free
    beta, cov = m.original(beta_shifted, sigma2 * np.linalg.inv(a))
    rss = yty - 2 * xty @ beta_shifted + beta_shifted @ xtx @ beta_shifted + share[1]
    psi = sigma2 * lam @ lam.T
    var_random = float(np.trace(psi @ share[2:].reshape(q, q)) / n)
    mean_fit = float(xtx[0] @ beta_shifted) / n  # the first column is the intercept
    var_fixed = (beta_shifted @ xtx @ beta_shifted - n * mean_fit**2) / (n - 1)
    whole = var_fixed + var_random + sigma2
    n_par = p + len(theta) + 1
    sd = np.sqrt(np.diag(psi))
    with np.errstate(divide="ignore", invalid="ignore"):
        cor = psi / np.outer(sd, sd)
    measures = {
        "nobs": float(n),
        "n_groups": float(share[0]),
        "loglik": -deviance / 2,
        "deviance": deviance,
        "aic": deviance + 2 * n_par,
        "bic": deviance + math.log(n) * n_par,
        "r2_marginal": var_fixed / whole,
        "r2_conditional": (var_fixed + var_random) / whole,
        "icc": var_random / (var_random + sigma2),
        "rmse": math.sqrt(max(rss, 0.0) / n),
        "sigma": math.sqrt(sigma2),
    }
    measures = {k: float(v) for k, v in measures.items()}
    labels = [m.columns[r].label for r in problem.random]
    return MixedFit(
        problem.design, cells, m, groups, problem.random, zpos, problem.reml, theta, lam, float(math.sqrt(sigma2)), block_beta, beta, cov,
        measures, dict(zip(labels, sd.tolist(), strict=True)), cor,
    )


def _map_groups(fit: MixedFit, deviations_only: bool) -> DataFrame:
    m, groups = fit.moments, fit.groups
    zpos, labels = fit.places, fit.terms
    fixed = np.nan_to_num(fit.beta)
    lam, beta, q, width, name = fit.lam, fit.block_beta, groups.q, groups.width, groups.name
    # deviations of shifted columns, mapped to the original ones
    back = m.unshift()[:, fit.random]
    shown = list(fit.random) if deviations_only else [i for i in range(len(labels)) if not math.isnan(fit.beta[i])]

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            blocks = np.stack(pdf["block"].to_numpy()).reshape(len(pdf), q, width)
            dev = _random_effects(blocks, lam, zpos, beta) @ back.T
            value = dev if deviations_only else dev + fixed[None, :]
            yield pd.DataFrame(
                {
                    name: np.repeat(pdf[name].to_numpy(), len(shown)),
                    "term": [labels[i] for i in shown] * len(pdf),
                    "value": value[:, shown].ravel(),
                }
            )

    kind = groups.frame.schema[name].dataType.simpleString()
    return groups.frame.mapInPandas(predict, f"`{name}` {kind}, term string, value double")


Criterion = Callable[[Sequence[np.ndarray]], np.ndarray]


def _minimise_scalars(f: Callable[[list[np.ndarray]], list[np.ndarray]], n: int, points: int = 33) -> list[np.ndarray]:
    """Minima of ``n`` criteria over a non-negative scalar, side by side in three jobs: a wide grid and two finer ones.

    ``f`` takes a grid per criterion. A polynomial of degree four through the nine best points of the last grid is
    far more exact than the grid, because a criterion is smooth and its values are good to ten digits.
    """
    grids = [np.concatenate([[0.0], np.geomspace(1e-4, 1e4, 48)])] * n
    at_zero = None
    for step in range(3):
        values = f(grids)
        at_zero = [v[0] for v in values] if at_zero is None else at_zero
        best = [int(np.argmin(v)) for v in values]
        if step < 2:
            grids = [np.linspace(g[max(b - 1, 0)], g[min(b + 1, len(g) - 1)], points) for g, b in zip(grids, best, strict=True)]
    out = []
    for grid, v, b, zero in zip(grids, values, best, at_zero, strict=True):
        first = min(max(b - 4, 0), len(grid) - 9)
        near, scale = grid[first : first + 9], grid[1] - grid[0]
        curve = np.polynomial.Polynomial.fit((near - grid[b]) / scale, v[first : first + 9] - v[b], 4)
        roots = [r.real for r in curve.deriv().roots() if abs(r.imag) < 1e-6 and abs(r.real) <= 1.5]
        found = max(0.0, grid[b] + min(roots, key=curve, default=0.0) * scale)
        out.append(np.array([0.0 if zero <= v[b] else found]))
    return out


def _derivatives(f: Criterion, x: np.ndarray, h: float = 2e-3) -> tuple[float, np.ndarray, np.ndarray]:
    """Value, gradient and curvature at ``x`` from differences, in one job; gradients are extrapolated from two steps."""
    k, unit = len(x), np.eye(len(x))
    pairs = [(i, j) for i in range(k) for j in range(i)]
    points = [x, *[x + s * h * unit[i] for i in range(k) for s in (1.0, -1.0, 0.5, -0.5)]]
    points += [x + s * h * (unit[i] + unit[j]) for i, j in pairs for s in (1.0, -1.0)]
    values = f(points)
    value, sides, across = values[0], values[1 : 1 + 4 * k].reshape(k, 4), values[1 + 4 * k :].reshape(-1, 2)
    gradient = (4 * (sides[:, 2] - sides[:, 3]) / h - (sides[:, 0] - sides[:, 1]) / (2 * h)) / 3
    curvature = np.diag((sides[:, 0] + sides[:, 1] - 2 * value) / h**2)
    for (i, j), (plus, minus) in zip(pairs, across, strict=True):
        both = (plus + minus - 2 * value) / h**2
        curvature[i, j] = curvature[j, i] = (both - curvature[i, i] - curvature[j, j]) / 2
    return value, gradient, curvature


def _minimise(f: Criterion, x: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Newton's method over the lower triangle from ``x``, two jobs a round: derivatives, and all trial steps at once.

    Directions of negative curvature are turned; trial steps shrink (and stretch) the Newton step and also
    go downhill, so a round always improves or ends the search. Ten rounds are usual, ``rounds`` the most.
    """
    lengths = (4.0, 2.0, 1.0, 0.5, 0.25, 0.1, 0.03, 0.01)
    for _ in range(rounds):
        value, gradient, curvature = _derivatives(f, x)
        size, axes = np.linalg.eigh(curvature)
        size = np.maximum(np.abs(size), 1e-6 * max(np.abs(size).max(), 1e-12))
        newton = -axes @ ((axes.T @ gradient) / size)
        if np.abs(newton).max() < 1e-9:
            break
        downhill = -gradient / max(np.abs(gradient).max(), 1e-300) * 0.5
        steps = [t * newton for t in lengths] + [t * downhill for t in lengths]
        values = f([x + step for step in steps])
        best = int(np.argmin(values))
        small = np.abs(newton).max() < 1e-5
        if small or not values[best] < value:
            x = x + newton if small else x  # differences of values no longer tell; the gradient still does
            break
        x = x + steps[best]
    return x


LRT = (
    "model string, npar int, aic double, bic double, loglik double, deviance double, chisq double, df int, p_value double"
)


def likelihood_ratio_table(spark: SparkSession, fits: Mapping[str, MixedFit]) -> DataFrame:
    """Each model against the one before it, ordered by number of parameters."""
    if any(f.reml for f in fits.values()):
        raise ValueError("compare models fitted by maximum likelihood")
    rows, previous = [], None
    for name, fit in sorted(fits.items(), key=lambda kv: kv[1].n_par):
        chisq = df = p = None
        if previous is not None:
            chisq = max(0.0, previous.measures["deviance"] - fit.measures["deviance"])
            df = fit.n_par - previous.n_par
            p = chi_square_tail(chisq, df) if df else None
        m = fit.measures
        rows.append((name, fit.n_par, m["aic"], m["bic"], m["loglik"], m["deviance"], chisq, df, p))
        previous = fit
    return spark.createDataFrame(rows, LRT)
