"""The published model catalogue, H1 to H6, over the enriched panel and the people table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.scores import tech_flag
from panelweave.models.cells import Moments, collect_cells
from panelweave.models.contrasts import average_comparisons, mean_predictions
from panelweave.models.design import Design, Factor, Numeric, crossed, main
from panelweave.models.mixed import LRT, MixedFit, fit_mixed, fit_mixed_many, likelihood_ratio_table
from panelweave.models.ols import OlsFit, fit_nested
from panelweave.operators import describe
from panelweave.session import written

# Levels with the reference first.
OCCUPATION = Factor("occupation_std", ("manager", "engineer", "other"))
INSIDER = Factor("is_sec_insider", (False, True))
TECH = Factor("ff49_is_tech", (False, True))
ZIP_STATIC = Numeric("mean_score_zipcode_wo_i")
ZIP_DYNAMIC = Numeric("mean_dyn_score_zipcode_cycle_wo_i")
STATIC, DYNAMIC = "contributor_score", "score_dyn"
INDUSTRY, FIRM = "ff49_abbr", "employer_matched"

PEOPLE_CASES = (STATIC, "occupation_std", ZIP_STATIC.name, INDUSTRY, "gender", "is_sec_insider")
PANEL_CASES = (DYNAMIC, STATIC, "occupation_std", ZIP_DYNAMIC.name, INDUSTRY, "gender", "is_sec_insider")


@dataclass
class Catalogue:
    """Fits by name, and the models that could not be fitted with the reason.

    Names are ``family: step``; the steps of a family are nested in order and compared with each other.
    """

    fits: dict[str, OlsFit | MixedFit] = field(default_factory=dict)
    skipped: dict[str, str] = field(default_factory=dict)

    def __or__(self, other: Catalogue) -> Catalogue:
        return Catalogue(self.fits | other.fits, self.skipped | other.skipped)

    def families(self) -> dict[str, dict[str, MixedFit]]:
        """Mixed models fitted by maximum likelihood, by family and step."""
        out: dict[str, dict[str, MixedFit]] = {}
        for name, fit in self.fits.items():
            if isinstance(fit, MixedFit) and not fit.reml:
                family, step = name.split(": ", 1)
                out.setdefault(family, {})[step] = fit
        return out


def estimation_samples(people: DataFrame, panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Complete cases with the tech flag of their industry; the panel also without blanks and beyond-bound scores.

    Both are stored: every model reads them.
    """
    flagged = [df.withColumn(TECH.name, tech_flag(F.col(INDUSTRY))) for df in (people, panel)]
    whole = describe.complete_cases(flagged[0], PEOPLE_CASES)
    rows = describe.complete_cases(flagged[1], PANEL_CASES, drop_blank=True)
    return written(whole, "sample-people"), written(describe.within(rows, DYNAMIC), "sample-panel")


def _levels(df: DataFrame, name: str, reference=None) -> Factor:
    """Levels present in the data, sorted, ``reference`` first. Each is a column of the model's matrix."""
    found = sorted(r[0] for r in df.select(name).distinct().collect() if r[0] is not None)
    if not found:
        return Factor(name, (reference,))
    return Factor(name, tuple(found)).reordered(reference if reference in found else found[0])


def _stepwise(*steps: Sequence) -> dict[str, Design]:
    """Nested designs; every step adds terms to those before."""
    out, terms = {}, []
    for label, added in steps:
        terms = [*terms, *added]
        out[label] = Design.of(terms)
    return out


def _with(prefix: str, designs: dict[str, Design]) -> dict[str, Design]:
    return {f"{prefix}: {k}": v for k, v in designs.items()}


def _ols(family: str, rows: DataFrame, outcome: str, factors: Sequence[Factor], covariate: Numeric, designs: dict[str, Design]) -> Catalogue:
    named = _with(family, designs)
    if rows.isEmpty():
        return Catalogue(skipped=dict.fromkeys(named, "no rows"))
    return Catalogue(fits=dict(fit_nested(collect_cells(rows, outcome, factors, [covariate.name]), named)))


def _mixed(family: str, rows: DataFrame, outcome: str, factors: Sequence[Factor], covariate: Numeric, group: str,
           designs: dict[str, Design], slopes: Factor | None = None, reml: bool = False) -> Catalogue:
    """Nested designs with group intercepts; the last one also with slopes of a factor, and by REML."""
    named = _with(family, designs)
    last = list(designs.values())[-1]
    more = [f"{family}: slopes", f"{family}: slopes REML"] if slopes else [f"{family}: REML"] if reml else []
    if rows.isEmpty():
        return Catalogue(skipped=dict.fromkeys([*named, *more], "no rows"))
    cells = collect_cells(rows, outcome, factors, [covariate.name], group=group)
    models = {name: (design, False) for name, design in named.items()}
    if reml:
        models[f"{family}: REML"] = (last, True)
    out = Catalogue(fits=dict(fit_mixed_many(cells, models)))
    if slopes:
        labels = ["(Intercept)", *[c.label for c in Design.of(main(slopes)).columns[1:]]]
        moments = Moments(cells, last)
        gone = [label for label in labels if last.positions([label])[0] not in moments.kept]
        if gone or len(labels) == 1:
            reason = f"no variation in {', '.join(gone)}" if gone else f"one level of {slopes.name}"
            return out | Catalogue(skipped=dict.fromkeys(more, reason))
        fit = fit_mixed(cells, last, labels)
        out.fits |= {more[0]: fit, more[1]: fit_mixed(cells, last, labels, reml=True, start=fit)}
    return out


def h1(people: DataFrame) -> Catalogue:
    """Static score by tech flag, and by industry; occupation, gender and zip mean added in turn."""
    gender, industry = _levels(people, "gender", "M"), _levels(people, INDUSTRY, "Chips")
    steps = [("+ occupation", main(OCCUPATION)), ("+ gender", main(gender)), ("+ zip mean", main(ZIP_STATIC))]
    factors = [TECH, industry, OCCUPATION, gender]
    tech = _ols("h1 tech", people, STATIC, factors, ZIP_STATIC, _stepwise(("baseline", main(TECH)), *steps))
    return tech | _ols("h1 industry", people, STATIC, factors, ZIP_STATIC, _stepwise(("baseline", main(industry)), *steps))


def h2(people: DataFrame, who: Factor) -> Catalogue:
    """Static score by ``who`` with industry intercepts, then with varying slopes, then by REML."""
    gender = _levels(people, "gender", "M")
    designs = _stepwise(("null", []), ("+ who", main(who)), ("+ gender", main(gender)), ("+ zip mean", main(ZIP_STATIC)))
    return _mixed(f"h2 {who.name}", people, STATIC, [who, gender], ZIP_STATIC, INDUSTRY, designs, slopes=who)


def _subsets(rows: DataFrame) -> dict[str, DataFrame]:
    return {"managers": rows.where("occupation_std = 'manager'"), "insiders": rows.where("is_sec_insider")}


def h3(people: DataFrame) -> Catalogue:
    """Static score by tech flag and by industry among managers, and among insiders."""
    gender, industry = _levels(people, "gender", "M"), _levels(people, INDUSTRY, "Chips")
    out = Catalogue()
    for label, rows in _subsets(people).items():
        for name, first in (("tech", TECH), ("industry", industry)):
            steps = _stepwise(("baseline", main(first)), ("+ gender", main(gender)), ("+ zip mean", main(ZIP_STATIC)))
            out |= _ols(f"h3 {label} {name}", rows, STATIC, [TECH, industry, gender], ZIP_STATIC, steps)
    return out


def h4(panel: DataFrame) -> Catalogue:
    """Dynamic score by cycle among managers, and among insiders, with industry intercepts and slopes."""
    gender, cycle = _levels(panel, "gender", "M"), _levels(panel, "cycle")
    designs = _stepwise(("null", []), ("+ cycle", main(cycle)), ("+ gender", main(gender)), ("+ zip mean", main(ZIP_DYNAMIC)))
    out = Catalogue()
    for label, rows in _subsets(panel).items():
        out |= _mixed(f"h4 {label}", rows, DYNAMIC, [cycle, gender], ZIP_DYNAMIC, INDUSTRY, designs, slopes=cycle)
    return out


def h56(panel: DataFrame, who: Factor) -> Catalogue:
    """Dynamic score by cycle and ``who`` with firm intercepts: in tech firms, and with tech interacted."""
    gender, cycle = _levels(panel, "gender", "M"), _levels(panel, "cycle")
    tail = [("+ gender", main(gender)), ("+ zip mean", main(ZIP_DYNAMIC))]
    inside = _stepwise(("baseline", main(cycle)), ("+ who", main(who)), ("* who", crossed(cycle, who)), *tail)
    across = _stepwise(
        ("baseline", main(cycle)), ("+ tech", main(TECH)), ("+ who", main(who)),
        ("^2", crossed(cycle, TECH, who, order=2)), ("* tech * who", crossed(cycle, TECH, who)), *tail,
    )
    tech = _mixed(f"h56 tech {who.name}", panel.where(TECH.name), DYNAMIC, [cycle, who, gender], ZIP_DYNAMIC, FIRM, inside, reml=True)
    return tech | _mixed(f"h56 all {who.name}", panel, DYNAMIC, [cycle, TECH, who, gender], ZIP_DYNAMIC, FIRM, across, reml=True)


def all_models(people: DataFrame, panel: DataFrame) -> Catalogue:
    """Every fit of the catalogue, by name, and what was left out with the reason."""
    whole, rows = estimation_samples(people, panel)
    out = h1(whole) | h3(whole) | h4(rows)
    for who in (OCCUPATION, INSIDER):
        out |= h2(whole, who) | h56(rows, who)
    return out


def skipped_models(spark: SparkSession, found: Catalogue) -> DataFrame:
    """The models without a fit, a row each."""
    return spark.createDataFrame(list(found.skipped.items()), "model string, reason string")


def likelihood_ratio_tables(spark: SparkSession, found: Catalogue) -> DataFrame:
    """Each family's models by maximum likelihood, each against the one before it."""
    tables = [likelihood_ratio_table(spark, fits).withColumn("family", F.lit(family)) for family, fits in found.families().items()]
    return reduce(DataFrame.unionByName, tables) if tables else spark.createDataFrame([], LRT + ", family string")


def group_coefficient_tables(spark: SparkSession, found: Catalogue) -> DataFrame:
    """Coefficients per industry or firm of the last model of each family and of the models with slopes."""
    wanted = {name: fit for name, fit in found.fits.items() if isinstance(fit, MixedFit) and name.endswith((": + zip mean", ": slopes", "REML"))}
    tables = [
        fit.group_coefficients().withColumnRenamed(fit.groups.name, "group").withColumn("model", F.lit(name)) for name, fit in wanted.items()
    ]
    empty = spark.createDataFrame([], "group string, term string, value double, model string")
    return reduce(DataFrame.unionByName, tables, empty)


def _final(found: Catalogue) -> list[tuple[str, MixedFit, Factor, Factor]]:
    """The REML fits of the last hypothesis with their cycle and person factors."""
    out = []
    for who in (OCCUPATION, INSIDER):
        for part in ("tech", "all"):
            fit = found.fits.get(f"h56 {part} {who.name}: REML")
            if fit is not None:
                out.append((part, fit, next(f for f in fit.cells.factors if f.name == "cycle"), who))
    return out


def contrast_tables(spark: SparkSession, found: Catalogue) -> DataFrame:
    """Gaps between kinds of people by cycle (and tech), and between cycles by kind of people (and tech)."""
    tables = []
    for part, fit, cycle, who in _final(found):
        also = [] if part == "tech" else [TECH.name]
        for moved, by in ((who, [cycle.name, *also]), (cycle, [who.name, *also])):
            table = average_comparisons(spark, fit, fit.cells, moved, by)
            shown = F.concat_ws(", ", *[F.concat(F.lit(f"{b}="), F.col(b)) for b in by]).alias("within")
            tables.append(table.select(F.lit(f"h56 {part} {who.name}").alias("model"), shown, *[c for c in table.columns if c not in by]))
    empty = spark.createDataFrame([], "model string, within string, term string, contrast string, " + ", ".join(
        f"{c} double" for c in ("estimate", "std_error", "statistic", "p_value", "s_value", "conf_low", "conf_high")))
    return reduce(DataFrame.unionByName, tables, empty)


def prediction_tables(spark: SparkSession, found: Catalogue) -> DataFrame:
    """Mean predictions by cycle and kind of people (and tech)."""
    tables = []
    for part, fit, cycle, who in _final(found):
        by = [cycle.name, who.name] + ([] if part == "tech" else [TECH.name])
        table = mean_predictions(fit, by)
        shown = F.concat_ws(", ", *[F.concat(F.lit(f"{b}="), F.col(b).cast("string")) for b in by]).alias("within")
        tables.append(table.select(F.lit(f"h56 {part} {who.name}").alias("model"), shown, "n", "mean_prediction"))
    return reduce(DataFrame.unionByName, tables, spark.createDataFrame([], "model string, within string, n bigint, mean_prediction double"))
