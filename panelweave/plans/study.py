"""The end-to-end job: transactions to the enriched person-by-cycle panel and the people table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.occupation import occupation_flags
from panelweave.functions.scores import insider_now, padded_id, tech_flag
from panelweave.operators import industry, insiders, linkage, panel
from panelweave.operators.local_means import attach_local_means
from panelweave.plans import bind
from panelweave.session import intermediates, written
from panelweave.sources.transactions import write_partitioned

# Fixed value: columns of the published panel, in order.
PANEL_COLUMNS = (
    "cid", "cycle", "contributor_score", "gender", "employer", "employer_matched",
    "ff12_abbr", "ff12_name", "ff49_abbr", "ff49_name", "ff49_is_tech",
    "occupation", "occupation_std", "engineer", "manager", "other",
    "state", "zipcode", "city", "mean_score_city", "mean_score_zipcode",
    "mean_dyn_score_city_cycle", "mean_dyn_score_zipcode_cycle", "mean_dyn_score_city_cycle_wo_i",
    "mean_dyn_score_zipcode_cycle_wo_i", "mean_score_city_wo_i", "mean_score_zipcode_wo_i",
    "score_dyn", "n_per_zip", "n_transactions_per_cycle", "total_amount",
    "is_sec_insider", "sec_insider_now", "insider_role",
)
PEOPLE_COLUMNS = (
    "cycle", "contributor_score", "gender", "employer", "employer_matched",
    "ff12_abbr", "ff12_name", "ff49_abbr", "ff49_name", "ff49_is_tech",
    "occupation", "occupation_std", "engineer", "manager", "other",
    "state", "zipcode", "city", "mean_score_city", "mean_score_zipcode",
    "mean_score_city_wo_i", "mean_score_zipcode_wo_i", "is_sec_insider",
)


def enriched_panel(transactions: DataFrame, register: DataFrame, definitions: DataFrame, sic_list: DataFrame,
                   submissions: DataFrame, owners: DataFrame, targets: Iterable[int], *,
                   strict: float = linkage.STRICT, loose: float = linkage.LOOSE) -> DataFrame:
    """Panel with linked firm, industries, occupation, insider status and local means.

    Frames that feed several later steps are written once to the shared folder: the panel (linked,
    then joined back), the matcher, the matches, and the linked panel (read by the local means). Everything else
    stays lazy. Industries are looked up per match, a row per distinct employer, and come to the rows with it.
    """
    base = written(panel.person_cycle_panel(transactions, targets), "panel")
    matcher = linkage.build_matcher(register, loose)
    matches = written(linkage.link_companies(base, matcher, strict=strict, loose=loose), "matches")
    lookup = industry.crosswalk(definitions, sic_list)
    matches = industry.attach_industries(matches, lookup)
    industries = [c for c in lookup.columns if c.startswith("ff") and c in PANEL_COLUMNS]
    firms = linkage.attach_matches(base, matches, how="inner", keep=["matched_name", "cik", "sic", *industries])
    firms = firms.withColumnRenamed("matched_name", "employer_matched").where(F.col("cik").isNotNull())
    firms = firms.withColumn("ff49_is_tech", tech_flag(F.col("ff49_abbr"))).withColumns(occupation_flags(F.col("occupation")))
    firms = written(firms.withColumn("cik", padded_id(F.col("cik"))), "panel-firms")
    spell = insiders.person_spells(insiders.person_years(submissions, owners))
    linked = insiders.link_insiders(firms, spell).select(
        "cid", "cycle", F.col("cik_j").alias("cik"), "is_sec_insider", "insider_role", "cycle_from", "cycle_to"
    )
    people = firms.join(linked, ["cid", "cycle", "cik"], "left")
    people = people.withColumn("is_sec_insider", F.coalesce("is_sec_insider", F.lit(False)))
    now = insider_now(F.col("is_sec_insider"), F.col("cycle"), F.col("cycle_from"), F.col("cycle_to"))
    people = written(people.withColumn("sec_insider_now", now), "panel-insiders")
    return attach_local_means(people).select(*PANEL_COLUMNS)


def latest_people(enriched: DataFrame) -> DataFrame:
    """One row per person: every column's value in the latest cycle that has one."""
    return panel.latest_by_key(enriched, "cid", "cycle", PEOPLE_COLUMNS)


def publish(enriched: DataFrame, root: str, sample: bool = False) -> DataFrame:
    """Write the panel by cycle and the people by state; returns the written panel."""
    suffix = "_sample" if sample else ""
    target = f"{root}/processed_panel{suffix}"
    write_partitioned(enriched, target, "cycle", replace_all=True, files_per_key=256)
    stored = enriched.sparkSession.read.schema(enriched.schema).parquet(target)
    write_partitioned(latest_people(stored), f"{root}/processed_people{suffix}", "state", replace_all=True, files_per_key=16)
    return stored


def run(root: str, sample: bool = False, **inputs) -> DataFrame:
    """The whole job: :func:`enriched_panel` of these inputs, published; intermediate files are removed."""
    with intermediates(inputs["transactions"].sparkSession):
        return publish(enriched_panel(**inputs), root, sample)


def inputs_from_tables(spark: SparkSession, sf_dir: str, targets: Sequence[int] = bind.TARGETS) -> dict:
    """Arguments of :func:`enriched_panel` from the star-schema tables."""
    register = bind.register(spark, sf_dir)
    return {
        "transactions": bind.transactions(spark, sf_dir),
        "register": register,
        "definitions": bind.range_definitions(spark),
        "sic_list": register.where(F.col("sic").isNotNull()).select(
            F.col("sic").cast("int").alias("sic_int"), F.lit("Office").alias("sec_office"), F.col("sic_description").alias("sec_title")
        ),
        "submissions": bind.submissions(spark, sf_dir),
        "owners": bind.owners(spark, sf_dir),
        "targets": targets,
    }
