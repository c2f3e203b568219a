"""Registered queries: projections, joins, aggregates, windows, sampling and descriptives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.occupation import ENGINEER_WORDS, MANAGER_WORDS, occupation_flags
from panelweave.functions.picks import first_by
from panelweave.functions.scores import (
    amount_weight, business_equipment_flag, counts_for_score, even_cycle, insider_now, padded_id, tech_flag,
)
from panelweave.operators import describe, distinct, industry, local_means, ordered, panel, ranges, sampling, stored
from panelweave.plans import bind
from panelweave.plans.bind import TARGETS, role_sql, table
from panelweave.plans.registry import query, r6, rounded
from panelweave.session import shared_path

_T = ", ".join(map(str, TARGETS))


def _txn(spark: SparkSession, d: str) -> DataFrame:
    return bind.transactions(spark, d)


def _panel(spark: SparkSession, d: str) -> DataFrame:
    return panel.person_cycle_panel(_txn(spark, d), TARGETS)


# --- projections and filters ------------------------------------------------------------------


@query("prj_prune", role_sql("txn") + " SELECT cid, cycle, txn_id, txn_type, date, employer, occupation, city, zipcode FROM txn")
def _(spark, d):
    return panel.prune(_txn(spark, d), ["cid", "cycle", "txn_id", "txn_type", "date", "employer", "occupation", "city", "zipcode"])


@query("flt_partition", role_sql("txn") + " SELECT cycle, count(*) AS n FROM txn WHERE cycle IN (1996, 1998, 2000, 2002) GROUP BY cycle")
def _(spark, d):
    rows = _txn(spark, d).where(F.col("cycle").isin(panel.needed_cycles(TARGETS)))
    return rows.groupBy("cycle").agg(F.count("*").alias("n"))


@query("flt_individuals", role_sql("raw") + " SELECT txn_id, cid, contributor_type FROM raw")
def _(spark, d):
    return panel.individuals(_txn(spark, d), TARGETS).select("txn_id", "cid", "contributor_type")


_TYPES = "('15','15E','15J','15S','15L','24E','24P')"


@query("flt_txn_types", role_sql("txn") + f""" SELECT txn_id, cid, txn_type FROM txn
    WHERE cid IS NOT NULL AND candidate_score IS NOT NULL AND txn_type IN {_TYPES}""")
def _(spark, d):
    rows = _txn(spark, d)
    return rows.where(counts_for_score(F.col("cid"), F.col("candidate_score"), F.col("txn_type"))).select("txn_id", "cid", "txn_type")


@query("prj_amount_weight", role_sql("txn") + """ SELECT txn_id, w FROM (SELECT txn_id, CAST(CASE WHEN amount <= 0 THEN 0
    WHEN amount > 0 AND amount < 5000 THEN ceil(amount / 100) WHEN amount >= 5000 THEN 50 END AS DOUBLE) AS w FROM txn) WHERE w > 0""")
def _(spark, d):
    return _txn(spark, d).select("txn_id", amount_weight(F.col("amount")).alias("w")).where("w > 0")


@query("prj_cast", """SELECT o_orderkey, CAST(o_orderstatus AS VARCHAR) AS status, CAST(o_totalprice AS BIGINT) AS price,
    TRY_CAST(split_part(o_orderpriority, '-', 2) AS BIGINT) AS text_number, TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS priority,
    CAST(o_orderdate AS DATE) AS day FROM orders""")
def _(spark, d):
    part = lambda i: F.split_part("o_orderpriority", F.lit("-"), F.lit(i))
    return table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderstatus").cast("string").alias("status"),
        F.rint("o_totalprice").cast("bigint").alias("price"), part(2).try_cast("bigint").alias("text_number"),
        part(1).try_cast("double").alias("priority"), F.col("o_orderdate").cast("date").alias("day"),
    )


_FF = "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE split_part('Softw|Hardw|Chips|Banks|Rtail|BusEq', '|', CAST(1 + p_partkey % 6 AS INT)) END"


@query("prj_tech_flag", f"""SELECT p_partkey, coalesce({_FF} IN ('Softw', 'Hardw', 'Chips'), FALSE) AS is_tech FROM part""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", tech_flag(F.expr(_FF)).alias("is_tech"))


@query("prj_ff12_tech", f"SELECT p_partkey, {_FF} = 'BusEq' AS is_tech FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", business_equipment_flag(F.expr(_FF)).alias("is_tech"))


def _words(words) -> str:
    return "|".join(words)


@query("cls_occupation", role_sql("txn") + f""" SELECT txn_id, occupation,
    CASE WHEN occupation IS NULL THEN NULL WHEN regexp_matches(occupation, '{_words(MANAGER_WORDS)}') THEN 'manager'
         WHEN regexp_matches(occupation, '{_words(ENGINEER_WORDS)}') THEN 'engineer' ELSE 'other' END AS occupation_std,
    regexp_matches(occupation, '{_words(ENGINEER_WORDS)}') AS engineer, regexp_matches(occupation, '{_words(MANAGER_WORDS)}') AS manager,
    NOT regexp_matches(occupation, '{_words(ENGINEER_WORDS)}') AND NOT regexp_matches(occupation, '{_words(MANAGER_WORDS)}') AS other FROM txn""")
def _(spark, d):
    return _txn(spark, d).select("txn_id", "occupation").withColumns(occupation_flags(F.col("occupation")))


@query("prj_pad_key", "SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik_j FROM supplier")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", padded_id(F.col("s_suppkey")).alias("cik_j"))


@query("prj_even_cycle", "SELECT o_orderkey, CAST(year(o_orderdate) + year(o_orderdate) % 2 AS BIGINT) AS cycle FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", even_cycle(F.year("o_orderdate")).cast("bigint").alias("cycle"))


@query("prj_insider_now", """SELECT o_orderkey, coalesce(flag, FALSE) AS is_sec_insider,
    coalesce(flag, FALSE) AND cycle >= lo AND cycle <= hi + 2 AS sec_insider_now FROM (
    SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS cycle, CASE WHEN o_orderkey % 3 = 0 THEN TRUE END AS flag,
    CASE WHEN o_orderkey % 3 = 0 THEN 1996 END AS lo, CASE WHEN o_orderkey % 3 = 0 THEN 1996 + o_orderkey % 4 END AS hi FROM orders)""")
def _(spark, d):
    third = F.col("o_orderkey") % 3 == 0
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.year("o_orderdate").cast("bigint").alias("cycle"),
        F.coalesce(F.when(third, F.lit(True)), F.lit(False)).alias("is_sec_insider"),
        F.when(third, F.lit(1996)).alias("lo"), F.when(third, 1996 + F.col("o_orderkey") % 4).alias("hi"),
    )
    now = insider_now(F.col("is_sec_insider"), F.col("cycle"), F.col("lo"), F.col("hi"))
    return rows.select("o_orderkey", "is_sec_insider", now.alias("sec_insider_now"))


_CASES = ("contributor_score", "occupation", "gender", "zipcode")


@query("flt_complete_case", role_sql("panel") + " SELECT cid, cycle, gender, occupation FROM panel WHERE "
       + " AND ".join(f"{c} IS NOT NULL" for c in _CASES))
def _(spark, d):
    return describe.complete_cases(_panel(spark, d), _CASES).select("cid", "cycle", "gender", "occupation")


@query("flt_complete_case_no_blank", role_sql("panel") + " SELECT cid, cycle, gender, occupation FROM panel WHERE "
       + " AND ".join(f"{c} IS NOT NULL" for c in _CASES) + " AND occupation <> '' AND gender <> '' AND zipcode <> ''")
def _(spark, d):
    return describe.complete_cases(_panel(spark, d), _CASES, drop_blank=True).select("cid", "cycle", "gender", "occupation")


@query("flt_outlier", """SELECT l_returnflag, count(*) AS n FROM (SELECT *, (l_quantity - 25) / 4 AS x FROM lineitem)
    WHERE -5 < x AND x < 5 GROUP BY l_returnflag""")
def _(spark, d):
    rows = table(spark, d, "lineitem").withColumn("x", (F.col("l_quantity") - 25) / 4)
    return describe.within(rows, "x").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("flt_outlier_count", "SELECT count(*) AS n_outliers FROM lineitem WHERE -5 > (l_quantity - 25) / 4 OR (l_quantity - 25) / 4 > 5")
def _(spark, d):
    rows = table(spark, d, "lineitem").withColumn("x", (F.col("l_quantity") - 25) / 4)
    return describe.outlier_count(rows, "x")


@query("prj_pattern_rename", "SELECT p_size AS ff12, p_name AS ff12_name, p_type AS ff12_abbr, count(*) AS n FROM part GROUP BY 1, 2, 3")
def _(spark, d):
    counts = table(spark, d, "part").groupBy("p_size", "p_name", "p_type").agg(F.count("*").alias("n"))
    return counts.withColumnsRenamed({"p_size": "ff12", "p_name": "ff12_name", "p_type": "ff12_abbr"})


@query("prj_final_schema", role_sql("panel") + " SELECT cid, cycle, employer, occupation, state, zipcode, 'name,lname,fname,mname,score_dyn' AS dropped FROM panel")
def _(spark, d):
    before = _panel(spark, d)
    after = before.select(*[c for c in before.columns if c not in ("name", "lname", "fname", "mname", "score_dyn")])
    return after.select("cid", "cycle", "employer", "occupation", "state", "zipcode",
                        F.lit(",".join(panel.dropped_columns(before, after))).alias("dropped"))


@query("flt_subset", role_sql("panel") + " SELECT cid, cycle, occupation FROM panel WHERE regexp_matches(occupation, '" + _words(MANAGER_WORDS) + "')")
def _(spark, d):
    rows = _panel(spark, d).withColumns(occupation_flags(F.col("occupation")))
    return rows.where("occupation_std = 'manager'").select("cid", "cycle", "occupation")


# --- joins -------------------------------------------------------------------------------------


@query("jn_left_key", role_sql("raw", "pooled") + """ SELECT r.cid, r.cycle, r.n, round(p.score_dyn, 9) AS score_dyn FROM
    (SELECT cid, cycle, count(*) AS n FROM raw GROUP BY cid, cycle) r LEFT JOIN pooled p ON r.cid = p.cid AND r.cycle = p.cycle""")
def _(spark, d):
    raw = panel.individuals(_txn(spark, d), TARGETS)
    counts = raw.groupBy("cid", "cycle").agg(F.count("*").alias("n"))
    scores = panel.pooled_scores(panel.weighted_sums(raw))
    return rounded(counts.join(scores, ["cid", "cycle"], "left"), "score_dyn", digits=9)


@query("jn_cluster_sample", """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (
    SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY md5('123:' || CAST(o_custkey AS VARCHAR)), o_custkey LIMIT 300)""")
def _(spark, d):
    return sampling.rows_of_sampled_ids(table(spark, d, "orders"), "o_custkey", 300).select("o_orderkey", "o_custkey")


def _codes(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.expr("CAST(100 + (p_partkey * 37) % 9900 AS INT)").alias("sic_int"))


_CODES = "code AS (SELECT p_partkey, CAST(100 + (p_partkey * 37) % 9900 AS INT) AS sic_int FROM part)"


@query("jn_range", role_sql("range_def", extra=_CODES) + """ SELECT p_partkey, sic_int, ff_num, ff_abbr, ff_name, range_desc FROM (
    SELECT c.*, r.ff_num, r.ff_abbr, r.ff_name, r.range_desc, row_number() OVER (PARTITION BY p_partkey ORDER BY r.sic_to - r.sic_from, r.ff_num, r.sic_from) AS rn
    FROM code c LEFT JOIN (SELECT * FROM range_def WHERE scheme = 49) r ON c.sic_int BETWEEN r.sic_from AND r.sic_to) WHERE rn = 1""")
def _(spark, d):
    defs = bind.range_definitions(spark).where("scheme = 49")
    return industry.range_lookup(_codes(spark, d), "sic_int", defs, "sic_from", "sic_to", ["ff_num", "ff_abbr", "ff_name", "range_desc"])


def _scheme_sql(n: int) -> str:
    return f"""s{n} AS (SELECT p_partkey, sic_int, coalesce(ff_num, o_num) AS ff{n}, coalesce(ff_abbr, o_abbr) AS ff{n}_abbr,
    coalesce(ff_name, o_name) AS ff{n}_name, range_desc AS ff{n}_detail, ff_num IS NOT NULL AS ff{n}_explicit FROM (
    SELECT c.*, r.ff_num, r.ff_abbr, r.ff_name, r.range_desc, o.ff_num AS o_num, o.ff_abbr AS o_abbr, o.ff_name AS o_name,
    row_number() OVER (PARTITION BY p_partkey ORDER BY r.sic_to - r.sic_from, r.ff_num, r.sic_from) AS rn FROM code c
    LEFT JOIN (SELECT * FROM range_def WHERE scheme = {n}) r ON c.sic_int BETWEEN r.sic_from AND r.sic_to
    CROSS JOIN (SELECT * FROM range_def WHERE scheme = {n} ORDER BY ff_num DESC LIMIT 1) o) WHERE rn = 1)"""


@query("jn_range_dates", """WITH p AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n_lines FROM lineitem GROUP BY 1),
    r AS (SELECT CAST(o_orderdate AS DATE) AS low, CAST(o_orderdate AS DATE) + CAST(o_custkey % 400 AS INTEGER) AS high, o_orderkey FROM orders)
    SELECT day, n_lines, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY high - low, o_orderkey) AS rn FROM p JOIN r ON day BETWEEN low AND high) WHERE rn = 1""")
def _(spark, d):
    # the shortest period of an order that holds a shipping day
    days = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n_lines"))
    low = F.to_date("o_orderdate")
    periods = table(spark, d, "orders").select(low.alias("low"), F.date_add(low, (F.col("o_custkey") % 400).cast("int")).alias("high"), "o_orderkey")
    found = ranges.narrowest_ranges(days, "day", periods, "low", "high", ["o_orderkey"])
    return days.join(found, "day").select("day", "n_lines", "o_orderkey")


@query("jn_range_codes", """WITH p AS (SELECT DISTINCT l_orderkey * 1000000000000 + l_partkey AS code FROM lineitem),
    r AS (SELECT p_partkey * 3000000000000 AS low, p_partkey * 3000000000000 + p_size * 1000000000000 AS high, p_partkey FROM part)
    SELECT p_partkey, count(*) AS n_codes FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY high - low, p_partkey) AS rn FROM p JOIN r ON code BETWEEN low AND high) WHERE rn = 1 GROUP BY 1""")
def _(spark, d):
    wide = F.lit(1_000_000_000_000)
    codes = table(spark, d, "lineitem").select((F.col("l_orderkey") * wide + F.col("l_partkey")).alias("code"))
    low = F.col("p_partkey") * 3 * wide
    parts = table(spark, d, "part").select(low.alias("low"), (low + F.col("p_size") * wide).alias("high"), "p_partkey")
    return ranges.narrowest_ranges(codes, "code", parts, "low", "high", ["p_partkey"]).groupBy("p_partkey").agg(F.count("*").alias("n_codes"))


@query("jn_residual_default", role_sql("range_def", extra=_CODES + ", " + _scheme_sql(12)) + " SELECT * FROM s12")
def _(spark, d):
    return industry.assign_scheme(_codes(spark, d), bind.range_definitions(spark), 12)


@query("jn_multi_scheme", role_sql("range_def", extra=", ".join([_CODES, _scheme_sql(12), _scheme_sql(48), _scheme_sql(49)])) + """
    SELECT lpad(CAST(sic_int AS VARCHAR), 4, '0') AS sic, CAST(sic_int AS INT) AS sic_int, count(*) AS n_parts, any_value(ff12_abbr) AS ff12_abbr,
    any_value(ff48_abbr) AS ff48_abbr, any_value(ff49_abbr) AS ff49_abbr, any_value(ff49_detail) AS sic_detail FROM s12 JOIN s48 USING (p_partkey, sic_int)
    JOIN s49 USING (p_partkey, sic_int) GROUP BY sic_int""")
def _(spark, d):
    parts = _codes(spark, d)
    lookup = industry.crosswalk(bind.range_definitions(spark), _sic_list(spark, d))
    counted = parts.groupBy("sic_int").agg(F.count("*").alias("n_parts"))
    return counted.join(lookup, "sic_int").select("sic", "sic_int", "n_parts", "ff12_abbr", "ff48_abbr", "ff49_abbr", "sic_detail")


def _sic_list(spark, d) -> DataFrame:
    return table(spark, d, "part").selectExpr(
        "CAST(100 + (p_partkey * 37) % 9900 AS INT) AS sic_int", "p_brand AS sec_office", "p_name AS sec_title"
    )


@query("agg_residual_counts", role_sql("range_def", extra=", ".join([
    "code AS (SELECT DISTINCT CAST(100 + (p_partkey * 37) % 9900 AS INT) AS sic_int, CAST(100 + (p_partkey * 37) % 9900 AS INT) AS p_partkey FROM part)",
    _scheme_sql(12), _scheme_sql(48), _scheme_sql(49)])) + """ SELECT CAST(sum(CASE WHEN ff12_explicit THEN 0 ELSE 1 END) AS BIGINT) AS ff12_explicit,
    CAST(sum(CASE WHEN ff48_explicit THEN 0 ELSE 1 END) AS BIGINT) AS ff48_explicit, CAST(sum(CASE WHEN ff49_explicit THEN 0 ELSE 1 END) AS BIGINT) AS ff49_explicit
    FROM s12 JOIN s48 USING (sic_int) JOIN s49 USING (sic_int)""")
def _(spark, d):
    return industry.residual_counts(industry.crosswalk(bind.range_definitions(spark), _sic_list(spark, d)))


# --- aggregates ----------------------------------------------------------------------------------


@query("agg_weighted_sums", role_sql("sums") + " SELECT cid, cycle, round(num, 6) AS num, CAST(den AS DOUBLE) AS den FROM sums")
def _(spark, d):
    return rounded(panel.weighted_sums(panel.individuals(_txn(spark, d), TARGETS)), "num")


@query("agg_two_cycle_mean", role_sql("pooled") + " SELECT cid, cycle, round(score_dyn, 9) AS score_dyn FROM pooled")
def _(spark, d):
    sums = panel.weighted_sums(panel.individuals(_txn(spark, d), TARGETS))
    return rounded(panel.pooled_scores(sums), "score_dyn", digits=9)


@query("person_cycle_panel", role_sql("panel") + " SELECT * REPLACE (round(total_amount, 4) AS total_amount, round(score_dyn, 9) AS score_dyn) FROM panel")
def _(spark, d):
    return rounded(rounded(_panel(spark, d), "total_amount", digits=4), "score_dyn", digits=9)


@query("person_cycle_panel_incremental", role_sql("panel") + " SELECT * REPLACE (round(total_amount, 4) AS total_amount, round(score_dyn, 9) AS score_dyn) FROM panel")
def _(spark, d):
    root, rows = shared_path(spark, "panel-states"), _txn(spark, d)
    for number in range(3):  # batches that cut through every cycle
        stored.add_transactions(spark, root, rows.where(F.pmod(F.xxhash64("txn_id"), F.lit(3)) == number), number)
    out = stored.panel_from_states(spark, root, TARGETS)
    return rounded(rounded(out, "total_amount", digits=4), "score_dyn", digits=9)


@query("agg_first_by_date", role_sql("raw") + " SELECT cid, cycle, " + ", ".join(bind._first_sql(c) for c in panel.FIRST_SEEN) + " FROM raw GROUP BY cid, cycle")
def _(spark, d):
    picks = [first_by(F.col(c), F.col("date"), F.col("txn_id")).alias(c) for c in panel.FIRST_SEEN]
    return panel.individuals(_txn(spark, d), TARGETS).groupBy("cid", "cycle").agg(*picks)


_LATEST = ("cycle", "employer", "occupation", "gender", "state", "zipcode", "contributor_score")


@query("agg_latest_by_key", role_sql("panel") + " SELECT cid, max(cycle) AS cycle, " + ", ".join(
    f"arg_max({c}, {{'c': cycle, 'v': {c}}}) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in _LATEST[1:]) + " FROM panel GROUP BY cid")
def _(spark, d):
    return panel.latest_by_key(_panel(spark, d), "cid", "cycle", _LATEST)


@query("agg_count_sum", role_sql("raw") + " SELECT cid, cycle, count(*) AS n, round(sum(amount), 4) AS total FROM raw GROUP BY cid, cycle")
def _(spark, d):
    raw = panel.individuals(_txn(spark, d), TARGETS)
    return rounded(raw.groupBy("cid", "cycle").agg(F.count("*").alias("n"), F.sum("amount").alias("total")), "total", digits=4)


@query("agg_distinct_count", role_sql("panel") + " SELECT zipcode, state, cycle, count(DISTINCT cid) AS n_people FROM panel GROUP BY 1, 2, 3")
def _(spark, d):
    return _panel(spark, d).groupBy("zipcode", "state", "cycle").agg(F.countDistinct("cid").alias("n_people"))


@query("agg_distinct_groupings", role_sql("panel") + """ SELECT grouping(zipcode, state, cycle) AS level, zipcode, state, cycle, count(DISTINCT cid) AS n_people FROM panel
    GROUP BY GROUPING SETS ((zipcode, state, cycle), (zipcode, state), (zipcode), (cycle), ())""")
def _(spark, d):
    sets = [["zipcode", "state", "cycle"], ["zipcode", "state"], ["zipcode"], ["cycle"], []]
    out = distinct.distinct_counts(_panel(spark, d), "cid", sets, "n_people")
    level = F.element_at(F.array(*[F.lit(v) for v in (0, 1, 3, 6, 7)]), F.col("grouping") + 1)
    return out.select(level.cast("bigint").alias("level"), "zipcode", "state", "cycle", "n_people")


@query("agg_group_mean", role_sql("panel") + """ SELECT 'city' AS level, city AS place, CAST(NULL AS BIGINT) AS cycle, round(avg(contributor_score), 9) AS mean FROM panel GROUP BY city
    UNION ALL SELECT 'zip', zipcode, NULL, round(avg(contributor_score), 9) FROM panel GROUP BY zipcode
    UNION ALL SELECT 'city_cycle', city || '/' || state, cycle, round(avg(score_dyn), 9) FROM panel GROUP BY city, state, cycle
    UNION ALL SELECT 'zip_cycle', zipcode || '/' || state, cycle, round(avg(score_dyn), 9) FROM panel GROUP BY zipcode, state, cycle""")
def _(spark, d):
    p = _panel(spark, d)
    parts = []
    for level, keys, value in (
        ("city", ["city"], "contributor_score"), ("zip", ["zipcode"], "contributor_score"),
        ("city_cycle", ["city", "state", "cycle"], "score_dyn"), ("zip_cycle", ["zipcode", "state", "cycle"], "score_dyn"),
    ):
        m = local_means.group_mean(p, keys, value, "mean")
        place = F.concat(keys[0], F.lit("/"), "state") if "state" in keys else F.col(keys[0])
        cycle = F.col("cycle") if "cycle" in keys else F.lit(None).cast("bigint")
        parts.append(m.select(F.lit(level).alias("level"), place.alias("place"), cycle.alias("cycle"), r6("mean", 9).alias("mean")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("agg_na_patterns", role_sql("panel") + """ SELECT contributor_score IS NULL AS na_contributor_score, occupation IS NULL AS na_occupation,
    gender IS NULL AS na_gender, zipcode IS NULL AS na_zipcode, count(*) AS n FROM panel GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    return describe.na_patterns(_panel(spark, d), _CASES)


@query("agg_omitted", role_sql("panel") + f""" SELECT count(*) AS n_total, count(*) - count(ok) AS n_omitted,
    round(100.0 * (count(*) - count(ok)) / count(*), 6) AS pct_omitted FROM (SELECT CASE WHEN {' AND '.join(f'{c} IS NOT NULL' for c in _CASES)} THEN 1 END AS ok FROM panel)""")
def _(spark, d):
    return rounded(describe.omitted_rows(_panel(spark, d), _CASES), "pct_omitted")


@query("agg_mean_ci", """SELECT l_returnflag, l_linestatus, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd / sqrt(n), 6) AS se,
    round(mean - 2 * sd / sqrt(n), 6) AS lo, round(mean + 2 * sd / sqrt(n), 6) AS hi FROM (
    SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd FROM lineitem GROUP BY 1, 2)""")
def _(spark, d):
    return rounded(describe.mean_ci(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity"), "mean", "sd", "se", "lo", "hi")


_WITH_TOTAL = role_sql("panel") + """ SELECT round(avg(score_dyn), 9) AS mean, CAST(cycle AS VARCHAR) AS cycle FROM panel GROUP BY cycle
    UNION SELECT round(avg(contributor_score), 9), 'All' FROM panel"""


@query("agg_mean_with_total", _WITH_TOTAL)
def _(spark, d):
    return rounded(describe.mean_with_total(_panel(spark, d), "cycle", "score_dyn", "contributor_score"), "mean", digits=9)


@query("set_union", _WITH_TOTAL)
def _(spark, d):
    p = _panel(spark, d)
    per = p.groupBy(F.col("cycle").cast("string").alias("cycle")).agg(r6(F.avg("score_dyn"), 9).alias("mean"))
    total = p.agg(r6(F.avg("contributor_score"), 9).alias("mean")).withColumn("cycle", F.lit("All"))
    return per.unionByName(total).distinct()


@query("agg_descr_two_way", """SELECT p_type, p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS sd
    FROM part GROUP BY p_type, p_brand""")
def _(spark, d):
    return rounded(describe.two_way(table(spark, d, "part"), "p_type", "p_brand", "p_retailprice"), "mean", "sd")


@query("agg_composition", role_sql("panel") + """ SELECT occupation, gender, n, round(n / sum(n) OVER (PARTITION BY occupation), 6) AS share FROM (
    SELECT occupation, gender, count(*) AS n FROM panel GROUP BY 1, 2)""")
def _(spark, d):
    return rounded(describe.composition(_panel(spark, d), "occupation", "gender"), "share")


@query("agg_box", """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS m,
    quantile_cont(l_extendedprice, 0.75) AS q3 FROM (SELECT *, exp(l_extendedprice / 20000) AS x FROM lineitem) GROUP BY 1)
    SELECT l_returnflag, count(*) AS n, round(any_value(q1), 4) AS q1, round(any_value(m), 4) AS median, round(any_value(q3), 4) AS q3,
    round(min(l_extendedprice) FILTER (WHERE l_extendedprice >= q1 - 1.5 * (q3 - q1)), 4) AS whisker_lo,
    round(max(l_extendedprice) FILTER (WHERE l_extendedprice <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_hi,
    count(*) FILTER (WHERE l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)) AS n_outliers
    FROM lineitem JOIN q USING (l_returnflag) GROUP BY l_returnflag""")
def _(spark, d):
    out = describe.box_stats(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return rounded(out, "q1", "median", "q3", "whisker_lo", "whisker_hi", digits=4)


@query("agg_quantiles", """SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.1), 6) AS q0, round(quantile_cont(value, 0.5), 6) AS q1,
    round(quantile_cont(value, 0.99), 6) AS q2 FROM events GROUP BY event_type""")
def _(spark, d):
    return rounded(describe.quantiles(table(spark, d, "events"), ["event_type"], "value", (0.1, 0.5, 0.99)), "q0", "q1", "q2")


@query("agg_histogram", """SELECT l_returnflag, bin, CAST(bin * 2500 + 1250 AS DOUBLE) AS mid, n, round(n / (sum(n) OVER (PARTITION BY l_returnflag) * 2500), 12) AS density FROM (
    SELECT l_returnflag, CAST(least(floor(l_extendedprice / 2500), 39) AS INT) AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 0 AND 100000 GROUP BY 1, 2)""")
def _(spark, d):
    out = describe.histogram(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.0, 100000.0, 40)
    return rounded(rounded(out, "mid"), "density", digits=12)


@query("agg_density", """WITH x AS (SELECT l_returnflag, l_quantity AS x FROM lineitem WHERE l_quantity BETWEEN 0 AND 50),
    bw AS (SELECT l_returnflag, count(*) AS n, 0.9 * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) * pow(count(*), -0.2) AS bw FROM x GROUP BY 1),
    cell AS (SELECT l_returnflag, floor(x / (50.0 / 256)) AS j, x / (50.0 / 256) - floor(x / (50.0 / 256)) AS f FROM x),
    mass AS (SELECT l_returnflag, j, sum(m) AS m FROM (SELECT l_returnflag, j, 1 - f AS m FROM cell UNION ALL SELECT l_returnflag, j + 1, f FROM cell) GROUP BY 1, 2),
    grid AS (SELECT CAST(i AS INT) AS point, i * 50.0 / 63 AS x FROM generate_series(0, 63) t(i))
    SELECT l_returnflag, point, CAST(round(x, 6) AS DOUBLE) AS x, round(sum(m * exp(-0.5 * pow((x - j * 50.0 / 256) / bw, 2))
      / (bw * n * sqrt(2 * pi()))), 6) AS density FROM mass JOIN bw USING (l_returnflag) CROSS JOIN grid
    WHERE abs(x - j * 50.0 / 256) <= 6 * bw GROUP BY l_returnflag, point, x""")
def _(spark, d):
    out = describe.kernel_density(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", 0.0, 50.0, grid=64, bins=256)
    return rounded(out, "x", "density")


# --- windows ---------------------------------------------------------------------------------------


def _loo_sql(keys: str, value: str, name: str) -> str:
    return (f"round(CASE WHEN count(*) OVER (PARTITION BY {keys}) > 1 THEN (sum({value}) OVER (PARTITION BY {keys}) - {value}) "
            f"/ (count(*) OVER (PARTITION BY {keys}) - 1) END, 9) AS {name}")


def _mean_sql(keys: str, value: str, name: str) -> str:
    return f"round(avg({value}) OVER (PARTITION BY {keys}), 9) AS {name}"


_LOCAL = {
    "mean_score_city": _mean_sql("city", "contributor_score", "mean_score_city"),
    "mean_score_zipcode": _mean_sql("zipcode", "contributor_score", "mean_score_zipcode"),
    "mean_dyn_score_city_cycle": _mean_sql("city, state, cycle", "score_dyn", "mean_dyn_score_city_cycle"),
    "mean_dyn_score_zipcode_cycle": _mean_sql("zipcode, state, cycle", "score_dyn", "mean_dyn_score_zipcode_cycle"),
    "mean_score_city_wo_i": _loo_sql("city", "contributor_score", "mean_score_city_wo_i"),
    "mean_score_zipcode_wo_i": _loo_sql("zipcode", "contributor_score", "mean_score_zipcode_wo_i"),
    "mean_dyn_score_city_cycle_wo_i": _loo_sql("city, state, cycle", "score_dyn", "mean_dyn_score_city_cycle_wo_i"),
    "mean_dyn_score_zipcode_cycle_wo_i": _loo_sql("zipcode, cycle", "score_dyn", "mean_dyn_score_zipcode_cycle_wo_i"),
}


@query("win_loo_mean", role_sql("panel") + " SELECT cid, cycle, " + ", ".join(_LOCAL.values()) + ", count(*) OVER (PARTITION BY zipcode) AS n_per_zip FROM panel")
def _(spark, d):
    from panelweave.session import written

    out = local_means.attach_local_means(written(_panel(spark, d), "panel"))
    return rounded(out.select("cid", "cycle", *_LOCAL, "n_per_zip"), *_LOCAL, digits=9)


@query("win_loo_mean_non_null", """SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN count(x) OVER w > 1 THEN (sum(x) OVER w - x) / (count(x) OVER w - 1) END, 6) AS others
    FROM (SELECT *, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS x FROM lineitem) WINDOW w AS (PARTITION BY l_suppkey)""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                              F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("x"))
    out = local_means.attach_group_stats(rows, ["l_suppkey"], "x", loo="others", denominator="non_null")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "others"), "others")


@query("win_group_size", "SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment) AS n_per_zip FROM customer")
def _(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return local_means.attach_group_stats(rows, ["c_mktsegment"], "c_custkey", size="n_per_zip").drop("c_mktsegment")


@query("win_zscore", "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer), 6) AS z FROM customer")
def _(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return rounded(describe.with_zscore(rows, "c_acctbal", "z").drop("c_acctbal"), "z")


@query("win_running_group", """SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (
    PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM events""")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    out = ordered.running_count(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup")
    return out.select("event_id", "user_id", "grp")


@query("win_row_number", "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS row_id FROM part")
def _(spark, d):
    rows = table(spark, d, "part").select("p_partkey")
    return ordered.row_numbers(rows, ["p_partkey"])


@query("win_dedup_first", "SELECT p_name, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_size, p_partkey) AS rn FROM part) WHERE rn = 1")
def _(spark, d):
    return ordered.first_rows(table(spark, d, "part").select("p_name", "p_size", "p_partkey"), ["p_name"], ["p_size", "p_partkey"])


@query("win_share", "SELECT o_orderpriority, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)")
def _(spark, d):
    counts = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return counts.select("o_orderpriority", "n", r6(F.col("n") / counts.agg(F.sum("n")).scalar()).alias("share"))


# --- order, samples and sets -----------------------------------------------------------------------


@query("ord_desc", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1")
def _(spark, d):
    counts = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "o_orderpriority")


@query("ord_top1", "SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ORDER BY n DESC, o_custkey LIMIT 1")
def _(spark, d):
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "o_custkey").limit(1)


def _md5_sql(key: str, seed: str) -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR))"


@query("smp_ids", f"SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY {_md5_sql('o_custkey', '123')}, o_custkey LIMIT 50")
def _(spark, d):
    return sampling.sample_ids(table(spark, d, "orders"), "o_custkey", 50)


@query("smp_reservoir", f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY {_md5_sql('o_orderkey', '123')}, o_orderkey LIMIT 2500")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return sampling.sample_rows(rows, 2500, "o_orderkey")


@query("smp_rows", f"SELECT event_id, user_id, event_type FROM events ORDER BY {_md5_sql('event_id', 'review')}, event_id LIMIT 500")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return sampling.sample_rows(rows, 500, "event_id", "review")


@query("set_union_all", role_sql("sums") + " SELECT cid, cycle + 2 AS cycle, round(num, 6) AS num FROM sums UNION ALL SELECT cid, cycle, round(num, 6) FROM sums")
def _(spark, d):
    sums = panel.weighted_sums(panel.individuals(_txn(spark, d), TARGETS)).select("cid", "cycle", r6("num").alias("num"))
    return sums.withColumn("cycle", F.col("cycle") + 2).unionByName(sums)


@query("set_bind", "SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region UNION ALL SELECT s_name, 'supplier' FROM supplier")
def _(spark, d):
    part = lambda t, c: table(spark, d, t).select(F.col(c).alias("name"), F.lit(t).alias("kind"))
    return part("nation", "n_name").unionByName(part("region", "r_name")).unionByName(part("supplier", "s_name"))


@query("set_distinct", role_sql("raw") + " SELECT DISTINCT occupation FROM raw WHERE occupation IS NOT NULL")
def _(spark, d):
    return panel.individuals(_txn(spark, d), TARGETS).where(F.col("occupation").isNotNull()).select("occupation").distinct()


@query("set_diff_cols", role_sql("raw") + " SELECT cycle, count(*) AS n, 'amount,date' AS missing FROM raw GROUP BY cycle")
def _(spark, d):
    raw = panel.individuals(_txn(spark, d), TARGETS)
    missing = panel.dropped_columns(raw, raw.drop("date", "amount"))
    return raw.groupBy("cycle").agg(F.count("*").alias("n")).withColumn("missing", F.lit(",".join(sorted(missing))))
