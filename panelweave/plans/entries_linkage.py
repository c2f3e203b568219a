"""Registered queries: company and insider linkage, validation, and the end-to-end job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.jaro import jaro_similarity
from panelweave.functions.names import ENTITY_WORDS, company_key, looks_like_entity, with_person_parts
from panelweave.functions.occupation import ENGINEER_WORDS, MANAGER_WORDS, occupation_flags
from panelweave.functions.scores import clean_ticker, filing_date
from panelweave.operators import insiders, linkage, panel, stored, validate
from panelweave.plans import bind, study
from panelweave.plans.bind import TARGETS, company_key_sql, person_sql, role_sql, table
from panelweave.plans.entries_tables import _LOCAL, _scheme_sql
from panelweave.plans.registry import query, r6, rounded
from panelweave.session import shared_path, written


def _panel(spark: SparkSession, d: str) -> DataFrame:
    return panel.person_cycle_panel(bind.transactions(spark, d), TARGETS)


def _reference(spark: SparkSession, d: str) -> DataFrame:
    return linkage.company_reference(bind.register(spark, d))


def _keys(spark: SparkSession, d: str) -> DataFrame:
    """Distinct employer keys of the panel, written once because both tiers read them."""
    raw = _panel(spark, d).where(F.col("employer").isNotNull())
    keys = raw.select(company_key(F.col("employer")).alias("query_norm")).where("query_norm <> ''").distinct()
    return written(keys, "keys")


def _matches(spark: SparkSession, d: str) -> DataFrame:
    rows = written(_panel(spark, d), "panel")
    return linkage.link_companies(rows, linkage.build_matcher(bind.register(spark, d)))


_KEYS_SQL = "keys AS (SELECT DISTINCT query_norm FROM strings WHERE query_norm <> '')"
_DIST = "round(1 - jaro_similarity(query_norm, ref_norm), 12)"
_MATCH_SQL = _KEYS_SQL + f""",
    rest AS (SELECT query_norm FROM keys WHERE query_norm NOT IN (SELECT ref_norm FROM reference)),
    pairs AS (SELECT query_norm, ref_norm, cik, {_DIST} AS distance FROM rest CROSS JOIN reference WHERE {_DIST} <= 0.06),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_norm ORDER BY distance, cik, ref_norm) AS rn FROM pairs) WHERE rn = 1),
    linked AS (SELECT query_norm, query_norm AS ref_norm, CAST(0 AS DOUBLE) AS distance, 'exact' AS match_type FROM keys WHERE query_norm IN (SELECT ref_norm FROM reference)
      UNION ALL SELECT query_norm, ref_norm, distance, 'fuzzy' FROM best),
    matches AS (SELECT s.employer_raw, s.n_rows, l.distance, coalesce(l.match_type, 'none') AS match_type, r.real_name AS matched_name, r.cik, r.sic, r.sic_description,
      CASE WHEN l.match_type = 'exact' THEN 'auto_accept' WHEN l.distance <= 0.03 THEN 'auto_accept' WHEN l.distance <= 0.06 THEN 'needs_review' ELSE 'no_match' END AS status
      FROM strings s LEFT JOIN linked l USING (query_norm) LEFT JOIN reference r USING (ref_norm))"""
_MATCH = role_sql("strings", "reference", extra=_MATCH_SQL)


@query("lnk_norm_company", role_sql("register") + f" SELECT cik, real_name, {company_key_sql('real_name')} AS ref_norm FROM register")
def _(spark, d):
    return bind.register(spark, d).select("cik", "real_name", company_key(F.col("real_name")).alias("ref_norm"))


@query("lnk_norm_person", role_sql("txn", "owner") + f""" SELECT 'contributor' AS side, txn_id, {person_sql('name', False, ('last', 'first', 'mi'))} FROM txn
    UNION ALL SELECT 'register', CAST(ACCESSION_NUMBER AS BIGINT), {person_sql('RPTOWNERNAME', True, ('last', 'first', 'mi'))} FROM owner""")
def _(spark, d):
    def side(df, label, key, name, surname_first):
        rows = df.select(F.lit(label).alias("side"), F.col(key).cast("bigint").alias("txn_id"), name)
        return with_person_parts(rows, name, surname_first).drop(name)

    return side(bind.transactions(spark, d), "contributor", "txn_id", "name", False).unionByName(
        side(bind.owners(spark, d), "register", "ACCESSION_NUMBER", "RPTOWNERNAME", True)
    )


@query("lnk_preview", role_sql("owner") + f""" SELECT raw, {person_sql('raw', True, ('last', 'first', 'mi'))} FROM (
    SELECT unnest([RPTOWNERNAME, upper(RPTOWNERNAME)]) AS raw FROM owner)""")
def _(spark, d):
    raw = bind.owners(spark, d).select(F.explode(F.array("RPTOWNERNAME", F.upper("RPTOWNERNAME"))).alias("raw"))
    return with_person_parts(raw, "raw", True)


@query("lnk_reference", role_sql("reference") + " SELECT ref_norm, cik, real_name, sic, sic_description FROM reference")
def _(spark, d):
    return _reference(spark, d)


@query("lnk_exact", role_sql("strings", "reference", extra=_KEYS_SQL) + " SELECT query_norm, cik, sic FROM keys JOIN reference ON query_norm = ref_norm")
def _(spark, d):
    ref = _reference(spark, d).withColumnRenamed("ref_norm", "query_norm")
    return _keys(spark, d).join(ref, "query_norm").select("query_norm", "cik", "sic")


@query("lnk_jaro", role_sql("txn") + """ SELECT txn_id, round(jaro_similarity(lower(employer), p_name || ' ' || lower(p_type)), 9) AS similarity
    FROM txn JOIN orders ON o_orderkey = txn_id JOIN part ON p_partkey = o_custkey""")
def _(spark, d):
    # the employer as an order states it against the firm's name: one pair per order
    rows = bind.transactions(spark, d).select("txn_id", "employer").join(
        table(spark, d, "orders").select(F.col("o_orderkey").alias("txn_id"), F.col("o_custkey").alias("p_partkey")), "txn_id"
    ).join(table(spark, d, "part"), "p_partkey")
    firm = F.concat("p_name", F.lit(" "), F.lower("p_type"))
    return rows.select("txn_id", r6(jaro_similarity(F.lower("employer"), firm), 9).alias("similarity"))


@query("lnk_candidates", role_sql("strings", "reference", extra=_KEYS_SQL) + f""" SELECT query_norm, ref_norm, round({_DIST}, 9) AS distance
    FROM keys CROSS JOIN reference WHERE {_DIST} <= 0.06""")
def _(spark, d):
    pairs = linkage.candidate_pairs(_keys(spark, d), written(_reference(spark, d), "reference"), 0.06)
    return pairs.select("query_norm", "ref_norm", r6("distance", 9).alias("distance"))


@query("lnk_nearest", role_sql("strings", "reference", extra=_KEYS_SQL) + f""" SELECT query_norm, ref_norm, round(distance, 9) AS distance FROM (
    SELECT *, row_number() OVER (PARTITION BY query_norm ORDER BY distance, cik, ref_norm) AS rn FROM (
    SELECT query_norm, ref_norm, cik, {_DIST} AS distance FROM keys CROSS JOIN reference WHERE {_DIST} <= 0.1)) WHERE rn = 1""")
def _(spark, d):
    ref = written(_reference(spark, d), "reference")
    best = linkage.nearest(linkage.candidate_pairs(_keys(spark, d), ref, 0.1), ref)
    return best.select("query_norm", "ref_norm", r6("distance", 9).alias("distance"))


@query("jn_tiered_fuzzy", _MATCH + " SELECT employer_raw, round(distance, 9) AS distance, match_type, matched_name, cik, sic, sic_description, status FROM matches")
def _(spark, d):
    return _matches(spark, d).drop("n_rows").withColumn("distance", r6("distance", 9))


@query("lnk_status", _MATCH + " SELECT status, match_type, count(*) AS n, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM matches GROUP BY 1, 2")
def _(spark, d):
    return _matches(spark, d).groupBy("status", "match_type").agg(F.count("*").alias("n"), F.sum("n_rows").alias("n_rows"))


@query("agg_status_counts", _MATCH + " SELECT status, match_type, count(*) AS n FROM matches GROUP BY 1, 2 ORDER BY n DESC")
def _(spark, d):
    return linkage.status_counts(_matches(spark, d))


@query("lnk_accept", _MATCH + " SELECT employer_raw, matched_name, cik FROM matches WHERE status = 'auto_accept' AND length(employer_raw) > 0")
def _(spark, d):
    return linkage.accepted(_matches(spark, d)).select("employer_raw", "matched_name", "cik")


@query("jn_inner_lookup", _MATCH + """ SELECT p.cid, p.cycle, p.employer, m.matched_name, m.sic FROM panel p JOIN matches m ON p.employer = m.employer_raw
    WHERE m.status = 'auto_accept' AND length(m.employer_raw) > 0""")
def _(spark, d):
    rows = written(_panel(spark, d), "panel")
    matches = linkage.link_companies(rows, _reference(spark, d))
    return linkage.attach_matches(rows, matches, how="inner").select("cid", "cycle", "employer", "matched_name", "sic")


@query("jn_expand", _MATCH + " SELECT p.cid, p.cycle, p.employer, m.status, m.cik FROM panel p LEFT JOIN matches m ON p.employer = m.employer_raw")
def _(spark, d):
    rows = written(_panel(spark, d), "panel")
    matches = linkage.link_companies(rows, _reference(spark, d))
    return linkage.attach_matches(rows, matches).select("cid", "cycle", "employer", "status", "cik")


@query("agg_match_propensity", _MATCH + """ SELECT n_matched, n_total, round(n_matched / n_total, 9) AS match_propensity FROM (
    SELECT CAST((SELECT sum(n_rows) FROM matches WHERE status = 'auto_accept' AND length(employer_raw) > 0) AS BIGINT) AS n_matched, (SELECT count(*) FROM panel) AS n_total)""")
def _(spark, d):
    rows = written(_panel(spark, d), "panel")
    out = linkage.match_propensity(rows, linkage.link_companies(rows, _reference(spark, d)))
    return rounded(out, "match_propensity", digits=9)


# --- validation ------------------------------------------------------------------------------------

_WIDE_SQL = _KEYS_SQL + f""",
    pairs AS (SELECT query_norm, min({_DIST}) AS distance FROM keys CROSS JOIN reference WHERE {_DIST} <= 0.05 GROUP BY query_norm),
    scored AS (SELECT employer_raw, distance FROM strings LEFT JOIN pairs USING (query_norm))"""


def _scored(spark, d) -> DataFrame:
    return validate.score_once(written(_panel(spark, d), "panel"), written(_reference(spark, d), "reference"))


@query("val_threshold_sweep", role_sql("strings", "reference", extra=_WIDE_SQL) + """ SELECT strict_dist, count(*) AS n, count(*) FILTER (WHERE distance <= strict_dist) AS n_accepted,
    round(count(*) FILTER (WHERE distance <= strict_dist) / count(*), 9) AS match_propensity FROM scored CROSS JOIN
    (SELECT unnest([CAST(0.05 AS DOUBLE), 0.04, 0.03, 0.02, 0.01]) AS strict_dist) GROUP BY strict_dist""")
def _(spark, d):
    return rounded(validate.threshold_sweep(_scored(spark, d)), "match_propensity", digits=9)


@query("val_label_rates", """WITH pairs AS (SELECT doc_id, quality, toxic, n_chars % 97 AS d FROM documents JOIN labels USING (doc_id))
    SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (WHERE d / 100.0 <= threshold AND quality = 0) AS false_positives,
    count(*) FILTER (WHERE NOT d / 100.0 <= threshold AND quality = 0) AS false_negatives,
    round(avg(CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE d / 100.0 <= threshold), 9) AS false_positives_share,
    round(avg(CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT d / 100.0 <= threshold), 9) AS false_negatives_share
    FROM pairs CROSS JOIN (SELECT unnest([CAST(0.5 AS DOUBLE), 0.4, 0.3, 0.2, 0.1]) AS threshold) GROUP BY threshold""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", ((F.col("n_chars") % 97) / F.lit(100.0)).alias("distance"))
    labels = table(spark, d, "labels").select("doc_id", (F.col("quality") == 0).alias("is_error"))
    out = validate.label_rates(docs, labels, (0.5, 0.4, 0.3, 0.2, 0.1), key="doc_id")
    return rounded(out, "false_positives_share", "false_negatives_share", digits=9)


@query("val_review_sample", _MATCH + f""", near AS (SELECT query_norm, arg_min(ref_norm, {{'d': distance, 'c': cik, 'r': ref_norm}}) AS nearest, round(min(distance), 9) AS nearest_distance FROM (
    SELECT query_norm, ref_norm, cik, {_DIST} AS distance FROM keys CROSS JOIN reference) GROUP BY query_norm)
    SELECT kind, employer_raw, matched_name, status, nearest, nearest_distance, r <= 500 AS sampled FROM (
    SELECT 'accepted' AS kind, *, row_number() OVER (ORDER BY md5('123:' || employer_raw), employer_raw) AS r FROM matches WHERE match_type = 'fuzzy' AND status = 'auto_accept'
    UNION ALL SELECT 'rejected', *, row_number() OVER (ORDER BY md5('123:' || employer_raw), employer_raw) FROM matches WHERE status <> 'auto_accept') s LEFT JOIN strings USING (employer_raw) LEFT JOIN near ON near.query_norm = strings.query_norm""")
def _(spark, d):
    matcher = linkage.build_matcher(bind.register(spark, d))
    matches = written(linkage.link_companies(written(_panel(spark, d), "panel"), matcher), "matches")
    reference = (matcher, linkage.matcher_of(matcher.reference, 0.1))  # both kinds are compared with the same blocking keys
    shown = ("employer_raw", "matched_name", "status", "nearest", r6("nearest_distance", 9).alias("nearest_distance"), "sampled")
    part = lambda kind: validate.review_sample(matches, kind, reference=reference).select(F.lit(kind).alias("kind"), *shown)
    return part("accepted").unionByName(part("rejected"))


# --- insiders --------------------------------------------------------------------------------------


def _years(spark, d) -> DataFrame:
    return insiders.person_years(bind.submissions(spark, d), bind.owners(spark, d))


def _spells(spark, d) -> DataFrame:
    return insiders.person_spells(_years(spark, d))


@query("prj_event_date", role_sql("submission") + """ SELECT ACCESSION_NUMBER AS accession, try_strptime(trim(FILING_DATE), '%d-%b-%Y')::DATE AS filed_date,
    try_strptime(trim(PERIOD_OF_REPORT), '%d-%b-%Y')::DATE AS period_date, coalesce(try_strptime(trim(PERIOD_OF_REPORT), '%d-%b-%Y')::DATE, try_strptime(trim(FILING_DATE), '%d-%b-%Y')::DATE) AS event,
    CAST(coalesce(TRY_CAST(right(trim(PERIOD_OF_REPORT), 4) AS INTEGER), year(try_strptime(trim(FILING_DATE), '%d-%b-%Y'))) AS INTEGER) AS year FROM submission""")
def _(spark, d):
    dated = {name: made.alias(name) for name, made in insiders.event_columns().items()}
    return bind.submissions(spark, d).select(F.col("ACCESSION_NUMBER").alias("accession"), *dated.values())


@query("prj_like_flags", role_sql("owner") + """ SELECT ACCESSION_NUMBER AS accession, is_officer, is_director FROM (SELECT *, upper(coalesce(RPTOWNER_RELATIONSHIP, '')) LIKE '%OFFICER%' AS is_officer,
    upper(coalesce(RPTOWNER_RELATIONSHIP, '')) LIKE '%DIRECTOR%' AS is_director FROM owner) WHERE is_officer OR is_director""")
def _(spark, d):
    flags = [made.alias(name) for name, made in insiders.role_columns().items()]
    return bind.owners(spark, d).select(F.col("ACCESSION_NUMBER").alias("accession"), *flags).where("is_officer or is_director")


@query("prj_ticker_clean", role_sql("submission") + " SELECT ACCESSION_NUMBER AS accession, nullif(upper(trim(ISSUERTRADINGSYMBOL)), 'NONE') AS ticker FROM submission")
def _(spark, d):
    return bind.submissions(spark, d).select(F.col("ACCESSION_NUMBER").alias("accession"), clean_ticker(F.col("ISSUERTRADINGSYMBOL")).alias("ticker"))


# every word as it may be written, and beside each a longer word that only contains it
_SPELLED = [s for w in ENTITY_WORDS for s in dict.fromkeys((w.replace("\\.?", "."), w.replace("\\.?", "").capitalize()))]
_ENDINGS = [e for w in _SPELLED for e in (w, w + "x", w + "y" if "." in w else "x" + w)]


@query("prj_entity_flag", role_sql("owner") + f""" SELECT RPTOWNERNAME || ' ' || split_part('{'|'.join(_ENDINGS)}', '|', CAST(1 + e AS INT)) AS name, count(*) AS n,
    RPTOWNERNAME LIKE 'Acorn%' OR e % 3 = 0 AS is_entity FROM (SELECT RPTOWNERNAME, CAST(ACCESSION_NUMBER AS BIGINT) % {len(_ENDINGS)} AS e FROM owner) GROUP BY RPTOWNERNAME, e""")
def _(spark, d):
    ending = F.element_at(F.array(*[F.lit(e) for e in _ENDINGS]), (F.col("ACCESSION_NUMBER").cast("bigint") % len(_ENDINGS) + 1).cast("int"))
    counts = bind.owners(spark, d).groupBy(F.concat_ws(" ", "RPTOWNERNAME", ending).alias("name")).agg(F.count("*").alias("n"))
    return counts.withColumn("is_entity", looks_like_entity(F.col("name")))


@query("jn_using", role_sql("filing") + " SELECT owner_cik, cik, year, is_officer, is_director, has_form3, event, owner_title FROM filing")
def _(spark, d):
    rows = insiders.officer_filings(bind.submissions(spark, d), bind.owners(spark, d))
    return rows.select("owner_cik", "cik", "year", "is_officer", "is_director", "has_form3", "event", "owner_title")


@query("agg_insider_year", role_sql("person_year") + " SELECT * FROM person_year")
def _(spark, d):
    return _years(spark, d)


@query("agg_year_counts", role_sql("person_year") + " SELECT year, count(*) AS n FROM person_year GROUP BY year")
def _(spark, d):
    return _years(spark, d).groupBy("year").agg(F.count("*").alias("n"))


@query("agg_person_count", role_sql("person") + " SELECT count(*) AS n_rows, count(DISTINCT owner_cik) AS n_people FROM person")
def _(spark, d):
    return insiders.persons_only(_years(spark, d)).agg(F.count("*").alias("n_rows"), F.countDistinct("owner_cik").alias("n_people"))


@query("agg_bool_any", role_sql("person") + """ SELECT owner_cik, bool_or(is_officer) AS any_officer, bool_or(is_director) AS any_director,
    bool_or(has_form3) AS any_form3 FROM person GROUP BY owner_cik""")
def _(spark, d):
    return insiders.persons_only(_years(spark, d)).groupBy("owner_cik").agg(
        F.bool_or("is_officer").alias("any_officer"), F.bool_or("is_director").alias("any_director"), F.bool_or("has_form3").alias("any_form3")
    )


@query("agg_spell", role_sql("spell") + " SELECT * REPLACE (CAST(cycle_from AS INTEGER) AS cycle_from, CAST(cycle_to AS INTEGER) AS cycle_to) FROM spell")
def _(spark, d):
    return _spells(spark, d)


def _stored_years(spark, d) -> DataFrame:
    """Person-years from filings that arrive year by year of filing, late statements of earlier years among them."""
    root = shared_path(spark, "person-years")
    submissions, owners = written(bind.submissions(spark, d), "submissions"), written(bind.owners(spark, d), "owners")
    filed = F.year(filing_date(F.col("FILING_DATE"))) % 3
    for number in range(3):
        batch = submissions.where(F.coalesce(filed, F.lit(0)) == number)
        stored.add_filings(spark, root, batch, owners.join(batch.select("ACCESSION_NUMBER"), "ACCESSION_NUMBER", "left_semi"), number)
    return stored.read_states(spark, root)


@query("agg_insider_year_incremental", role_sql("person_year") + " SELECT * FROM person_year")
def _(spark, d):
    return _stored_years(spark, d)


@query("agg_spell_incremental", role_sql("spell") + " SELECT * REPLACE (CAST(cycle_from AS INTEGER) AS cycle_from, CAST(cycle_to AS INTEGER) AS cycle_to) FROM spell")
def _(spark, d):
    return insiders.person_spells(_stored_years(spark, d))


@query("prj_role", role_sql("spell") + """ SELECT owner_cik, cik, CASE WHEN ever_officer AND ever_director THEN 'officer_director' WHEN ever_officer THEN 'officer'
    WHEN ever_director THEN 'director' END AS insider_role FROM spell""")
def _(spark, d):
    role = insiders.role_name(F.col("ever_officer"), F.col("ever_director"))
    return _spells(spark, d).select("owner_cik", "cik", role.alias("insider_role"))


def _people(spark, d) -> DataFrame:
    """Panel people with the firm number of their city."""
    rows = _panel(spark, d).where("cid IS NOT NULL").withColumns(occupation_flags(F.col("occupation")))
    return written(rows.withColumn("cik", (F.split_part("city", F.lit(" "), F.lit(2)).cast("bigint") + 1000)), "people")


_OCCUPATION_SQL = f"""CASE WHEN occupation IS NULL THEN NULL WHEN regexp_matches(occupation, '{'|'.join(MANAGER_WORDS)}') THEN 'manager'
      WHEN regexp_matches(occupation, '{'|'.join(ENGINEER_WORDS)}') THEN 'engineer' ELSE 'other' END AS occupation_std"""
# from ``people`` (cid, cycle, cik, name) and spells to the insiders nobody else can be taken for: distinct names are
# parsed once on either side, and a fit is kept where no second owner fits the same person and firm
_FOUND_SQL = f"""said AS (SELECT name, {person_sql('name', False, ('surname', 'given', 'letter'))} FROM (SELECT DISTINCT name FROM people)),
    filed AS (SELECT owner_name_raw, {person_sql('owner_name_raw', True, ('surname', 'given', 'letter'))} FROM (SELECT DISTINCT owner_name_raw FROM spell)),
    namesake AS (SELECT name, owner_name_raw FROM said JOIN filed ON said.surname = filed.surname AND said.given = filed.given
      AND coalesce(said.letter, filed.letter, '') = coalesce(filed.letter, said.letter, '')),
    fit AS (SELECT p.cid, p.cycle, s.cik AS cik_j, p.name, s.owner_cik, s.owner_name_raw, s.issuer_name, s.title_label, s.ever_officer, s.ever_director,
      CAST(s.cycle_from AS INTEGER) AS cycle_from, CAST(s.cycle_to AS INTEGER) AS cycle_to
      FROM people p, namesake, spell s WHERE namesake.name = p.name AND s.owner_name_raw = namesake.owner_name_raw AND CAST(s.cik AS BIGINT) = CAST(p.cik AS BIGINT)),
    found AS (SELECT *, nullif(concat_ws('_', CASE WHEN ever_officer THEN 'officer' END, CASE WHEN ever_director THEN 'director' END), '') AS insider_role
      FROM fit WHERE NOT EXISTS (SELECT 1 FROM fit other WHERE other.cid = fit.cid AND other.cycle = fit.cycle AND other.cik_j = fit.cik_j
        AND other.owner_cik <> fit.owner_cik))"""
_INSIDER_SQL = f"""people AS (SELECT *, CAST(split_part(city, ' ', 2) AS BIGINT) + 1000 AS cik, {_OCCUPATION_SQL} FROM panel WHERE cid IS NOT NULL),
    {_FOUND_SQL}"""


@query("lnk_insiders", role_sql("panel", "spell", extra=_INSIDER_SQL) + """ SELECT cid, cycle, cik_j, name, owner_cik, owner_name_raw, issuer_name, title_label, ever_officer, ever_director,
    cycle_from, cycle_to, TRUE AS is_sec_insider, insider_role FROM found""")
def _(spark, d):
    return insiders.link_insiders(_people(spark, d), _spells(spark, d))


@query("val_review_insiders", role_sql("panel", "spell", extra=_INSIDER_SQL) + """ SELECT cid || ':' || cycle || ':' || cik_j AS pair, name, owner_name_raw, issuer_name, insider_role
    FROM found ORDER BY md5('123:' || cid || ':' || cycle || ':' || cik_j), pair LIMIT 40""")
def _(spark, d):
    return validate.review_insiders(insiders.link_insiders(_people(spark, d), _spells(spark, d)), 40)


@query("jn_equi_theta", role_sql("panel", "spell", extra=_INSIDER_SQL) + """ SELECT cid, cycle, cik_j, count(*) AS n_fitting, count(DISTINCT owner_cik) AS n_owners FROM fit GROUP BY cid, cycle, cik_j""")
def _(spark, d):
    fits = insiders.fitting_owners(_people(spark, d), _spells(spark, d))
    return fits.select("cid", "cycle", "cik_j", "n_fitting", "n_owners")


@query("jn_unique_reject", role_sql("panel", "spell", extra=_INSIDER_SQL) + """ SELECT cid, cycle, cik_j FROM fit EXCEPT SELECT cid, cycle, cik_j FROM found""")
def _(spark, d):
    fits = insiders.fitting_owners(_people(spark, d), _spells(spark, d))
    return fits.where("n_owners > 1").select("cid", "cycle", "cik_j")


@query("jn_semi", role_sql("panel", "spell", extra=_INSIDER_SQL) + """ SELECT cid, cycle, occupation_std FROM people WHERE EXISTS (SELECT 1 FROM found
    WHERE found.cid = people.cid AND found.cycle = people.cycle AND CAST(found.cik_j AS BIGINT) = people.cik)""")
def _(spark, d):
    people = _people(spark, d)
    keys = insiders.link_insiders(people, _spells(spark, d)).select("cid", "cycle")
    return people.select("cid", "cycle", "occupation_std").join(keys, ["cid", "cycle"], "left_semi")


@query("lnk_coding_check", role_sql("panel", "spell", extra=_INSIDER_SQL) + """ SELECT occupation_std, n, round(n / sum(n) OVER (), 9) AS share FROM (
    SELECT occupation_std, count(*) AS n FROM people SEMI JOIN (SELECT cid, cycle FROM found) k USING (cid, cycle) WHERE occupation_std IS NOT NULL GROUP BY 1)""")
def _(spark, d):
    people = _people(spark, d)
    return rounded(insiders.coding_check(people, insiders.link_insiders(people, _spells(spark, d))), "share", digits=9)


# --- the whole job ---------------------------------------------------------------------------------


_ENGINEER, _MANAGER = (f"regexp_matches(occupation, '{'|'.join(w)}')" for w in (ENGINEER_WORDS, MANAGER_WORDS))
_STUDY_SQL = _MATCH_SQL + f""",
    people AS (SELECT p.*, m.matched_name AS employer_matched, m.cik, m.sic, CAST(m.sic AS INT) AS sic_int, {_OCCUPATION_SQL.replace('occupation IS', 'p.occupation IS')}
      FROM panel p JOIN matches m ON p.employer = m.employer_raw WHERE m.status = 'auto_accept' AND length(m.employer_raw) > 0),
    code AS (SELECT DISTINCT sic_int AS p_partkey, sic_int FROM people), {_scheme_sql(12)}, {_scheme_sql(49)}, {_FOUND_SQL},
    study AS (SELECT * REPLACE (round(total_amount, 4) AS total_amount, round(score_dyn, 9) AS score_dyn), {', '.join(_LOCAL.values())}, count(*) OVER (PARTITION BY zipcode) AS n_per_zip FROM (
      SELECT p.*, ff12_abbr, ff12_name, ff49_abbr, ff49_name, coalesce(ff49_abbr IN ('Softw', 'Hardw', 'Chips'), FALSE) AS ff49_is_tech, {_ENGINEER} AS engineer, {_MANAGER} AS manager,
      NOT {_ENGINEER} AND NOT {_MANAGER} AS other, f.owner_cik IS NOT NULL AS is_sec_insider,
      f.owner_cik IS NOT NULL AND p.cycle >= f.cycle_from AND p.cycle <= f.cycle_to + 2 AS sec_insider_now, f.insider_role
      FROM people p JOIN s12 USING (sic_int) JOIN s49 USING (sic_int) LEFT JOIN found f ON p.cid = f.cid AND p.cycle = f.cycle AND lpad(CAST(p.cik AS VARCHAR), 10, '0') = f.cik_j))"""
STUDY = role_sql("strings", "reference", "range_def", "spell", extra=_STUDY_SQL)
_ROUNDED = [c for c in study.PANEL_COLUMNS if c.startswith("mean_")]


@query("study_panel", STUDY + f" SELECT {', '.join(study.PANEL_COLUMNS)} FROM study")
def _(spark, d):
    out = study.enriched_panel(**study.inputs_from_tables(spark, d))
    return rounded(rounded(out, "score_dyn", *_ROUNDED, digits=9), "total_amount", digits=4)


LATEST_SQL = ", ".join(f"arg_max({c}, {{'c': cycle, 'v': {c}}}) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in study.PEOPLE_COLUMNS[1:])


@query("study_people", STUDY + f" SELECT cid, max(cycle) AS cycle, {LATEST_SQL} FROM study GROUP BY cid")
def _(spark, d):
    out = study.latest_people(study.enriched_panel(**study.inputs_from_tables(spark, d)))
    return rounded(out, *[c for c in _ROUNDED if c in out.columns], digits=9)
