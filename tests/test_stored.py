"""Stored states extended batch by batch equal a full run."""

from pyspark.sql import functions as F

from panelweave.operators import insiders, panel, stored
from panelweave.plans import bind
from panelweave.sources import manifest

SF_DIR = "/root/testdata/sf0.001"


def _rows(df):
    return sorted((str(r.asDict()) for r in df.select(*sorted(df.columns)).collect()))


def test_quarters_extend_the_person_years(spark, tmp_path):
    root = str(tmp_path / "years")
    submissions, owners = bind.submissions(spark, SF_DIR).cache(), bind.owners(spark, SF_DIR).cache()
    year = insiders.event_columns()["year"]
    years = [r[0] for r in submissions.select(year.alias("y")).distinct().orderBy("y").collect() if r[0] is not None]
    early, late = submissions.where(year < years[-1]), submissions.where(year >= years[-1])
    part = lambda s: owners.join(s.select("ACCESSION_NUMBER"), "ACCESSION_NUMBER", "left_semi")
    stored.add_filings(spark, root, early, part(early), 0)
    before = set(manifest.current(spark, root)["parts"])
    # a first quarter of the last year, and a late statement of an earlier one
    first = late.where("pmod(hash(ACCESSION_NUMBER), 4) = 0")
    touched = stored.add_filings(spark, root, first, part(first), 1)
    assert touched == [str(years[-1])]
    assert before < set(manifest.current(spark, root)["parts"])  # every other year is the files it was
    for k in (1, 2, 3):
        rest = late.where(f"pmod(hash(ACCESSION_NUMBER), 4) = {k}")
        assert stored.add_filings(spark, root, rest, part(rest), 1 + k) == [str(years[-1])]
        assert stored.add_filings(spark, root, rest, part(rest), 1 + k) == []  # a replayed batch changes nothing
    whole = insiders.person_years(submissions, owners)
    assert _rows(stored.read_states(spark, root)) == _rows(whole)
    assert _rows(insiders.spells(insiders.persons_only(stored.read_states(spark, root)))) == _rows(insiders.spells(insiders.persons_only(whole)))
    manifest.sweep(spark, root)
    assert _rows(stored.read_states(spark, root)) == _rows(whole)


def test_only_touched_partitions_are_read(spark, tmp_path):
    root = str(tmp_path / "states")
    states = lambda y, n: spark.range(50).select(F.col("id").alias("k"), F.lit(y).alias("year"), F.lit(n).alias("n"))
    for y in (2001, 2002, 2003):
        stored.upsert_states(spark, root, states(y, 1), ["k", "year"], {"n": F.sum}, "year")
    files = {f for f in stored.read_states(spark, root, [2002]).inputFiles()}
    assert files and all("_place=2002" in f for f in files)
    stored.upsert_states(spark, root, states(2002, 5).unionByName(states(2002, 1)), ["k", "year"], {"n": F.sum}, "year")
    sums = {r["year"]: (r["rows"], r["n"]) for r in stored.read_states(spark, root).groupBy("year").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()}
    assert sums == {2001: (50, 50), 2002: (50, 350), 2003: (50, 50)}
    assert stored.read_states(spark, root, [1999]) is None


def test_batches_of_transactions_extend_the_panel(spark, tmp_path):
    root = str(tmp_path / "panel")
    rows = bind.transactions(spark, SF_DIR).cache()
    for k in range(3):
        stored.add_transactions(spark, root, rows.where(f"pmod(hash(txn_id), 3) = {k}"), k)
    got, want = stored.panel_from_states(spark, root, bind.TARGETS), panel.person_cycle_panel(rows, bind.TARGETS)
    flat = lambda df: _rows(df.withColumns({c: F.round(c, 6) for c in ("total_amount", "score_dyn")}))
    assert flat(got) == flat(want)
