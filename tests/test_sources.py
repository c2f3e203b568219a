"""File formats: dirty CSV, encodings, JSON profiles, TSV, partitioned output and incremental runs."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from panelweave.operators import panel
from panelweave.session import written
from panelweave.sources import audit, registers, transactions
from panelweave.streaming.incremental import convert_new_files, read_converted

COLUMNS = ("cycle", "txn_id", "amount", "employer", "city")


def _write(path, data: bytes, zipped=False):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with (gzip.open if zipped else open)(path, "wb") as f:
        f.write(data)


HEADER = b"cycle,txn_id,amount,employer,city\n"
DIRTY = HEADER + (
    b'2016,1,10.5,"Acme ""Big"" Co",Bonn\n'
    b'2016,2,\\N,"two\\\nlines",Ulm\n'
    b"2016,3,junk,,\\N\n"
    b"bad,4,1,x,y\n"
    b"2016,5,7\n"
    b"2016,6,7,a,b,c,d\n"
    b"2016,7,1e2,back\\slash,end\\\n"
    b'2016,8,1,"tail\\"\n'
)


@pytest.mark.parametrize("zipped", [False, True])
def test_dirty_csv(spark, tmp_path, zipped):
    path = str(tmp_path / ("txn_2016.csv.gz" if zipped else "txn_2016.csv"))
    _write(path, DIRTY, zipped)
    rows = {r["txn_id"]: r for r in transactions.read_dirty_csv(spark, path, COLUMNS).collect()}
    assert rows["1"]["employer"] == 'Acme "Big" Co'
    assert rows["2"]["employer"] == "two\nlines" and rows["2"]["amount"] is None
    assert rows["3"]["employer"] == "" and rows["3"]["city"] is None
    assert rows["5"]["row_state"] == "short" and rows["5"]["city"] is None
    assert rows["6"]["row_state"] == "long"
    assert rows["7"]["employer"] == "back\\slash" and rows["7"]["city"] == "end"
    assert rows["8"]["employer"] == "tail\\" and rows["8"]["row_state"] == "short"
    typed = {r["txn_id"]: r for r in transactions.typed(transactions.read_dirty_csv(spark, path, COLUMNS)).collect()}
    assert set(typed) == {"1", "2", "3", "5", "7", "8"}
    assert typed["3"]["amount"] is None and typed["7"]["amount"] == 100.0 and typed["1"]["cycle"] == 2016


def test_mixed_encodings(spark, tmp_path):
    _write(str(tmp_path / "txn_2016.csv"), HEADER + "2016,1,1,Müller,Köln\n".encode("utf-8"))
    _write(str(tmp_path / "txn_2018.csv"), HEADER + "2018,2,1,Müller,Köln\n".encode("latin-1"))
    rows = transactions.read_files(spark, str(tmp_path), COLUMNS).collect()
    assert {r["employer"] for r in rows} == {"Müller"} and len(rows) == 2
    probe = {os.path.basename(r["source_file"]): (r["n_lines"], r["is_utf8"]) for r in transactions.probe_files(spark, str(tmp_path)).collect()}
    assert probe == {"txn_2016.csv": (2, True), "txn_2018.csv": (2, False)}


def test_key_from_path(spark):
    df = spark.createDataFrame([("file:/x/txn_2016.csv",)], "p string")
    assert df.select(transactions.key_from_path(F.col("p"))).first()[0] == 2016
    for bad in ("file:/x/txn_1812.csv", "file:/x/readme.csv"):
        with pytest.raises(Exception, match="no key in range"):
            spark.createDataFrame([(bad,)], "p string").select(transactions.key_from_path(F.col("p"))).collect()


def test_source_names_cover_the_panel():
    names = set(transactions.SOURCE_NAMES.values())
    assert set(panel.SOURCE_COLUMNS) <= names and len(names) == 45


def test_partitions_keep_type_and_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(10).select("id", (2014 + 2 * (F.col("id") % 3)).alias("cycle"))
    transactions.write_partitioned(df, path, "cycle")
    transactions.write_partitioned(df.where("cycle = 2016").limit(1), path, "cycle")
    back = transactions.read_partitioned(spark, path, df.schema)
    assert back.schema["cycle"].dataType.simpleString() == "bigint"
    assert {r["cycle"]: r["n_rows"] for r in transactions.partition_summary(back).collect()} == {2014: 4, 2016: 1, 2018: 3}
    transactions.write_partitioned(df.where("cycle = 2014"), path, "cycle", replace_all=True)
    assert transactions.read_partitioned(spark, path, df.schema).count() == 4
    scan = transactions.read_partitioned(spark, path, df.schema).where("cycle = 2014")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cycle" in scan


def test_profiles_one_per_file(spark, tmp_path):
    docs = {
        "a": b'{"cik": "0000320193", "name": "Acme",\n "sic": "", "sicDescription": "x", "extra": {"k": 1}}',
        "b": b'{"cik": "7", "sic": "1000"}',
        "c": b'{"cik": "8", "name": "B',
    }
    for k, v in docs.items():
        _write(str(tmp_path / f"{k}.json"), v)
    assert [tuple(r) for r in registers.read_profiles(spark, str(tmp_path)).collect()] == [(320193, "Acme", None, "x")]


def test_tsv_union(spark, tmp_path):
    _write(str(tmp_path / "q1" / "t.tsv"), b'A\tTITLE\n1\tthe "boss"\n2\t"open\n')
    _write(str(tmp_path / "q2" / "t.tsv"), b"A\tOTHER\n3\tx\n")
    rows = registers.read_tsv_union(spark, [str(tmp_path / q) for q in ("q1", "q2")]).orderBy("A").collect()
    assert [tuple(r) for r in rows] == [("1", 'the "boss"', None), ("2", '"open', None), ("3", None, "x")]
    _write(str(tmp_path / "q3" / "t.tsv"), b"A\tB\n1\t2\t3\n")
    with pytest.raises(Exception):
        registers.read_tsv_union(spark, [str(tmp_path / "q3")]).collect()


def test_audit_and_ledger(spark, tmp_path):
    _write(str(tmp_path / "txn_2016.csv"), DIRTY)
    path = str(tmp_path / "txn_2016.csv")
    rows = transactions.typed(transactions.read_dirty_csv(spark, path, COLUMNS))
    rows = rows.withColumn("file_cycle", transactions.key_from_path(F.col("source_file")))
    good = audit.audit(rows, "cycle", "file_cycle", COLUMNS).first()
    assert (good["n"], good["n_wrong"], good["complete"]) == (6, 0, True)
    wrong = rows.withColumn("cycle", F.when(F.col("txn_id") == "1", None).otherwise(F.col("cycle")))
    assert audit.audit(wrong, "cycle", "file_cycle", COLUMNS).first()["complete"] is False
    raw = transactions.read_dirty_csv(spark, path, COLUMNS)
    entry = audit.ledger_rows(raw, transactions.probe_files(spark, path)).first()
    assert (entry["n_lines"], entry["n_written"], entry["n_long"], entry["n_bad_key"], entry["transcoded"]) == (10, 6, 1, 1, False)
    assert (entry["cycle"], entry["status"]) == (2016, "converted")
    files = spark.createDataFrame([(entry["source_file"],), ("other",)], "source_file string")
    assert [r[0] for r in audit.not_yet_done(files, spark.createDataFrame([entry])).collect()] == ["other"]


def test_incremental_conversion_converts_each_file_once(spark, tmp_path):
    source, out, ledger, state = (str(tmp_path / p) for p in ("src", "out", "ledger", "state"))
    run = lambda: convert_new_files(spark, source, out, ledger, state, COLUMNS)
    _write(f"{source}/txn_2016.csv", DIRTY)
    run()
    assert read_converted(spark, out, COLUMNS).count() == 6
    run()
    back = read_converted(spark, out, COLUMNS)
    assert back.count() == 6 and back.schema["cycle"].dataType.simpleString() == "bigint"
    _write(f"{source}/txn_2018.csv", HEADER + b"2018,1,1,a,b\n2020,2,1,a,b\n")
    run()
    entries = {r["cycle"]: (r["n_written"], r["n_wrong"], r["status"]) for r in spark.read.parquet(ledger).collect()}
    assert entries == {2016: (6, 0, "converted"), 2018: (2, 1, "wrong_key")}
    assert read_converted(spark, out, COLUMNS).where("cycle = 2018 and row_cycle = 2020").count() == 1


def test_a_batch_that_is_killed_leaves_nothing_and_is_converted_once(spark, tmp_path, monkeypatch):
    from panelweave.session import shared_root
    from panelweave.sources import manifest
    from panelweave.streaming import incremental

    source, out, ledger, state = (str(tmp_path / p) for p in ("src", "out", "ledger", "state"))
    folder = shared_root(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    run = lambda: convert_new_files(spark, source, out, ledger, state, COLUMNS)
    _write(f"{source}/txn_2016.csv", DIRTY)
    run()
    assert set(os.listdir(folder)) == before  # intermediate files are gone
    _write(f"{source}/txn_2018.csv", HEADER + b"2018,1,1,a,b\n")
    told, publish = incremental.ledger_rows, manifest.publish

    def fault(*args, **how):
        raise RuntimeError("killed")

    for module, name, whole in ((incremental, "ledger_rows", told), (manifest, "publish", publish)):  # after the data, and after the ledger
        monkeypatch.setattr(module, name, fault)
        with pytest.raises(Exception, match="killed"):
            run()
        monkeypatch.setattr(module, name, whole)
        assert read_converted(spark, out, COLUMNS).count() == 6 and set(os.listdir(folder)) == before
        assert {r["cycle"] for r in incremental.read_ledger(spark, out, ledger).collect()} == {2016}

    def late(session, *args, **how):
        publish(session, *args, **how)
        raise RuntimeError("killed after publishing")

    monkeypatch.setattr(manifest, "publish", late)
    with pytest.raises(Exception, match="killed after"):
        run()
    monkeypatch.setattr(manifest, "publish", publish)
    run()  # the batch is replayed, and known
    assert read_converted(spark, out, COLUMNS).count() == 7
    assert {r["cycle"] for r in incremental.read_ledger(spark, out, ledger).collect()} == {2016, 2018}
    live = manifest.current(spark, out)["parts"]
    assert [p for p in os.listdir(out) if p.startswith("part=")] and len(live) == 2
    manifest.sweep(spark, out)
    assert sorted(p for p in os.listdir(out) if p.startswith("part=")) == sorted(live)


def test_small_parts_are_compacted(spark, tmp_path):
    from panelweave.sources import manifest
    from panelweave.streaming.incremental import compact_converted

    source, out, ledger, state = (str(tmp_path / p) for p in ("src", "out", "ledger", "state"))
    for year in (2016, 2018, 2020):
        _write(f"{source}/txn_{year}.csv", HEADER + b"".join(b"%d,%d,1,a,b\n" % (year, i) for i in range(9)))
        convert_new_files(spark, source, out, ledger, state, COLUMNS)
    old = read_converted(spark, out, COLUMNS)
    want = sorted(map(str, old.collect()))
    assert compact_converted(spark, out, COLUMNS) == 3 and compact_converted(spark, out, COLUMNS) == 0
    back = read_converted(spark, out, COLUMNS)
    assert sorted(map(str, back.collect())) == want == sorted(map(str, old.collect()))  # a reader that started before goes on
    assert back.select(F.col("_metadata.file_path")).distinct().count() == 3
    _write(f"{source}/txn_2022.csv", HEADER + b"2022,1,1,a,b\n")
    convert_new_files(spark, source, out, ledger, state, COLUMNS)
    assert read_converted(spark, out, COLUMNS).count() == 28 and len(manifest.current(spark, out)["parts"]) == 2
    with pytest.raises(RuntimeError, match="not live"):
        manifest.publish(spark, out, [], ["part=unknown"])


def test_incremental_conversion_of_odd_files(spark, tmp_path):
    source, out, ledger, state = (str(tmp_path / p) for p in ("src", "out", "ledger", "state"))
    _write(f"{source}/txn_2016.csv", HEADER + "2016,1,1,Müller,Köln\n".encode("latin-1"))
    _write(f"{source}/txn_2018.csv", HEADER + "2018,2,1,Müller,Köln\n".encode())
    _write(f"{source}/txn_2020.csv", HEADER + b"bad,3,1,a,b\n")
    _write(f"{source}/txn_2022.csv", HEADER)
    _write(f"{source}/txn_2026.csv", HEADER + b"2026,4,1,a,b\n")
    convert_new_files(spark, source, out, ledger, state, COLUMNS)
    rows = read_converted(spark, out, COLUMNS).collect()
    assert {(r["cycle"], r["employer"], r["city"]) for r in rows} == {(2016, "Müller", "Köln"), (2018, "Müller", "Köln")}
    entries = {os.path.basename(r["source_file"]): r for r in spark.read.parquet(ledger).collect()}
    assert {k: (r["status"], r["n_written"], r["n_bad_key"], r["transcoded"]) for k, r in entries.items()} == {
        "txn_2016.csv": ("converted", 1, 0, True), "txn_2018.csv": ("converted", 1, 0, False), "txn_2020.csv": ("empty", 0, 1, False),
        "txn_2022.csv": ("empty", 0, 0, False), "txn_2026.csv": ("failed", 0, 0, False),
    }
    other = [str(tmp_path / p) for p in ("out2", "ledger2", "state2")]
    convert_new_files(spark, source, *other, COLUMNS, high=2030)
    assert read_converted(spark, other[0], COLUMNS).where("cycle = 2026").count() == 1


@pytest.mark.parametrize(
    "line,employer,city",
    [
        (b"2016,1,1,ACME\\,Boston\n", "ACME\\", "Boston"), (b'2016,1,1,"ACME\\",Boston\\\n', "ACME\\", "Boston"),
        (b'2016,1,1,a,"Boston\\"\n', "a", "Boston\\"), (b'2016,1,1,"two\\\n\\\nlines\\x",b\n', "two\n\nlines\\x", "b"),
        (b"2016,1,1,a,b\\\\\n", "a", "b\\"), (b"2016,1,1,a\\\n", "a", None), (b"2016,1,1,,\n", "", ""),
    ],
)
def test_backslashes(spark, tmp_path, line, employer, city):
    _write(str(tmp_path / "txn_2016.csv"), HEADER + line)
    row = transactions.read_dirty_csv(spark, str(tmp_path), COLUMNS).first()
    assert (row["employer"], row["city"]) == (employer, city)


def test_files_without_a_header(spark, tmp_path):
    _write(str(tmp_path / "txn_2016.csv"), b"2016,1,1,a,b\n2016,2,1,a,b\n")
    assert transactions.read_files(spark, str(tmp_path), COLUMNS, header=False).count() == 2


def test_written_survives_in_the_shared_folder(spark):
    df = written(spark.range(5), "t")
    assert df.count() == 5 and "FileScan parquet" in df._jdf.queryExecution().toString()


def test_files_per_key_bounds_the_files(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(2000).repartition(8).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"))
    transactions.write_partitioned(df, path, "k", files_per_key=2)
    back = spark.read.parquet(path)
    files = back.groupBy("k").agg(F.countDistinct(F.col("_metadata.file_path")).alias("n"))
    assert back.count() == 2000 and files.agg(F.max("n")).first()[0] <= 2


def test_publish_writes_panel_and_people(spark, tmp_path):
    from panelweave.plans import study

    inputs = study.inputs_from_tables(spark, "/root/testdata/sf0.001")
    stored = study.publish(study.enriched_panel(**inputs), str(tmp_path))
    people = spark.read.parquet(str(tmp_path / "processed_people"))
    assert stored.count() > 0 and people.count() == stored.select("cid").distinct().count()
    assert registers.read_processed(spark, str(tmp_path / "processed_panel")).count() == stored.count()


def test_the_whole_job_removes_its_intermediate_files(spark, tmp_path):
    from panelweave.plans import study
    from panelweave.session import shared_root

    folder = shared_root(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    stored = study.run(str(tmp_path), **study.inputs_from_tables(spark, "/root/testdata/sf0.001"))
    assert stored.count() > 0
    assert set(os.listdir(folder)) == before
