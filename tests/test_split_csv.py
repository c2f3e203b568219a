"""One file read by many tasks gives the rows that one task gives."""

import random

import pytest
from pyspark.sql import functions as F

from panelweave.sources import split_csv, transactions

COLUMNS = ("cycle", "txn_id", "amount", "employer", "city")
HEADER = b"cycle,txn_id,amount,employer,city\n"
FIELDS = [
    b"a", b"", b"\\N", b'"two\\\nlines"', b'"x, y"', b'"The ""Big"", Co"', b"back\\slash", b'"one\n\n\ntwo ""q""\n"', b'""', b'"a""\n""b"',
    b'"tail\\"', b"end\\", b'"ab"cd', b"M\xc3\xbcller", b'"\n"', b" b ", b'"z" ',
]


def _file(seed, n, ending=b"\n"):
    rng = random.Random(seed)
    lines = []
    for i in range(n):
        width = rng.choice([5, 5, 5, 5, 5, 3, 7])
        lines.append(b",".join([b"2016", str(i).encode(), b"1.5", *(rng.choice(FIELDS) for _ in range(width - 3))][:width]))
    return HEADER + ending.join(lines) + (ending if seed % 2 else b"")


def _rows(df):
    return sorted(tuple(r) for r in df.select(*[F.coalesce(c, F.lit("NULL")) for c in (*COLUMNS, "row_state")]).collect())


@pytest.fixture
def small_blocks(spark):
    for key, value in (("spark.sql.files.maxPartitionBytes", "997"), ("spark.sql.files.openCostInBytes", "1")):
        spark.conf.set(key, value)
    yield
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


def test_a_quote_inside_an_unquoted_field_opens_nothing(spark, tmp_path, small_blocks):
    lines = [b'2016,%d,1,6" pipe,"a, ""b""\nc"' % i if i % 3 else b'2016,%d,1,6" pipe,7" x,"y",z' % i for i in range(200)]
    (tmp_path / "a.csv").write_bytes(HEADER + b"\n".join(lines))
    rows = transactions.read_files(spark, str(tmp_path), COLUMNS).collect()
    assert sorted(int(r["txn_id"]) for r in rows) == list(range(200))
    assert {(r["employer"], r["city"], r["row_state"]) for r in rows} == {('6" pipe', 'a, "b"\nc', "ok"), ('6" pipe', '7" x', "long")}


@pytest.mark.parametrize("seed", range(4))
def test_blocks_give_the_rows_of_one_task(spark, tmp_path, small_blocks, seed):
    for k in range(2):
        (tmp_path / f"txn_20{10 + k}.csv").write_bytes(_file(seed + 10 * k, 400))
    survey = transactions.survey_files(spark, str(tmp_path))
    assert survey.count() > 15 and survey.filter("inside").count() > 0
    got = transactions.read_files(spark, str(tmp_path), COLUMNS, survey=survey)
    assert _rows(got) == _rows(transactions.read_dirty_csv(spark, str(tmp_path), COLUMNS))
    probed = {r["source_file"]: tuple(r) for r in transactions.probe_files(spark, str(tmp_path)).collect()}
    assert {r["source_file"]: tuple(r) for r in transactions.file_totals(survey).collect()} == probed


def test_a_record_over_many_blocks_and_one_never_closed(spark, tmp_path, small_blocks):
    long = b'2016,1,1,"' + b"line, \"\"x\"\"\n" * 900 + b'",Bonn\n2016,2,1,a,b\n'
    (tmp_path / "a.csv").write_bytes(HEADER + long + b'2016,3,1,"never closed\n2016,4,1,c,d\n' + b"2016,5,1,e,f\n" * 300)
    got = {r["txn_id"]: r for r in transactions.read_files(spark, str(tmp_path), COLUMNS).collect()}
    assert got["1"]["employer"] == 'line, "x"\n' * 900 and got["1"]["city"] == "Bonn" and got["1"]["row_state"] == "ok"
    assert got["2"]["city"] == "b"
    assert set(got) == {"1", "2", "3"} and got["3"]["employer"].startswith("never closed\n2016,4") and got["3"]["row_state"] == "short"


def test_encodings_line_ends_and_empty_lines(spark, tmp_path, small_blocks):
    (tmp_path / "u.csv").write_bytes(HEADER + "2016,1,1,Müller,Köln\n\n".encode() * 90)
    (tmp_path / "l.csv").write_bytes(HEADER + "2016,2,1,Müller,Köln\n".encode("latin-1") * 90)
    (tmp_path / "r.csv").write_bytes((HEADER + b'2016,3,1,"a\nb",K\n' * 90).replace(b"\n", b"\r\n"))
    (tmp_path / "e.csv").write_bytes(b"")
    (tmp_path / "h.csv").write_bytes(HEADER)
    rows = transactions.read_files(spark, str(tmp_path), COLUMNS).groupBy("txn_id", "employer", "city").count().collect()
    assert sorted(map(tuple, rows)) == [("1", "Müller", "Köln", 90), ("2", "Müller", "Köln", 90), ("3", "a\nb", "K", 90)]


def test_too_many_blocks_are_read_a_file_per_task(spark, tmp_path, small_blocks, monkeypatch):
    (tmp_path / "txn_2016.csv").write_bytes(_file(1, 200))
    want = _rows(transactions.read_files(spark, str(tmp_path), COLUMNS))
    monkeypatch.setattr(transactions, "MOST_BLOCKS", 2)
    assert _rows(transactions.read_files(spark, str(tmp_path), COLUMNS)) == want


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "big.csv").write_bytes(HEADER + b"2016,1,1,some employer of a long name,some city\n" * 700_000)
    rows = transactions.read_files(spark, str(tmp_path), COLUMNS)
    assert rows.rdd.getNumPartitions() >= 7
    assert rows.filter("row_state = 'ok'").count() == 700_000


@pytest.mark.parametrize(
    "line,inside,after,delimiters",
    [
        (b"a,b", False, False, 1), (b'a,"b', False, True, 1), (b'b",c', True, False, 1), (b'""', True, True, 0), (b'"', True, False, 0), (b'a"b,"c', False, True, 1),
        (b'"a"b","c', False, True, 1), (b'"a" ,b', False, False, 1), (b"", True, True, 0), (b'"a""', False, True, 0), (b'"",""', False, False, 1),
    ],
)
def test_states_of_lines(line, inside, after, delimiters):
    assert split_csv.scan_line(line, inside) == (after, delimiters)
