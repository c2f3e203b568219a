"""Run registered queries and their SQL side by side: python tests/compare.py [sf] [name ...]."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def check_engine(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime | datetime.date):
        return value.isoformat()
    return repr(value)


def normalised(columns, rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple(str(v) for v in r))


def differences(spark, con, sf_dir: str, fn, sql: str) -> str | None:
    """None when columns, rows and values agree, else the first difference."""
    df = fn(spark, sf_dir)
    mine = normalised(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    theirs = normalised(names, cursor.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} against {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows against {len(theirs[1])}; e.g. {set(mine[1]) ^ set(theirs[1]) and sorted(set(mine[1]) ^ set(theirs[1]), key=str)[:2]}"
    bad = [(a, b) for a, b in zip(*[mine[1], theirs[1]], strict=True) if a != b]
    return f"{len(bad)} rows differ: {mine[0]} {bad[0][0]} against {bad[0][1]}" if bad else None


def main() -> int:
    from panelweave.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    import __spark_entry__ as contract

    queries, checks = contract.queries(), contract.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark, con = local_session("8"), check_engine(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            if name in checks:
                found = differences(spark, con, sf_dir, queries[name], checks[name])
            else:
                found = None if queries[name](spark, sf_dir).count() else "no rows"
        except Exception as error:  # report and go on to the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        failed += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {time.time() - start:6.1f}s {name} {'' if name in checks else '(rows only) '}{found or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main())
