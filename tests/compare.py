"""Runs registered queries next to their SQL oracles and reports differences.

    [SESSION_ZONE=Europe/Paris] python -m tests.compare [scale] [query ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

DATA = Path("/root/testdata")
TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "DATE": "date", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return db


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.isoformat(" ")
    return value


def _sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def differences(df: DataFrame, db: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a DataFrame and the SQL's rows; empty when equal."""
    relation = db.sql(sql)
    expected_types = dict(zip(relation.columns, (str(t) for t in relation.types)))
    problems = []
    if set(df.columns) != set(relation.columns):
        return [f"columns {sorted(df.columns)} != {sorted(relation.columns)}"]
    for name, kind in df.dtypes:
        expected = TYPES.get(expected_types[name], expected_types[name])
        if kind != expected:
            problems.append(f"type of {name}: {kind} != {expected}")
    got = _sorted_rows(df.columns, df.collect())
    want = _sorted_rows(relation.columns, relation.fetchall())
    if len(got) != len(want):
        problems.append(f"{len(got)} rows != {len(want)}")
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        problems.append(f"{len(bad)} rows differ, columns {sorted(df.columns)}")
        problems += [f"  got  {g}\n  want {w}" for g, w in bad[:2]]
    return problems


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tests.conftest import make_session

    scale = argv[0] if argv else "0.01"
    sf_dir = f"{DATA}/sf{scale}"
    spark, db = make_session(), connect(sf_dir)
    spark.conf.set("spark.sql.session.timeZone", os.environ.get("SESSION_ZONE", "UTC"))
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in argv[1:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problems = differences(df, db, oracles[name])
            else:
                problems = [] if df.collect() else ["no rows"]
        except Exception as error:  # go on with the other queries
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(problems)
        mark = "FAIL" if problems else ("ok" if name in oracles else "rows")
        print(f"{mark:5}{time.time() - start:7.2f}s {name}", flush=True)
        for p in problems:
            print("     ", p)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
