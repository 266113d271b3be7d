"""Run registered queries next to their SQL in DuckDB: ``python tests/compare.py [sf] [names]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


# Kinds of Spark and DuckDB types that hold the same values.
KINDS = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE",
}


def type_problem(df, cursor) -> str | None:
    theirs = {d[0]: str(d[1]) for d in cursor.description}
    bad = [
        f"{name} is {kind} and {theirs[name]}" for name, kind in df.dtypes
        if kind in KINDS and name in theirs and KINDS[kind] != theirs[name].upper()
    ]
    return "; ".join(bad) or None


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def compare(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None when both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in names) for r in df.collect()), key=_key)
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != names:
        return f"columns {names} and {sorted(columns)}"
    if wrong := type_problem(df, cursor):
        return wrong
    at = [columns.index(c) for c in names]
    theirs = sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=_key)
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    if mine != theirs:
        bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
        close = sum(all(x == y or (isinstance(x, float) and math.isclose(x, y, abs_tol=2e-6)) for x, y in zip(a, b)) for a, b in bad)
        return f"{len(bad)} of {len(mine)} rows differ ({close} within 2e-6): {str(bad[:2])[:600]}"
    if not mine:
        return "no rows"
    return None


def main(sf: str = "0.01", *names: str) -> int:
    import __spark_entry__ as entry
    from conftest import session

    spark, sf_dir = session(), f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    failed = 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            if sql is None:
                problem = None if query(spark, sf_dir).count() else "no rows"
            else:
                problem = compare(spark, con, sf_dir, query, sql)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{name:28s} {time.time() - start:6.1f}s {problem or 'ok'}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
