"""Run every query in Spark and its oracle in DuckDB, and compare rows.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value) if not isinstance(value, int) else repr(float(value))


def in_order(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda row: tuple((v is None, str(v)) for v in row))


SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
    "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP",
}


def type_notes(spark_df, con, sql: str) -> list[str]:
    """Columns whose types differ between the two engines."""
    theirs = {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [
        f"{f.name}: {f.dataType.simpleString()} / {theirs.get(f.name)}"
        for f in spark_df.schema.fields
        if SAME_TYPE.get(f.dataType.simpleString()) != theirs.get(f.name)
    ]


def difference(spark_df, con, sql: str) -> str | None:
    """What differs between the two results, or None."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = in_order(names, result.fetchall())
    got = in_order(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if len(got) != len(expected):
        return f"{len(got)} rows, expected {len(expected)}"
    for a, b in zip(got, expected):
        if a != b:
            return f"first difference in {sorted(names)}:\n   got      {a}\n   expected {b}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = make_session()
    con = oracle_connection(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failures = 0
    for name in argv[1:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                rows = "" if problem else "equal " + ", ".join(type_notes(df, con, oracles[name]))
            else:
                problem, rows = None, f"{df.count()} rows, no oracle"
        except Exception as error:  # report and go on with the next query
            problem, rows = f"{type(error).__name__}: {str(error)[:1500]}", ""
        failures += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s {rows}{problem or ''}", flush=True)
    print(f"{failures} failures of {len(argv[1:] or queries)}")
    return failures


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
