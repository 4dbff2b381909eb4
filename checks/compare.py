"""Run registered queries and their SQL side by side: ``python -m checks.compare [sf] [names...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

from checks.oracle import ORACLE
from checks.queries import QUERIES
from gleaner.plans.session import local_session


def views(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if isinstance(value, float) and (math.isnan(value) or value == 0):
        return None if math.isnan(value) else 0.0
    return value


def rows(columns: list[str], data: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(row[i]) for i in order) for row in data), key=repr
    )


def compare(spark, con, sf: str, name: str) -> str | None:
    """Difference between query and SQL, or ``None``."""
    df = QUERIES[name](spark, sf)
    mine = rows(df.columns, df.collect())
    if name not in ORACLE:
        return None if mine[1] else "no rows"
    result = con.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    other = rows(names, result.fetchall())
    if mine[0] != other[0]:
        return f"columns {mine[0]} != {other[0]}"
    spark_types = dict(df.dtypes)
    wide = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}
    odd = [f"{c}: {spark_types[c]} != {types[c]}" for c in names if wide.get(spark_types[c]) != types[c]]
    if len(mine[1]) != len(other[1]):
        return f"{len(mine[1])} rows != {len(other[1])} rows"
    wrong = [(a, b) for a, b in zip(mine[1], other[1]) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(mine[1])} rows differ, first {str(wrong[0])[:600]}"
    if odd:
        return f"types {odd}"
    return None if mine[1] else "no rows"


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con = local_session(8), views(sf)
    spark.sparkContext.setLogLevel("ERROR")
    failed = []
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        kind = "sql" if name in ORACLE else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s {kind} {name}", flush=True)
        if problem:
            failed.append(name)
            print(f"     {problem}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
