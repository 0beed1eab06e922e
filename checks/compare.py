"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows.

    python -m checks.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

from checks.oracle import oracle_queries
from sourcegauge.plans.registered import REGISTERED
from sourcegauge.session import local_session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(value: object) -> object:
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder: str, name: str, sql: str) -> list[str]:
    """Differences between both sides, empty when equal."""
    df = REGISTERED[name](spark, folder)
    left = rows_of(df.columns, df.collect())
    con.execute(sql)
    columns = [d[0] for d in con.description]
    right = rows_of(columns, con.fetchall())
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(set(columns) ^ set(df.columns))}"]
    if len(left) != len(right):
        return [f"{len(left)} rows in Spark, {len(right)} in SQL", f"spark {left[:1]}", f"sql {right[:1]}"]
    names = sorted(columns)
    out = []
    for a, b in zip(left, right):
        out += [f"{names[i]}: spark {x!r} sql {y!r} in {a[:3]}" for i, (x, y) in enumerate(zip(a, b)) if x != y]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for d in con.description:
        kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        if kinds.get(types[d[0]], str(d[1])) != str(d[1]):
            out.append(f"type of {d[0]}: spark {types[d[0]]} sql {d[1]}")
    return out


def main() -> int:
    folder, wanted = sys.argv[1], sys.argv[2:]
    spark, con, sqls = local_session(8), database(folder), oracle_queries()
    failed = 0
    for name in wanted or REGISTERED:
        if name not in sqls:
            print(f"{name:34s} no SQL")
            continue
        start = time.time()
        try:
            found = compare(spark, con, folder, name, sqls[name])
        except Exception as error:  # noqa: BLE001 - report and go on
            found = [f"{type(error).__name__}: {str(error)[:500]}"]
        failed += bool(found)
        print(f"{name:34s} {'ok' if not found else 'DIFFERENT'} {time.time() - start:6.2f}s", flush=True)
        for line in found[:6]:
            print("    " + line[:400], flush=True)
    print(f"{failed} different")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
