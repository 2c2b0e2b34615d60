"""Run registered queries and their SQL side by side: python -m checks.compare [folder] [names...]"""

from __future__ import annotations

import sys
import time

import duckdb

from causeway.session import local_session
from checks.oracles import ORACLES
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _rows(rows, names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


def differences(spark, con, name: str, folder: str) -> list[str]:
    """What differs between the query and its SQL; empty if nothing does."""
    df = QUERIES[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    relation = con.sql(ORACLES[name])
    expected = relation.fetchall()
    problems = []
    mine = {f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    theirs = {n: str(t) for n, t in zip(relation.columns, relation.types)}
    if mine != theirs:
        problems.append(f"schema: {sorted(mine.items() ^ theirs.items())}")
    if not got:
        problems.append("no rows")
    if set(mine) == set(theirs):
        a, b = _rows(got, list(mine)), _rows(expected, list(theirs))
        if a != b:
            only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
            problems.append(f"rows: {len(a)} / {len(b)}; spark {only_a[:2]}; sql {only_b[:2]}")
    return problems


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(8), views(folder)
    failed = 0
    for name in names:
        start = time.time()
        if name not in ORACLES:
            print(f"{name}: rows only, {QUERIES[name](spark, folder).count()} rows", flush=True)
            continue
        try:
            problems = differences(spark, con, name, folder)
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(problems)
        print(f"{name}: {'; '.join(problems)[:1500] if problems else 'ok'} ({time.time() - start:.1f}s)", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
