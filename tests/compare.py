"""Compare registered queries with their DuckDB oracle: python -m tests.compare [--sf 0.01] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
ROOT = "/root/testdata/sf"


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if hasattr(value, "asDict"):
        return tuple(_plain(v) for v in value.asDict().values())
    if isinstance(value, dict):
        return tuple(_plain(v) for v in value.values())
    return value


def difference(spark, query, sql: str, folder: str) -> tuple[str, int]:
    """Empty text when both sides hold the same multiset of rows, and the row count."""
    frame = query(spark, folder)
    mine = [tuple(_plain(row[c]) for c in sorted(frame.columns)) for row in frame.collect()]
    result = oracle_connection(folder).execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}", len(mine)
    at = [names.index(c) for c in sorted(names)]
    theirs = [tuple(_plain(row[i]) for i in at) for row in result.fetchall()]
    left, right = Counter(map(repr, mine)), Counter(map(repr, theirs))
    if left == right:
        return "", len(mine)
    only_mine, only_theirs = left - right, right - left
    return (
        f"{len(mine)} rows against {len(theirs)}; columns {sorted(names)}\n"
        f"  spark only {sum(only_mine.values())}: {sorted(only_mine)[:3]}\n"
        f"  oracle only {sum(only_theirs.values())}: {sorted(only_theirs)[:3]}"
    ), len(mine)


def main(arguments: list[str]) -> int:
    import __spark_entry__ as entry
    from witnessframe.session import local_session

    scale = "0.01"
    if "--sf" in arguments:
        at = arguments.index("--sf")
        scale = arguments[at + 1]
        del arguments[at : at + 2]
    spark = local_session()
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not arguments or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in arguments)]
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                text, rows = difference(spark, queries[name], oracles[name], ROOT + scale)
            else:
                rows = queries[name](spark, ROOT + scale).count()
                text = "" if rows else "no rows"
        except Exception as error:  # noqa: BLE001
            text, rows = f"{type(error).__name__}: {str(error)[:700]}", -1
        bad += bool(text)
        print(f"{'FAIL' if text else 'ok':4} {name:36} {rows:8} rows {time.time() - start:6.1f}s {'' if name in oracles else '(rows only)'} {text}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
