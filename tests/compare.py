"""Run registered queries in Spark and their oracles in DuckDB, and compare.

``python tests/compare.py [--sf 0.01] [prefix ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v) for v in row)


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def compare(spark, con, folder: str, name: str, fn, sql: str | None) -> str | None:
    """None when they agree, else what differs."""
    df = fn(spark, folder)
    rows = [tuple(_plain(v) for v in r) for r in df.collect()]
    if sql is None:
        return None if rows else "no rows"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    for field in df.schema.fields:
        want = _TYPES.get(field.dataType.simpleString())
        if want is None:
            return f"type of {field.name} is {field.dataType.simpleString()}"
        if kinds[field.name] != want:
            return f"type of {field.name}: {want} != {kinds[field.name]}"
    order = sorted(df.columns)
    theirs = [tuple(_plain(r[names.index(c)]) for c in order) for r in result.fetchall()]
    ours = [tuple(r[df.columns.index(c)] for c in order) for r in rows]
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    for a, b in zip(sorted(ours, key=_key), sorted(theirs, key=_key)):
        if a != b:
            return f"{order}\n    spark {a}\n    duck  {b}"
    return None if ours else "agree, but on no rows"


def main() -> int:
    from slimlake.session import local_session
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = "0.01"
    partitions = os.environ.get("COMPARE_PARTITIONS", "8")
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session(8, **{"spark.sql.shuffle.partitions": partitions}), duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if args and not any(name == a or name.startswith(a + "_") for a in args):
            continue
        started = time.monotonic()
        try:
            problem = compare(spark, con, folder, name, fn, oracles.get(name))
        except Exception as error:  # noqa: BLE001 - every failure is listed
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        kind = "=" if name in oracles else "r"
        print(f"{mark} {kind} {time.monotonic() - started:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
