"""Run registered queries next to their SQL and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _key(row):
    return tuple((v is None, "" if v is None else ("nan" if isinstance(v, float) and math.isnan(v) else str(v))) for v in row)


_FAMILY = {"tinyint": "int", "smallint": "int", "integer": "int", "int": "int", "bigint": "bigint", "double": "double", "varchar": "string", "string": "string"}


def compare(spark, con, name, fn, sql, sf) -> tuple[str | None, float]:
    """None when equal, else what differs; and the seconds Spark took."""
    started = time.time()
    df = fn(spark, sf)
    result = df.collect()
    spent = time.time() - started
    columns = sorted(df.columns)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]).lower() for d in rel.description}
    if sorted(names) != columns:
        return (f"columns {columns} against {sorted(names)}"), spent
    kinds = dict(df.dtypes)
    off = [(c, kinds[c], types[c]) for c in columns if _FAMILY.get(kinds[c], kinds[c]) != _FAMILY.get(types[c], types[c])]
    if off:
        return (f"types {off}"), spent
    want = sorted(([row[names.index(c)] for c in columns] for row in rel.fetchall()), key=_key)
    have = sorted(([row[c] for c in columns] for row in result), key=_key)
    if len(want) != len(have):
        return (f"{len(have)} rows against {len(want)}"), spent
    bad = [(a, b) for a, b in zip(have, want) if _key(a) != _key(b)]
    return (f"{len(bad)} of {len(want)} rows differ, first {bad[0]}" if bad else None), spent


def main() -> int:
    from counterpoise.plans.catalog import QUERIES, SQL
    from counterpoise.session import local_session

    sf = sys.argv[1]
    chosen = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = 0
    for name in chosen:
        started = time.time()
        try:
            if name in SQL:
                problem, spent = compare(spark, con, name, QUERIES[name], SQL[name], sf)
            else:
                rows = len(QUERIES[name](spark, sf).collect())
                problem, spent = None if rows else "no rows", time.time() - started
        except Exception as error:  # noqa: BLE001
            spent = 0.0
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {spent:.1f}s of {time.time() - started:.1f}s {problem or ''}", flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} ok")
    return failed


if __name__ == "__main__":
    sys.exit(main())
