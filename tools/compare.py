"""Run registered queries beside their SQL and compare rows.

usage: python tools/compare.py [--sf DIR] [--cores N] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from askwell import plans  # noqa: E402
from askwell.session import build_session  # noqa: E402


def plain(value: object) -> object:
    """Comparable form: rounded floats, lists for arrays, dicts for rows."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def check(spark, con, name: str, sf: str) -> tuple[str, float]:
    start = time.time()
    df = plans.QUERIES[name](spark, sf)
    got = df.collect() if con is not None else df.toArrow().to_batches()
    took = time.time() - start
    if con is None or name not in plans.ORACLES:
        return f"rows only ({len(got)})", took
    cursor = con.execute(plans.ORACLES[name])
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"MISMATCH columns {sorted(df.columns)} {sorted(names)}", took
    want = rows_of(names, cursor.fetchall())
    have = rows_of(df.columns, got)
    if have == want:
        return f"equal ({len(have)})", took
    detail = [f"MISMATCH spark {len(have)} sql {len(want)} rows; columns {sorted(names)}"]
    only_have, only_want = [r for r in have if r not in set(want)], [r for r in want if r not in set(have)]
    detail += [f"   spark {str(r)[:600]}" for r in only_have[:3]] + [f"   sql   {str(r)[:600]}" for r in only_want[:3]]
    detail.append(f"   {len(only_have)} only in spark, {len(only_want)} only in sql")
    return "\n".join(detail), took


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--cores", default="8")
    parser.add_argument("--time-only", action="store_true")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("compare", args.cores)
    con = None if args.time_only else connect(args.sf)
    bad = 0
    for name in plans.QUERIES:
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        try:
            verdict, took = check(spark, con, name, args.sf)
        except Exception as error:
            verdict, took = f"MISMATCH error {str(error)[:1200]}", 0.0
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += verdict.startswith("MISMATCH")
        print(f"{name:32s} {took:6.1f}s  {verdict}", flush=True)
    print(f"{bad} mismatches")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
