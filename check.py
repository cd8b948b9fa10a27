"""Compare named queries with their SQL oracle: ``python check.py [--sf DIR] [name prefix ...]``."""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback

import duckdb

from astrolake.plans.registry import entries, run_entry
from astrolake.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (0, "nan") if math.isnan(v) else (1, v + 0.0)
    if isinstance(v, bool):
        return (2, v)
    if isinstance(v, int):
        return (1, float(v))
    return (3, str(v))


def compare(cols, got, want) -> str:
    a = sorted((tuple(_norm(v) for v in r) for r in got))
    b = sorted((tuple(_norm(v) for v in r) for r in want))
    if len(a) != len(b):
        sa, sb = set(a), set(b)
        return (f"rows {len(a)} vs {len(b)}; extra {[[x[1] for x in r] for r in list(sa - sb)[:2]]} "
                f"missing {[[x[1] for x in r] for r in list(sb - sa)[:2]]}")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if not bad:
        return ""
    x, y = bad[0]
    diff = [(c, p[1], q[1]) for c, p, q in zip(cols, x, y) if p != q]
    return f"{len(bad)} of {len(a)} rows differ, first {diff[:5]} in {[p[1] for p in x][:6]}"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    con = connect(args.sf)
    spark = build_session(cores="8")
    failures = 0
    for name, e in sorted(entries().items()):
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        cols = list(e.out)
        t0 = time.time()
        try:
            got = [tuple(r) for r in run_entry(e, spark, args.sf).collect()]
            t1 = time.time()
            if e.sql is None:
                msg = "" if got else "no rows"
                tag = "rows-only"
            else:
                msg = compare(cols, got, con.execute(e.sql).fetchall())
                tag = "ok"
        except Exception as ex:  # noqa: BLE001
            t1 = time.time()
            msg = "ERROR " + str(ex).split("JVM stacktrace")[0][:900]
            if "-v" in sys.argv:
                traceback.print_exc()
        if msg:
            failures += 1
            print(f"FAIL {name} {t1 - t0:.1f}s {msg}", flush=True)
        else:
            print(f"{tag} {name} {t1 - t0:.1f}s {len(got)} rows", flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
