"""Run queries against their SQL on DuckDB: python tools/check.py SF_DIR [key ...]"""
from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from pulsegrid.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(v)
    return str(v)


def sort_key(row):
    return tuple((x is not None, str(type(x)), round(x, 4) if isinstance(x, float) else x) for x in row)


def compare(a_cols, a_rows, b_cols, b_rows):
    if sorted(a_cols) != sorted(b_cols):
        return f"columns differ: {sorted(a_cols)} / {sorted(b_cols)}"
    order = sorted(a_cols)
    pick = lambda cols, rows: [tuple(norm(r[cols.index(c)]) for c in order) for r in rows]
    a, b = pick(a_cols, a_rows), pick(b_cols, b_rows)
    if len(a) != len(b):
        return f"rows differ: spark {len(a)} oracle {len(b)}"
    if sorted(map(str, a)) == sorted(map(str, b)):
        return None
    a.sort(key=sort_key), b.sort(key=sort_key)
    bad = 0
    first = None
    for x, y in zip(a, b):
        same = all((p == q) or (isinstance(p, float) and isinstance(q, float) and
                                abs(p - q) <= 1.5e-6 + 1e-9 * abs(q)) for p, q in zip(x, y))
        if not same:
            bad += 1
            first = first or (x, y)
    if bad:
        return f"{bad} of {len(a)} rows differ; columns {order}\n   spark  {first[0]}\n   oracle {first[1]}"
    return "LAST DIGIT: equal only within tolerance"


def main():
    sf, keys = sys.argv[1], sys.argv[2:]
    from pulsegrid.plans import ORACLES, QUERIES
    spark = local_session("check")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    chosen = [k for k in QUERIES if not keys or any(k == x or (x.endswith('*') and k.startswith(x[:-1])) for x in keys)]
    failed = []
    for k in chosen:
        start = time.time()
        try:
            df = QUERIES[k](spark, sf)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            nulls = [c for i, c in enumerate(cols) if rows and all(r[i] is None for r in rows)]
            if k in ORACLES:
                cur = con.execute(ORACLES[k])
                ocols = [d[0] for d in cur.description]
                msg = compare(cols, rows, ocols, cur.fetchall())
            else:
                msg = None
        except Exception as exc:  # report and go on
            took, rows, nulls = time.time() - start, [], []
            msg = "ERROR " + "".join(traceback.format_exception_only(exc))[:1500]
        state = "ok  " if msg is None else "FAIL"
        print(f"{state} {k:32s} {took:6.1f}s rows={len(rows)}{'' if k in ORACLES else ' (no sql)'}"
              f"{' ALLNULL=' + ','.join(nulls) if nulls else ''}", flush=True)
        if msg:
            failed.append(k)
            print("   ", msg, flush=True)
        elif os.environ.get("SHOW") and rows:
            print("   ", dict(zip(cols, rows[0])), flush=True)
    print(f"{len(chosen) - len(failed)} ok, {len(failed)} failed: {failed}")
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
