"""Compare registered queries with their SQL on DuckDB: ``python tools/check.py [-s SF] [name-prefix ...]``."""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from partwise.plans import load_all  # noqa: E402
from partwise.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5f}".replace("-0.00000", "0.00000")
    if isinstance(v, int):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "is_finite"):
        return f"{float(v):.5f}"
    return str(v)


def table_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("-s", default="0.01")
    ap.add_argument("-v", action="store_true")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    d = f"/root/testdata/sf{a.s}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    bad = []
    for name, q in load_all().items():
        if a.names and not any(name.startswith(p) for p in a.names):
            continue
        t0 = time.time()
        try:
            df = q.run(spark, d)
            types = dict(df.dtypes)
            rows = [tuple(r) for r in df.collect()]
            t1 = time.time() - t0
            if q.sql is None:
                print(f"ROWS {name} {len(rows)} {t1:.1f}s", flush=True)
                continue
            t0 = time.time()
            cur = con.execute(q.sql)
            cols = [c[0] for c in cur.description]
            kinds = {c[0]: str(c[1]) for c in cur.description}
            want = cur.fetchall()
            t2 = time.time() - t0
            c1, r1 = table_of(df.columns, rows)
            c2, r2 = table_of(cols, want)
            if c1 != c2:
                raise AssertionError(f"columns {c1} != {c2}")
            if r1 != r2:
                only1 = [x for x in r1 if x not in set(r2)][:3]
                only2 = [x for x in r2 if x not in set(r1)][:3]
                raise AssertionError(f"{c1} rows {len(r1)} vs {len(r2)}\n  spark {only1}\n  duck  {only2}")
            odd = [(c, types[c], kinds[c]) for c in cols if "DECIMAL" in kinds[c] or "HUGE" in kinds[c]
                   or (types[c] == "bigint") != (kinds[c] == "BIGINT") or (types[c] == "double") != (kinds[c] == "DOUBLE")
                   or (types[c] == "int") != (kinds[c] == "INTEGER")]
            print(f"ok   {name} {len(r1)} rows {t1:.1f}s duck {t2:.1f}s{'' if len(r1) else ' EMPTY'} {odd or ''}", flush=True)
        except Exception as e:
            bad.append(name)
            msg = str(e) if not a.v else traceback.format_exc()
            print(f"FAIL {name}: {msg[:1800]}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
