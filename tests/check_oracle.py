"""Compare registered queries with their SQL on DuckDB. Usage: check_oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, float):
        return 0 if v == 0 else (int(v) if v.is_integer() and abs(v) < 1e15 else v)
    if hasattr(v, "isoformat"):
        return str(v)[:19].replace(" 00:00:00", "")
    return v


def kind(v):
    """A nullable whole number arrives as a float on the Spark side, so whole floats count as int."""
    if v is None:
        return None
    return "int" if isinstance(v, float) and v.is_integer() else type(v).__name__


def rows(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    obj = pdf[cols].astype(object)
    out = [tuple(norm(v) for v in r) for r in obj.itertuples(index=False, name=None)]
    return cols, sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def close(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def compare(s: pd.DataFrame, d: pd.DataFrame):
    cs, rs = rows(s)
    cd, rd = rows(d)
    if cs != cd:
        return f"columns {cs} vs {cd}"
    if len(rs) != len(rd):
        return f"rows {len(rs)} vs {len(rd)}"
    if rs == rd:
        bad = [c for i, c in enumerate(cs) if {kind(r[i]) for r in rs} != {kind(r[i]) for r in rd}]
        return f"kinds differ in {bad}" if bad else None
    n = sum(a != b for a, b in zip(rs, rd))
    near = sum(not all(close(x, y) for x, y in zip(a, b)) for a, b in zip(rs, rd))
    i = next(i for i, (a, b) in enumerate(zip(rs, rd)) if a != b)
    return f"{n} rows differ ({near} beyond 1e-9) of {len(rs)} {cs}\n   spark {rs[i]}\n   duck  {rd[i]}"


def main():
    from __spark_entry__ import oracle_sql, queries
    from tidemark.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                                  "spark.ui.enabled": "false",
                                                  "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    q, o = queries(), oracle_sql()
    names = [n for n in q if not pats or any(n.startswith(p) for p in pats)]
    bad = 0
    for n in names:
        try:
            t = time.time()
            print(f"... {n}", file=sys.stderr, flush=True)
            s = q[n](spark, sf).toPandas()
            ts = time.time() - t
            if n not in o:
                print(f"ROWS {n} {len(s)} rows {ts:.1f}s", flush=True)
                continue
            t = time.time()
            d = con.execute(o[n]).df()
            msg = compare(s, d)
            if msg is None and len(s) == 0:
                msg = "no rows"
            bad += msg is not None
            print(f"{'OK  ' if msg is None else 'BAD '} {n} {len(s)} rows {ts:.1f}s duck {time.time() - t:.1f}s"
                  + (f"\n   {msg}" if msg else ""), flush=True)
        except Exception as e:  # report and go on
            bad += 1
            print(f"ERR  {n} {type(e).__name__}: {str(e)[:1500]}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
