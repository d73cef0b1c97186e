"""Run registered queries against their SQL in DuckDB and compare row by row."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v + 0.0, 9) or 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat(" ")
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def duck(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def compare(df, con, sql: str) -> str:
    """'' when equal, else what differs."""
    cols = sorted(df.columns)
    got = sorted([tuple(canon(r[c]) for c in cols) for r in df.collect()], key=repr)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted([tuple(canon(r[i]) for i in at) for r in res.fetchall()], key=repr)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}; first {got[:2]} vs {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, e.g. {bad[0]} ({cols})" if bad else ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tabwise.session import local_session

    sf = sys.argv[1]
    pick = sys.argv[2:]
    spark, con = local_session(), duck(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if pick and not any(name.startswith(p) for p in pick):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            msg = compare(df, con, sqls[name]) if name in sqls else f"(no sql) rows={len(df.collect())}"
        except Exception as e:
            msg = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += bool(msg) and not msg.startswith("(no sql)")
        print(f"{'ok  ' if not msg or msg.startswith('(no') else 'BAD '} {name} {time.time() - t:.1f}s {msg}", flush=True)
    print("bad:", bad)
