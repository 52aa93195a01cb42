"""Compare registered queries with their SQL twins on DuckDB.

usage: python tests/oracle_check.py [sf] [name-substring ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v)
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str:
    """Empty string when equal, else a short account of the difference."""
    got_cols, got = table(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want_cols, want = table(cols, rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} vs {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    if not got:
        return "both empty"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)}/{len(got)} rows differ, e.g. {bad[0]}" if bad else ""


def main(argv):
    import __spark_entry__ as entry
    from reverbtable.session import build_session

    sf = argv[0] if argv else "0.01"
    want = argv[1:]
    spark = build_session("check", f"local[{__import__('os').environ.get('CPUS', 8)}]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    fails = 0
    for name, fn in queries.items():
        if want and not any(w == name or (w.endswith("*") and w[:-1] in name) for w in want):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracle:
                msg = compare(df, con, oracle[name])
            else:
                n = df.count()
                msg = "" if n else "no rows"
        except Exception as e:  # report and go on
            msg = f"{type(e).__name__}: {str(e)[:1200]}"
        fails += bool(msg)
        tag = "FAIL" if msg else ("ok" if name in oracle else "rows")
        print(f"{tag:5}{name:32}{time.time() - t0:7.2f}s  {msg}", flush=True)
    print(f"{fails} failing of {len(queries)}; oracle for {len(oracle)}")


if __name__ == "__main__":
    main(sys.argv[1:])
