"""Compare a job with its SQL on the same tables: columns by name, rows as multisets."""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from collections import Counter

import duckdb

from grantlens.session import TABLES


def duck(base: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{base}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_norm(r[i]) for i in order) for r in cur.fetchall())


def check(spark, con, base, entry):
    t0 = time.time()
    cols, got = rows_of_spark(entry.run(spark, base))
    t1 = time.time()
    if entry.sql is None:
        return True, f"rows-only {sum(got.values())} rows, {t1 - t0:.1f}s"
    want_cols, want = rows_of_duck(con, entry.sql)
    t2 = time.time()
    if cols != want_cols:
        return False, f"columns {cols} != {want_cols}"
    if got != want:
        extra, missing = list((got - want).items()), list((want - got).items())
        return False, f"{sum(got.values())} vs {sum(want.values())} rows; only spark {len(extra)} {extra[:3]}; only sql {len(missing)} {missing[:3]}"
    return True, f"{sum(got.values())} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"


def main(argv):
    from grantlens.plans import all_jobs
    from grantlens.session import build_session

    base = argv[0]
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(base)
    bad = 0
    for name, e in all_jobs().items():
        if argv[1:] and not any(a in name for a in argv[1:]):
            continue
        try:
            ok, text = check(spark, con, base, e)
        except Exception as err:  # noqa: BLE001 - report and go on
            ok, text = False, f"{type(err).__name__}: {str(err)[:900]}"
        bad += not ok
        print("OK  " if ok else "FAIL", name, text, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
