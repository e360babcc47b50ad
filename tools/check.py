"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

usage: python tools/check.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from tablekit.plans.catalog import ORACLES, QUERIES  # noqa: E402
from tablekit.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return str(v)


def rows(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in records), [names[i] for i in order]


def compare(spark, con, name, folder):
    start = time.time()
    df = QUERIES[name](spark, folder)
    got, got_names = rows(df.collect(), df.columns)
    took = time.time() - start
    if name not in ORACLES:
        return f"rows   {len(got)}", took, df.dtypes, None
    rel = con.execute(ORACLES[name])
    types = [(d[0], str(d[1])) for d in rel.description]
    want, want_names = rows(rel.fetchall(), [d[0] for d in rel.description])
    if got_names != want_names:
        return f"NAMES  {got_names} != {want_names}", took, df.dtypes, types
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w][:3]
        return f"DIFF   {len(got)} vs {len(want)}: {str(diff)[:1500]}", took, df.dtypes, types
    return f"ok     {len(got)}", took, df.dtypes, types


def main():
    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name in QUERIES:
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            verdict, took, a, b = compare(spark, con, name, folder)
        except Exception as e:  # report and go on
            verdict, took, a, b = "ERROR  " + str(e)[:900], 0, "", ""
            if "-v" in args:
                traceback.print_exc()
        flag = verdict.startswith(("ok", "rows"))
        bad += not flag
        print(f"{name:32s} {took:6.2f}s {verdict}", flush=True)
        if not flag or "-t" in args:
            print("     ", a, "\n     ", b)
        spark.catalog.clearCache()
    print("failed:", bad)


if __name__ == "__main__":
    main()
