"""Run registered queries next to their SQL twins and compare the rows.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def oracle_connection(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return "0.0" if value == 0 else repr(value)
    return f"{type(value).__name__}:{value}"


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(row[i]) for i in order) for row in rows)


def compare(con, df, sql: str) -> str:
    """'' when both sides agree, else what differs."""
    got_columns, got = df.columns, [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    want_columns, want = [d[0] for d in cursor.description], cursor.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    a, b = bag(got_columns, got), bag(want_columns, want)
    if a == b:
        return "" if got else "both empty"
    extra, lacking = list((a - b).items())[:2], list((b - a).items())[:2]
    return f"rows {len(got)} vs {len(want)}; only spark {extra}; only sql {lacking}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from rentloom.session import build_session

    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = oracle_connection(opts.sf), 0
    fns, sqls = queries(), oracle_sql()
    for name in [n for n in fns if not opts.names or any(n.startswith(p) for p in opts.names)]:
        start = time.time()
        try:
            df = fns[name](spark, opts.sf)
            outcome = compare(con, df, sqls[name]) if name in sqls else f"rows {len(df.collect())}"
            ok = outcome == "" or name not in sqls
        except Exception as error:  # noqa: BLE001 - the report goes on with the next query
            outcome, ok = f"{type(error).__name__}: {str(error)[:900]}", False
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {outcome}", flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
