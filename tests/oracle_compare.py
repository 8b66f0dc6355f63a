"""Run a query on Spark and its SQL twin on DuckDB and compare the rows strictly."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, int):
        return ("i", x)
    if isinstance(x, float):
        return ("f", "nan" if math.isnan(x) else repr(0.0 if x == 0 else x))
    if isinstance(x, decimal.Decimal):
        return ("d", str(x))
    if isinstance(x, (datetime.datetime, datetime.date)):
        return ("t", str(x))
    if isinstance(x, (list, tuple)):
        return tuple(_cell(i) for i in x)
    return str(x)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(spark, folder: str, fn, sql: str) -> tuple[bool, str]:
    df = fn(spark, folder)
    s_cols, s_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(folder).execute(sql)
    d_cols, d_rows = rows_of([d[0] for d in cur.description], cur.fetchall())
    if s_cols != d_cols:
        return False, f"columns {s_cols} != {d_cols}"
    if len(s_rows) != len(d_rows):
        only_s = [r for r in s_rows if r not in set(d_rows)][:2]
        only_d = [r for r in d_rows if r not in set(s_rows)][:2]
        return False, f"rows {len(s_rows)} != {len(d_rows)}; spark-only {only_s}; duck-only {only_d}"
    if s_rows != d_rows:
        ds, ss = set(d_rows), set(s_rows)
        only_s = [r for r in s_rows if r not in ds]
        only_d = [r for r in d_rows if r not in ss]
        return False, f"{len(only_s)} rows differ\n   spark {only_s[:2]}\n   duck  {only_d[:2]}"
    return True, f"{len(s_rows)} rows"


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from questloom.session import local_session

    folder = argv[0]
    want = argv[1:]
    spark = local_session(8)
    qs, os_ = e.queries(), e.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if want and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in want):
            continue
        t0 = time.time()
        try:
            if name in os_:
                ok, note = compare(spark, folder, fn, os_[name])
            else:
                ok, note = True, f"rows only: {fn(spark, folder).count()} rows"
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        if not ok:
            bad += 1
        print(("ok  " if ok else "BAD ") + f"{name} {time.time() - t0:.1f}s {note}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
