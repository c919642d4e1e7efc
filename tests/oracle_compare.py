"""Run registered queries against their DuckDB oracle (as the driver does):
row count, column names and an order-insensitive value comparison."""

from __future__ import annotations

import math
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(records, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


def compare(spark, name, fn, sql, sf_dir):
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    con = duck(sf_dir)
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={sorted(s_cols)} duck={sorted(d_cols)}")
        return problems
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    a, b = rows_of(s_rows, s_cols), rows_of(d_rows, d_cols)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        problems.append(f"values differ, e.g. {diff}")
    return problems


if __name__ == "__main__":
    import __spark_entry__ as E
    from riskrank.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_session("local[8]", shuffle_partitions=8)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or sorted(qs):
        if name not in os_:
            try:
                n = qs[name](spark, sf).count()
                print(f"ROWS  {name}: {n} rows (no oracle)")
            except Exception as e:  # noqa: BLE001
                bad += 1
                print(f"ERROR {name}: {type(e).__name__}: {str(e)[:500]}")
            continue
        try:
            p = compare(spark, name, qs[name], os_[name], sf)
        except Exception as e:  # noqa: BLE001
            p = [f"{type(e).__name__}: {str(e)[:800]}"]
        bad += bool(p)
        print(("OK    " if not p else "FAIL  ") + name + ("" if not p else ": " + " | ".join(p)))
    print(f"{bad} problems")
