"""Run registered queries against their SQL twins: `python tests/compare.py [sf] [name ...]`."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(norm(row[i]) for i in order) for row in rows), key=lambda t: tuple("" if x is None else x for x in t)
    )


def compare(spark, con, name, fn, sql, sf_dir):
    started = time.time()
    df = fn(spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    if sql is None:
        return None, f"{len(got[1])} rows", took
    rel = con.execute(sql)
    want = table([d[0] for d in rel.description], rel.fetchall())
    if got == want:
        return True, f"{len(got[1])} rows", took
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}", took
    diff = [(g, w) for g, w in zip(got[1], want[1]) if g != w][:2]
    return False, f"rows {len(got[1])} vs {len(want[1])}; {diff}", took


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tickloom.session import local

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local(8, 8)
    con = duck(sf_dir)
    wanted = sys.argv[2:]
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, note, took = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as error:  # report and go on
            ok, note, took = False, f"{type(error).__name__}: {str(error)[:600]}", 0.0
        bad += ok is False
        print(f"{'OK  ' if ok else '----' if ok is None else 'FAIL'} {name:28s} {took:6.2f}s  {note if not ok else note}", flush=True)
    print("failures:", bad)
