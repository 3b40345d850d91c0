"""Run registered queries against their SQL twins in DuckDB."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master(f"local[{cpus}]").appName("seriesforge")
         .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


def duck(sf: str):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(x):
    if x is None:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else x
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(norm(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, norm(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return tuple(norm(v) for v in x)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [tuple(norm(r[i]) for i in order) for r in rows]


def compare(spark, con, sf, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    dt = time.time() - t0
    if sql is None:
        return ("ROWS" if got else "EMPTY"), len(got), dt, sorted(zip(df.columns, [f.dataType.simpleString() for f in df.schema.fields]))
    t1 = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    odd = [(d[0], str(d[1])) for d in cur.description if str(d[1]).startswith(("HUGEINT", "DECIMAL", "NUMBER"))]
    want = rows_of(cols, cur.fetchall())
    dq = time.time() - t1
    if sorted(cols) != sorted(df.columns):
        return "COLUMNS", len(got), dt, (sorted(df.columns), sorted(cols))
    key = lambda r: tuple((v is not None, str(type(v)), str(v)) for v in r)
    g, w = sorted(got, key=key), sorted(want, key=key)
    if g == w:
        return ("TYPES" if odd else "OK" if g else "EMPTY"), len(g), dt, odd or f"{dq:.1f}"
    gs, ws = set(g), set(w)
    return "DIFF", (len(g), len(w)), dt, (sorted(df.columns), list(gs - ws)[:3], list(ws - gs)[:3], len(gs - ws), len(ws - gs))


def main(argv):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("sf"):
        sf = "/root/testdata/" + argv.pop(0)
    qs, os_ = E.queries(), E.oracle_sql()
    names = [n for n in qs if not argv or any(n == a or n.startswith(a) for a in argv)]
    spark, con = session(), duck(sf)
    bad, total = 0, 0.0
    for n in names:
        try:
            st, k, dt, info = compare(spark, con, sf, n, qs[n], os_.get(n))
        except Exception as exc:  # report and go on
            st, k, dt, info = "ERROR", 0, 0.0, str(exc)[:1500]
        total += dt
        if st in ("OK", "ROWS"):
            print(f"{st:5} {n} {k} {dt:.2f}s {info if st == 'OK' else ''}", flush=True)
        else:
            bad += 1
            print(f"{st:5} {n} {k} {dt:.2f}s {str(info)[:1800]}", flush=True)
    print(f"{len(names)} queries, {bad} bad, {total:.1f}s", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
