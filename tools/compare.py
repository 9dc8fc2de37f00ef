"""Run registered queries and their SQL oracles side by side and report differences."""

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir):
    import duckdb

    from awardlake.checks.base import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    def norm(v):
        if isinstance(v, float):
            return 0.0 if v == 0 else v
        return v
    return sorted((repr(tuple(norm(r[i]) for i in order)) for r in rows))


def compare(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return took, len(got), "rows only"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return took, len(got), f"COLUMNS {sorted(df.columns)} != {sorted(names)}"
    if got == want:
        return took, len(got), "ok"
    a, b = set(got), set(want)
    return took, len(got), (
        f"DIFF want {len(want)} rows; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}"
    )


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--prefix", action="append", default=[])
    args = parser.parse_args()
    from awardlake.checks import load

    queries, oracles = load()
    spark, con = session(), duck(args.sf)
    bad = 0
    for name, fn in queries.items():
        if args.names and name not in args.names:
            continue
        try:
            took, n, note = compare(spark, con, name, fn, oracles.get(name), args.sf)
        except Exception as exc:  # report every query, then fail
            took, n, note = 0.0, 0, f"ERROR {type(exc).__name__}: {str(exc)[:1500]}"
        bad += note not in ("ok", "rows only")
        print(f"{name:32s} {took:6.2f}s {n:7d} rows  {note}", flush=True)
    print("failures:", bad)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
