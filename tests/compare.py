"""Run registered queries next to their SQL and report differences: python -m tests.compare [sf_dir] [names…]."""

import math
import sys
import time

import duckdb

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple(map(str, r)))


def difference(spark, con, name, sf_dir):
    df = entry.queries()[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None, len(got)
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = rows(cols, res.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(cols)}", len(got)
    if got == want:
        return "", len(got)
    g, w = set(map(str, got)), set(map(str, want))
    return f"rows {len(got)}/{len(want)}; only spark {sorted(g - w)[:2]}; only sql {sorted(w - g)[:2]}", len(got)


def main():
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in sys.argv[2:] or entry.queries():
        t = time.time()
        try:
            diff, n = difference(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            diff, n = f"{type(e).__name__}: {str(e)[:400]}", -1
        state = "rows-only" if diff is None else "ok" if diff == "" else "BAD"
        bad += state == "BAD"
        print(f"{state:9s} {name:32s} {n:7d} {time.time() - t:6.2f}s {diff or ''}"[:900], flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
