"""Hold queries against their SQL: ``python tests/verify.py [SF_DIR] [NAME...]`` (default: all, sf0.01)."""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows_of(frame):
    """Rows as tuples of the columns in order of name, sorted."""
    names = sorted(frame.columns)
    frame = frame[names].astype(object).where(frame[names].notna(), None)
    plain = lambda x: x.item() if hasattr(x, "item") else x
    return names, sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


def compare(spark, con, sf_dir, name):
    got = rows_of(entry.queries()[name](spark, sf_dir).toPandas())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None, len(got[1])
    want = rows_of(con.sql(sql).df())
    if got[0] != want[0] or len(got[1]) != len(want[1]):
        return False, f"{got[0]} {len(got[1])} | {want[0]} {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return not bad, f"{len(got[1])} rows" + (f", {len(bad)} differ, e.g. {bad[0]}" if bad else "")


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(sf_dir)
    for name in args or entry.queries():
        t = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            ok, note = False, repr(e)[:1500]
        print({True: "ok  ", False: "BAD ", None: "rows"}[ok], name, f"{time.time() - t:.1f}s", note, flush=True)
