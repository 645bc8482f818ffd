"""Run every query and its SQL side by side: python tests/oracle_check.py [sf_dir] [name...]"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from typeharvest.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
          " conversations").split()


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    def norm(v):
        return round(float(v), 6) if isinstance(v, (float, int)) and not isinstance(v, bool) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, sf_dir):
    df = entry.queries()[name](spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = _rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} != {names}"
    if got != want:
        miss = [r for r in want if r not in set(got)][:3]
        extra = [r for r in got if r not in set(want)][:3]
        return f"{len(got)} rows, want {len(want)}; missing {miss}; extra {extra}"
    return None


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in sys.argv[2:] or entry.queries():
        t = time.time()
        try:
            problem = compare(spark, con, name, sf)
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:400]}"
        bad += problem is not None
        print(f"{name:36s} {time.time() - t:6.1f}s {'ok' if problem is None else problem[:900]}", flush=True)
    print("failed:", bad)
