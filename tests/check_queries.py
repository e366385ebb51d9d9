"""Runs the queries next to their SQL in DuckDB and prints what differs.

python tests/check_queries.py [scale-factor folder] [query ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark_df, con, sql):
    """None when equal, else a description of the difference."""
    got = spark_df.toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    cols = sorted(got.columns)
    got, want = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
    for c in cols:
        a, b = got[c], want[c]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = same.idxmin()
            return f"{(~same).sum()} values differ in {c}, first:\n{got.loc[i].to_dict()}\n{want.loc[i].to_dict()}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from axisloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf), oracle_sql(), 0
    for name, fn in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        begin = time.time()
        try:
            df = fn(spark, sf)
            note = compare(df, con, sql[name]) if name in sql else f"no SQL, {df.count()} rows"
        except Exception as e:
            note = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += note is not None and not note.startswith("no SQL")
        print(f"{name:28s} {time.time() - begin:6.2f}s  {note or 'equal'}", flush=True)
    print("different:", bad)
