"""Run registered queries beside their DuckDB statements.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "\\N"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        tuple(canon(r[i]) for i in order) for r in rows
    )


def compare(spark, sf_dir, query, sql):
    t = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    types = dict(df.dtypes)
    if sql is None:
        return True, took, len(got[1]), "rows only"
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    duck = dict(zip(rel.columns, [str(x) for x in rel.types]))
    if got[0] != want[0]:
        return False, took, len(got[1]), f"columns {got[0]} vs {want[0]}"
    names = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    odd = {c: (types[c], duck[c]) for c in types if names.get(types[c]) != duck[c]}
    if got[1] != want[1]:
        have, need = set(got[1]), set(want[1])
        only, miss = sorted(have - need)[:3], sorted(need - have)[:3]
        return False, took, len(got[1]), f"{len(got[1])} vs {len(want[1])} rows\n {got[0]}\n only spark {only}\n only duck {miss}"
    return True, took, len(got[1]), f"types {odd}" if odd else ""


def main(argv):
    import __spark_entry__ as entry

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(entry.queries())
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for n in names:
        try:
            ok, took, rows, note = compare(spark, sf, entry.queries()[n], entry.oracle_sql().get(n))
        except Exception as e:  # report and go on to the next query
            ok, took, rows, note = False, 0, 0, repr(e)[:1500]
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {n:32s} {took:6.2f}s {rows:8d} rows {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
