"""Run registered queries on Spark and their oracles on DuckDB, and compare whole results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(float(value))
    if hasattr(value, "as_tuple"):
        return repr(float(value))
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    kinds = [type(next((r[i] for r in data if r[i] is not None), None)).__name__ for i in order]
    return [columns[i] for i in order], kinds, sorted(tuple(normal(r[i]) for i in order) for r in data)


def compare(spark, con, sf_dir, fn, sql, inspect=None):
    """Empty string when equal, else what differs; ``inspect`` sees the planned result first."""
    out = fn(spark, sf_dir)
    if inspect:
        inspect(out)
    left = rows(out.columns, [tuple(r) for r in out.collect()])
    cursor = con.execute(sql)
    right = rows([d[0] for d in cursor.description], cursor.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[2]) != len(right[2]):
        return f"rows {len(left[2])} != {len(right[2])}; spark {left[2][:2]} duck {right[2][:2]}"
    if left[2] != right[2]:
        bad = [(a, b) for a, b in zip(left[2], right[2]) if a != b]
        only = sorted(set(left[2]) - set(right[2]))[:3], sorted(set(right[2]) - set(left[2]))[:3]
        return f"{len(bad)} rows differ: spark {only[0]} duck {only[1]}"
    if left[1] != right[1]:
        return f"types {left[1]} != {right[1]}"
    if not left[2]:
        print("empty result", fn.__module__, left[0], flush=True)
    return ""


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from tallyframe.session import build_session, drop_staged

    sf = sys.argv[1]
    prefix = sys.argv[2:]
    spark = build_session(master="local[8]", conf={"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if prefix and not any(name.startswith(p) for p in prefix):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, sf, fn, sqls[name])
            else:
                problem = "" if fn(spark, sf).count() > 0 else "no rows"
                name += " (rows only)"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        drop_staged(spark)
        if problem or time.time() - start > 6:
            print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print("failed", failed, "of", len(entry.queries()), "with oracle", len(sqls))
