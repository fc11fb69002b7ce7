"""python tests/oracle.py SF_DIR [NAME...]: runs queries beside their DuckDB SQL and compares the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    import decimal

    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def frames(rows, names) -> Counter:
    at = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in at) for r in rows)


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        t = os.path.basename(p).removesuffix(".parquet")
        con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def compare(spark, con, folder: str, name: str, query, sql: str | None) -> str:
    t = time.time()
    df = query(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = f"{len(rows)} rows, {time.time() - t:.1f} s"
    if sql is None:
        return f"ran {took}"
    cur = con.execute(sql)
    names, other = [d[0] for d in cur.description], cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"FAIL columns {sorted(set(names) ^ set(df.columns))}"
    a, b = frames(rows, df.columns), frames(other, names)
    if a != b:
        return f"FAIL {took}, oracle {len(other)}: only Spark {list((a - b).items())[:3]}, only SQL {list((b - a).items())[:3]} ({sorted(names)})"
    return f"ok {took}"


def main() -> None:
    import __spark_entry__ as e
    from weftline.session import session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = session("local[8]", {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = duck(folder), e.oracle_sql()
    for name, query in e.queries().items():
        if not wanted or any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            try:
                print(name, compare(spark, con, folder, name, query, sql.get(name)), flush=True)
            except Exception as x:  # noqa: BLE001
                print(name, "ERROR", type(x).__name__, str(x)[:1500], flush=True)


if __name__ == "__main__":
    main()
