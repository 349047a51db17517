"""Run registry queries in Spark and their DuckDB twins; compare rows, columns and values.

Usage: ``python tests/compare.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = [
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
][0].split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if os.environ.get("COMPARE_EXACT") else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if str(type(v)).endswith("Timestamp'>"):
        return v.to_pydatetime().isoformat(sep=" ")
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def spark_type_sql(t) -> str:
    """The DuckDB name of a Spark type, for the schema check."""
    from pyspark.sql import types as T

    simple = {
        T.LongType: "BIGINT",
        T.IntegerType: "INTEGER",
        T.DoubleType: "DOUBLE",
        T.StringType: "VARCHAR",
        T.DateType: "DATE",
        T.TimestampNTZType: "TIMESTAMP",
        T.BooleanType: "BOOLEAN",
    }
    for k, v in simple.items():
        if isinstance(t, k):
            return v
    if isinstance(t, T.DecimalType):
        return f"DECIMAL({t.precision},{t.scale})"
    return t.simpleString().upper()


def compare(spark, name: str, sf_dir: str, con) -> tuple[bool, str]:
    from __spark_entry__ import oracle_sql, queries

    t0 = time.time()
    sdf = queries()[name](spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    s_cols = sdf.columns
    t1 = time.time()
    sql = oracle_sql().get(name)
    if sql is None:
        return True, f"{name}: spark rows={len(s_rows)} (no oracle) {t1 - t0:.2f}s"
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"{name}: columns differ spark={s_cols} duck={d_cols}"
    s_types = {f.name: spark_type_sql(f.dataType) for f in sdf.schema.fields}
    d_types = {d[0]: str(d[1]) for d in res.description}
    bad_types = {c: (s_types[c], d_types[c]) for c in s_types if s_types[c] != d_types[c].upper()}
    if bad_types:
        return False, f"{name}: types differ {bad_types}"
    a = rows_of(s_cols, s_rows)
    b = rows_of(d_cols, d_rows)
    if len(a) != len(b):
        return False, f"{name}: rows spark={len(a)} duck={len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{name}: {len(bad)} value diffs, first spark={bad[0][0]} duck={bad[0][1]}"
    return True, f"{name}: ok rows={len(a)} spark {t1 - t0:.2f}s"


def main() -> int:
    from trailscope.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("COMPARE_TZ"):  # results must not depend on the session time zone
        spark.conf.set("spark.sql.session.timeZone", os.environ["COMPARE_TZ"])
    for item in filter(None, os.environ.get("COMPARE_CONF", "").split(",")):  # e.g. other session settings
        key, value = item.split("=", 1)
        spark.conf.set(key, value)
    if not spark.conf.get("spark.checkpoint.dir", None):
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ts-ckpt-", dir="/tmp"))
    from __spark_entry__ import queries

    con = duck(sf_dir)
    failed = 0
    for name in names or list(queries()):
        try:
            ok, msg = compare(spark, name, sf_dir, con)
        except Exception as e:  # report and continue
            ok, msg = False, f"{name}: ERROR {type(e).__name__}: {str(e)[:400]}"
        failed += not ok
        print(("PASS " if ok else "FAIL ") + msg, flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
