"""Compare registered queries with their SQL, value by value.

    python tests/oracle.py SF_DIR [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["documents", "embeddings", "benchmark", "labels", "pages", "conversations"]
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "tinyint": "TINYINT",
}


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("uttermill-check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else format(v + 0.0, ".12g")
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    got_rows = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    kinds = {d[0]: str(d[1]) for d in res.description}
    want_rows = res.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    wrong = {c: (t, kinds[c]) for c, t in df.dtypes if TYPES.get(t, t) != kinds[c]}
    if wrong:
        return f"types {wrong}"
    if len(got_rows) != len(want_rows):
        return f"rows {len(got_rows)} != {len(want_rows)}"
    a, b = _rows(df.columns, got_rows), _rows(names, want_rows)
    for x, y in zip(a, b):
        if x != y:
            return f"values {str(x)[:600]} != {str(y)[:600]}"
    return None


def main(sf_dir: str, only: list[str]) -> int:
    import __spark_entry__ as entry
    from uttermill.plans.staging import drop_staged

    spark, con = session(), connect(sf_dir)
    oracle, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            n = df.count() if name not in oracle else None
            spark_time = time.time() - start
            diff = compare(df, con, oracle[name]) if name in oracle else None
            note = diff or ("ok" if name in oracle else f"rows only: {n}")
        except Exception as e:  # keep going: report every query
            diff = note = f"{type(e).__name__}: {str(e)[:1500]}"
            spark_time = time.time() - start
        bad += diff is not None
        drop_staged(spark)
        print(f"{name:24s} build {spark_time:6.1f}s total {time.time() - start:6.1f}s  {note}", flush=True)
    missing = set(oracle) - set(entry.queries())
    print(f"{bad} differ; SQL without query: {sorted(missing)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
