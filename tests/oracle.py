"""Compare queries with their SQL: python -m tests.oracle [NAME...] (all graph queries without names)."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def expected(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    c = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if p.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    frame = c.execute(sql)
    names = [x[0] for x in frame.description]
    return names, frame.fetchall()


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    return x


def difference(spark: SparkSession, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows, else what differs first."""
    got = query(spark, sf_dir)
    names, rows = expected(sql, sf_dir)
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    mine = [tuple(_plain(r[c]) for c in names) for r in got.collect()]
    theirs = [tuple(_plain(x) for x in r) for r in rows]
    if len(mine) != len(theirs):
        return f"{len(mine)} rows and {len(theirs)}"
    key = lambda r: tuple(map(str, r))
    for a, b in zip(sorted(mine, key=key), sorted(theirs, key=key), strict=True):
        if a != b:
            return f"{a} and {b}"
    return "" if mine else "no rows on either side"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sql = e.oracle_sql()
    for name in sys.argv[2:] or sql:
        began = time.time()
        try:
            said = difference(spark, e.queries()[name], sql[name], f"/root/testdata/{sys.argv[1]}")
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:400]}"
        print(f"{name}: {said[:600] or 'equal'} ({time.time() - began:.1f} s)", flush=True)
