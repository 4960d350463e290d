"""Compare every registered query with its SQL: python tests/check_oracle.py SF_DIR [names...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_plain(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    ours = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(ours), None
    con = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    same = sorted(columns) == sorted(df.columns) and ours == theirs
    if not same:
        missing = [r for r in theirs if r not in ours][:3] if len(theirs) < 20000 else "?"
        extra = [r for r in ours if r not in theirs][:3] if len(ours) < 20000 else "?"
        print("   ", sorted(columns), sorted(df.columns), len(theirs), len(ours), missing, extra)
    return len(ours), same


def session(cpus: int = 8) -> SparkSession:
    return (SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.sql.session.timeZone", "UTC").getOrCreate())


if __name__ == "__main__":
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, *names = sys.argv[1:]
    for query in names or entry.queries():
        start = time.time()
        try:
            n, verdict = compare(spark, sf_dir, query)
        except Exception as error:
            n, verdict = -1, str(error)[:1500]
        print(f"{query:28s} {n:8d} {time.time() - start:6.2f}s  {verdict}", flush=True)
