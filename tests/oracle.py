"""Run registered queries beside their SQL and compare the results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return db


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~null"
    if isinstance(value, float):
        return repr(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return f"{type(value).__name__}:{value}"


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(spark, db, run, sql: str, folder: str) -> str | None:
    """None when both sides agree."""
    frame = run(spark, folder)
    mine = _rows(frame.columns, [tuple(row) for row in frame.collect()])
    cursor = db.execute(sql)
    names = [item[0] for item in cursor.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns differ: {sorted(frame.columns)} / {sorted(names)}"
    theirs = _rows(names, cursor.fetchall())
    if mine == theirs:
        return None
    lost, extra = sorted(set(theirs) - set(mine))[:2], sorted(set(mine) - set(theirs))[:2]
    return f"{len(mine)} / {len(theirs)} rows; columns {sorted(names)}; only SQL {lost}; only Spark {extra}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession
    from recohort.suite import ORACLES, QUERIES

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    database, failed = connect(folder), 0
    for name, run in QUERIES.items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            if name in ORACLES:
                problem = difference(spark, database, run, ORACLES[name], folder)
            else:
                problem = None if run(spark, folder).count() >= 0 else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - began:.1f}s {problem or ''}", flush=True)
    print("failed", failed, "of", len(QUERIES))
