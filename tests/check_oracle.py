"""Compare queries with their reference SQL in DuckDB: columns, row count, values.

    python tests/check_oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as app  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
TABLES += ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def difference(spark: SparkSession, db, sf_dir: str, name: str) -> str | None:
    """None when both sides agree, else what differs. Values are compared by
    type and text, so a number must also have the same kind and scale."""
    frame = app.queries()[name](spark, sf_dir)
    reference = db.execute(app.oracle_sql()[name])
    columns = sorted(frame.columns)
    names = [d[0] for d in reference.description]
    if columns != sorted(names):
        return f"columns {columns} != {sorted(names)}"

    def text(value):
        return (type(value).__name__, str(value))

    at = [names.index(c) for c in columns]
    theirs = Counter(tuple(text(row[i]) for i in at) for row in reference.fetchall())
    ours = Counter(tuple(text(row[c]) for c in columns) for row in frame.collect())
    if ours == theirs:
        return None
    only_ours, only_theirs = ours - theirs, theirs - ours
    return (
        f"{sum(ours.values())} rows != {sum(theirs.values())};"
        f" only ours {sum(only_ours.values())}: {next(iter(only_ours), None)};"
        f" only reference {sum(only_theirs.values())}: {next(iter(only_theirs), None)}"
    )


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db, failed = connect(sf_dir), 0
    for name in sys.argv[2:] or app.queries():
        start = time.time()
        try:
            problem = difference(spark, db, sf_dir, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s {name}"
              f"{'' if problem is None else ': ' + problem}", flush=True)  # fmt: skip
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
