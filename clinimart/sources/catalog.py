"""Operational tables in the catalog, bucketed by the key they are joined on.

Tables that meet on the visit are bucketed by it with one number of buckets, so joining
or summing them per visit needs no shuffle; allocations are bucketed by their patient.
Tables with a day are also partitioned by its year, which a date window prunes.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import operational_schema
from .storage import shuffles_removed

# Join key of each bucketed table, and the day that its year column is taken from.
BUCKET_KEYS = {
    "visit": "visit_id",
    "diagnosis": "visit_id",
    "treatment": "visit_id",
    "outcome": "visit_id",
    "bed_allocation": "patient_id",
}
YEAR_OF = {"visit": ("visit_year", "visit_date"), "bed_allocation": ("admit_year", "admit_date")}
# Rows of the largest table that one bucket takes, and the least number of buckets.
ROWS_PER_BUCKET = 500_000
LEAST_BUCKETS = 8


def bucket_count(rows: int) -> int:
    """Buckets for tables of which the largest has ``rows`` rows. All tables that are
    joined with each other get the same number."""
    return max(LEAST_BUCKETS, -(-rows // ROWS_PER_BUCKET))


def write_bucketed(
    df: DataFrame, root: str, database: str, table: str, buckets: int, placed: bool = False
) -> str:
    """Write an operational table below ``root`` and register it; returns its name. One
    task writes a bucket, so there is one file per bucket and year. Rows that are
    ``placed`` were put in ``buckets`` partitions by the table's key before."""
    fields = operational_schema(table).fields
    rows = df.select(*[F.col(f.name).cast(f.dataType) for f in fields])
    key, name = BUCKET_KEYS[table], f"{database}.{table}"
    writer = rows if placed else rows.repartition(buckets, key)
    if table in YEAR_OF:
        year, day = YEAR_OF[table]
        writer = writer.withColumn(year, F.year(day)).write.partitionBy(year)
    else:
        writer = writer.write
    df.sparkSession.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{root}'")
    with shuffles_removed(df.sparkSession):
        writer.bucketBy(buckets, key).sortBy(key).option("path", f"{root}/{table}").saveAsTable(name)
    return name


def read_bucketed(spark: SparkSession, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.table(name)
    return df.select(*columns) if columns else df


def in_window(rows: DataFrame, day: str, first: dt.date, last: dt.date) -> DataFrame:
    """Rows with ``day`` in a closed window. Where the table has a year column for that
    day the window goes to it as well, so only folders of its years are listed and read."""
    years = [year for year, of in YEAR_OF.values() if of == day and year in rows.columns]
    for year in years:
        rows = rows.filter(F.col(year).between(first.year, last.year))
    return rows.filter(F.col(day).between(F.lit(first), F.lit(last)))
