"""Refresh of the warehouse and access to its tables.

A warehouse folder holds

    load=<id>/<dimension>, load=<id>/report/<name>   tables of one load
    fact_load/load_id=<id>/load_status=.../year_num=...   fact partitions that a load wrote
    loads                                            the log, one row per finished load

A log row lists the fact partitions of its load, each with the load that wrote it, so a
load that changes a few years (``plans.changes``) names the others where they are.
Readers see a load only by its row in the log. The row also holds what was counted
while the load was written: rows of each dimension, rows and cases of each fact
partition; counts of a load are answered from there without reading its tables.

Old loads are removed in two steps: ``expire`` first marks them in a log of its own,
and removes their folders only when the mark is older than a grace period, so that
readers which opened such a load can finish.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import as_date, date_key
from ..functions.numbers import or_zero
from ..schemas import FACT_COLUMNS, FACT_LOAD
from ..sources.storage import open_partitions, read_dimension, remove_folder, shuffles_removed
from . import dims, fact

PART_COLUMNS = "load_id: STRING, load_status: STRING, year_num: INT, fact_rows: BIGINT, cases: BIGINT"
PART = f"STRUCT<{PART_COLUMNS}>"
LOADS_SCHEMA = (
    f"load_id STRING, finished_at TIMESTAMP, parts ARRAY<{PART}>, table_rows MAP<STRING, BIGINT>"
)
EXPIRED_SCHEMA = "load_id STRING, marked_at TIMESTAMP"
# Files of one load that a task writes at a time: loaded and skipped groups of 16 years.
OPEN_PARTITIONS = 32
EXTRACT = ("visit", "diagnosis", "outcome", "bed_allocation", "treatment", "medicine")
Tables = Callable[[str], DataFrame]
Part = tuple[str, str, int, int, int]
Reports = dict[str, Callable[["Warehouse"], DataFrame]]


@dataclass
class Warehouse:
    """Tables of one load. ``parts``: load, status, year, rows and cases of its fact
    partitions, of which there are two for each year of the calendar at most.
    ``table_rows``: rows of each dimension."""

    spark: SparkSession
    base: str
    load_id: str
    parts: Sequence[Part] = ()
    table_rows: dict[str, int] = field(default_factory=dict)

    @property
    def root(self) -> str:
        """Folder of the load's own tables."""
        return f"{self.base}/load={self.load_id}"

    def dimension(self, name: str) -> DataFrame:
        return read_dimension(self.spark, self.root, name)

    @property
    def load_rows(self) -> DataFrame:
        """All groups of the load with natural and surrogate keys; skipped
        groups carry their reason."""
        return self._stored_rows().drop("load_id")

    def _stored_rows(self) -> DataFrame:
        if not self.parts:
            return self.spark.createDataFrame([], f"{FACT_LOAD}, load_id STRING")
        base = f"{self.base}/fact_load"
        folders = [f"{base}/load_id={p[0]}/load_status={p[1]}/year_num={p[2]}" for p in self.parts]
        rows = self.spark.read.schema(f"{FACT_LOAD}, load_id STRING").option("basePath", base)
        return rows.parquet(*folders)

    def partitions(self) -> DataFrame:
        """Fact partitions with their rows, and whether this load wrote them or took
        them over, as the load log has them."""
        return self._logged_parts().select(
            "load_status", "year_num", (F.col("load_id") == self.load_id).alias("rewritten"), "fact_rows"
        )

    def _logged_parts(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.parts), PART_COLUMNS.replace(":", ""))

    def counters(self) -> DataFrame:
        """Extracted rows, groups, loaded and skipped groups of the load, from the log."""
        rows, status = F.col("fact_rows"), F.col("load_status")
        sums = {
            "extracted_rows": F.col("cases"),
            "transformed_groups": rows,
            "loaded_groups": F.when(status == "loaded", rows),
            "skipped_groups": F.when(status == "skipped", rows),
        }
        return self._logged_parts().agg(
            *[F.coalesce(F.sum(value), F.lit(0)).alias(name) for name, value in sums.items()]
        )

    def row_counts(self) -> DataFrame:
        """Rows of the load's tables, from the log."""
        fact_rows = sum(part[3] for part in self.parts if part[1] == "loaded")
        counted = {**self.table_rows, "fact_treatment": fact_rows}
        return self.spark.createDataFrame(list(counted.items()), "table_name STRING, row_count BIGINT")

    @property
    def skipped(self) -> DataFrame:
        return self.load_rows.filter(F.col("load_status") == "skipped")

    @property
    def fact(self) -> DataFrame:
        """The treatment fact. ``year_num`` is its partition column."""
        return (
            self.load_rows.filter(F.col("load_status") == "loaded")
            .withColumn("outcome_sk", F.lit(None).cast("int"))
            .select(*FACT_COLUMNS, "year_num")
        )

    def fact_between(
        self, date_from: str | dt.date | None = None, date_to: str | dt.date | None = None
    ) -> DataFrame:
        """Fact joined with its dates inside an optional closed window.

        A bound applies to the calendar date; as the date key grows with the
        date it is also put on the fact's key and partition, which prunes years
        and reaches the file scan.
        """
        rows, dates = self.fact, self.dimension("dim_date")
        dates = dates.select("date_id", "full_date", "year_num", "month_num")
        first, last = as_date(date_from), as_date(date_to)
        if first is not None:
            dates = dates.filter(F.col("full_date") >= F.lit(first))
            rows = rows.filter((F.col("year_num") >= first.year) & (F.col("date_id") >= date_key(first)))
        if last is not None:
            dates = dates.filter(F.col("full_date") <= F.lit(last))
            rows = rows.filter((F.col("year_num") <= last.year) & (F.col("date_id") <= date_key(last)))
        return rows.drop("year_num").join(dates, "date_id")

    def store_report(self, name: str, report: DataFrame) -> None:
        """Keep a full-history report beside the load, so that page summaries
        read a small table and not the fact."""
        with shuffles_removed(self.spark):
            report.write.mode("overwrite").parquet(f"{self.root}/report/{name}")

    def report(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/report/{name}")


def write_dimensions(
    spark: SparkSession,
    base: str,
    load_id: str,
    table: Tables,
    calendar_from: str | dt.date,
    calendar_to: str | dt.date,
    previous: Warehouse | None,
) -> Warehouse:
    """Dimensions of a new load. Keys carry over from ``previous``."""

    def before(name: str) -> DataFrame | None:
        return previous.dimension(name) if previous else None

    built = {
        "dim_date": dims.dim_date(spark, calendar_from, calendar_to),
        "dim_disease": dims.dim_disease(table("disease"), before("dim_disease")),
        "dim_doctor": dims.dim_doctor(table("doctor"), before("dim_doctor")),
        "dim_ward": dims.dim_ward(table("ward"), before("dim_ward")),
        "dim_outcome": dims.dim_outcome(spark),
    }
    done = Warehouse(spark, base, load_id)
    for name, df in built.items():
        seen = Observation(name)
        with shuffles_removed(spark):
            df.observe(seen, F.count("*").alias("rows")).write.parquet(f"{done.root}/{name}")
        done.table_rows[name] = seen.get["rows"]
    return done


def keyed_groups(groups: DataFrame, wh: Warehouse) -> DataFrame:
    """Fact groups with the surrogate keys of a load's dimensions, or why they have none."""
    names = ("dim_date", "dim_disease", "dim_doctor", "dim_ward")
    return fact.with_surrogates(groups, *[wh.dimension(name) for name in names])


def write_fact(groups: DataFrame, wh: Warehouse) -> list[Part]:
    """Write groups as the load's own partitions and return these; they come in order of
    the day and are not sorted again by partition. What the write
    itself counted must be what is found in the folder; else the load is not finished."""
    folder = f"{wh.base}/fact_load/load_id={wh.load_id}"
    seen, totals = Observation("fact"), {"rows": F.count("*"), "cases": or_zero(F.sum("total_cases"))}
    with open_partitions(wh.spark, OPEN_PARTITIONS), shuffles_removed(wh.spark):
        (
            keyed_groups(groups, wh)
            .withColumns(
                {
                    "load_status": F.when(F.col("skip_reason").isNull(), "loaded").otherwise("skipped"),
                    "year_num": F.year("visit_date"),
                }
            )
            .withColumn("fact_id", fact.grain_key())
            .observe(seen, *[total.alias(name) for name, total in totals.items()])
            .write.partitionBy("load_status", "year_num")
            .parquet(folder)
        )
    written = wh.spark.read.schema(FACT_LOAD).parquet(folder)
    sums = [total.alias(name) for name, total in totals.items()]
    found = written.groupBy("load_status", "year_num").agg(*sums).collect()
    parts = [(wh.load_id, r["load_status"], r["year_num"], r["rows"], r["cases"]) for r in found]
    kept = {"rows": sum(p[3] for p in parts), "cases": sum(p[4] for p in parts)}
    if seen.get != kept:
        raise RuntimeError(f"load {wh.load_id} wrote {seen.get} and keeps {kept}")
    return parts


def publish(wh: Warehouse, stored_reports: Reports | None = None) -> Warehouse:
    """Compute the reports to keep and put the load in the log."""
    for name, build in (stored_reports or {}).items():
        wh.store_report(name, build(wh))
    now = wh.spark.range(1).select(F.current_timestamp()).first()[0]
    entry = (wh.load_id, now, [tuple(p) for p in wh.parts], wh.table_rows)
    row = wh.spark.createDataFrame([entry], LOADS_SCHEMA)
    row.coalesce(1).write.mode("append").parquet(f"{wh.base}/loads")
    return wh


def refresh(
    spark: SparkSession,
    root: str,
    table: Tables,
    calendar_from: str | dt.date,
    calendar_to: str | dt.date,
    stored_reports: Reports | None = None,
) -> Warehouse:
    """Load a new version of the warehouse beside the old one and publish it.

    ``table`` returns an operational table by name. Everything is written below
    folders of its own; readers see the load only when its row is in the load
    log, so there is no moment with an empty fact. Dimension keys carry over
    from the last load, which makes a rerun give the same tables. Reports named
    in ``stored_reports`` are computed and kept with the load.
    """
    previous, load_id = latest(spark, root), uuid.uuid4().hex
    wh = write_dimensions(spark, root, load_id, table, calendar_from, calendar_to, previous)
    tables = [table(name) for name in EXTRACT]
    wh.parts = write_fact(fact.treatment_groups(*tables, wh.dimension("dim_doctor")), wh)
    return publish(wh, stored_reports)


def _logged(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of a log; none before the first is written."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _opened(spark: SparkSession, root: str, row: Row) -> Warehouse:
    return Warehouse(spark, root, row.load_id, [tuple(p) for p in row.parts], dict(row.table_rows or {}))


def latest(spark: SparkSession, root: str) -> Warehouse | None:
    """The last published load, or None before the first."""
    loads = _logged(spark, f"{root}/loads", LOADS_SCHEMA)
    last = F.max_by(F.struct("load_id", "parts", "table_rows"), "finished_at")
    newest = loads.agg(last).first()[0]
    return _opened(spark, root, newest) if newest else None


def expire(spark: SparkSession, root: str, keep: int = 2, grace: timedelta = timedelta(days=1)) -> list[str]:
    """Mark all but the last ``keep`` loads as expired, and remove the folders of those
    marked longer than ``grace`` ago. Fact partitions that a later load took over stay as
    long as any load that is not removed names them. Returns the loads removed now; a
    run that was broken off is finished by the next one."""
    if keep < 1:
        raise ValueError("the last load must be kept")
    loads = _logged(spark, f"{root}/loads", LOADS_SCHEMA).orderBy(F.col("finished_at").desc()).collect()
    marks = _logged(spark, f"{root}/expired", EXPIRED_SCHEMA).groupBy("load_id").agg(F.min("marked_at").alias("at"))
    marked = {r.load_id: r["at"] for r in marks.collect()}
    now = spark.range(1).select(F.current_timestamp()).first()[0]
    fresh = [(row.load_id, now) for row in loads[keep:] if row.load_id not in marked]
    if fresh:
        spark.createDataFrame(fresh, EXPIRED_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/expired")
    marked.update(fresh)
    old = {load for load, at in marked.items() if at + grace <= now}
    needed = {tuple(part)[:3] for row in loads if row.load_id not in old for part in row.parts}
    removed = []
    for row in loads:
        if row.load_id in old:
            own = [tuple(p)[:3] for p in row.parts if p.load_id == row.load_id]
            gone = [p for p in own if p not in needed]
            folders = [f"fact_load/load_id={p[0]}/load_status={p[1]}/year_num={p[2]}" for p in gone]
            if len(gone) == len(own):
                folders = [f"fact_load/load_id={row.load_id}"]
            found = [remove_folder(spark, f"{root}/{f}") for f in [f"load={row.load_id}", *folders]]
            removed += [row.load_id] if any(found) else []
    return removed
