"""Join of visits with every bed allocation admitted on or before the visit.

The result of that join has one row per (visit, allocation) pair and grows with
the square of a patient's history. Everything built on it needs only counts and
sums, so the pairs are never formed: allocations are reduced to running totals
per patient, ward and day, each valid until the ward's next admission, and a
visit day picks the one total in force per ward. The work per patient is bounded
by days and wards, not by visits times allocations.

Days and intervals are joined in time buckets: an interval is repeated for every year
that it covers, and the year joins the key. A patient with a very long history is so
spread over as many tasks as the history has years, and a day is compared with the
intervals of its own year only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written_once
from .skew import left_join_sliced, slices_for

DAY = ["patient_id", "visit_date"]
# Days that one task looks up, where there are more than a few. Adaptive execution would
# merge tasks by compressed bytes, and what is found for a day is many times as large in
# memory.
DAYS_PER_TASK, FEW_DAYS = 100_000, 1_000_000


def lookup_tasks(days: int) -> int | None:
    """Tasks that look up days, so that one has as many whatever the size; Spark plans no
    fewer than its shuffle partitions. None for few days, which it shares out itself."""
    return -(-days // DAYS_PER_TASK) if days > FEW_DAYS else None


def stay_intervals(bed_allocation: DataFrame, split: Sequence[str] = ("ward_id",)) -> DataFrame:
    """Running stay totals per patient and ``split``, with their validity.

    ``valid_to`` is exclusive and NULL for the latest interval. ``stay_days`` is
    NULL while no stay with a known length has been seen.
    """
    key = ["patient_id", *split]
    daily = bed_allocation.groupBy(*key, "admit_date").agg(
        F.count("*").alias("n"),
        F.count("days_stayed").alias("known"),
        F.sum(F.col("days_stayed").cast("bigint")).alias("days"),
    )
    by_day = Window.partitionBy(*key).orderBy("admit_date")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.select(
        *key,
        F.col("admit_date").alias("valid_from"),
        F.lead("admit_date").over(by_day).alias("valid_to"),
        F.sum("n").over(so_far).alias("stays"),
        F.sum("known").over(so_far).alias("known_stays"),
        F.sum("days").over(so_far).alias("stay_days"),
    )


def stays_by_day(
    days: DataFrame,
    bed_allocation: DataFrame,
    split: Sequence[str] = ("ward_id",),
    tasks: int | None = None,
) -> DataFrame:
    """Totals in force for each row of ``days`` (patient, visit date and more),
    one row per ward with a stay. With ``tasks`` both sides meet in that many."""
    end = days.agg(F.max("visit_date").alias("end")).scalar()
    last = F.least(F.coalesce(F.date_sub("valid_to", 1), end), end)
    intervals = (
        stay_intervals(bed_allocation, split)
        .withColumnRenamed("patient_id", "_patient")
        .withColumn("_last", last)
        .filter(F.col("valid_from") <= F.col("_last"))
        .withColumn("_bucket", F.explode(F.sequence(F.year("valid_from"), F.year("_last"))))
    )
    if tasks:
        days = days.repartition(tasks, "patient_id", F.year("visit_date"))
        intervals = intervals.repartition(tasks, "_patient", "_bucket")
    in_force = (
        (F.col("patient_id") == F.col("_patient"))
        & (F.year("visit_date") == F.col("_bucket"))
        & F.col("visit_date").between(F.col("valid_from"), F.col("_last"))
    )
    return days.join(intervals, in_force).select(
        *days.columns, *split, "stays", "known_stays", "stay_days"
    )


def _days(visits: DataFrame) -> DataFrame:
    """Days to look up, with the slices that each one's visits are spread over."""
    counted = visits.groupBy(*DAY).agg(F.count("*").alias("_visits"))
    days = counted.select(*DAY, slices_for(F.col("_visits")).alias("slices"))
    return written_once(days, "days")


def visit_stays(
    rows: DataFrame,
    bed_allocation: DataFrame,
    split: Sequence[str] = ("ward_id",),
    visits: DataFrame | None = None,
) -> DataFrame:
    """Left join of visits with their stays, compact: a row stands for
    ``copies`` joined rows. A visit without a stay keeps one row, ward NULL.

    ``rows`` may hold a visit several times, with other columns; ``visits`` is then the
    table that they come from, which is cheaper to count. Visits are first counted per patient and day. That gives the days to look
    up, far fewer than visits for a busy patient, and tells which of them are so
    crowded that their visits are spread over several tasks.
    """
    days = _days(rows if visits is None else visits)
    tasks = lookup_tasks(days.count())
    totals = stays_by_day(days, bed_allocation, split, tasks)
    return (
        left_join_sliced(rows, totals, days, DAY, spread="visit_id", tasks=tasks)
        .withColumn("copies", F.coalesce("stays", F.lit(1).cast("bigint")))
        .drop("stays")
    )


def visit_stay_lists(rows: DataFrame, bed_allocation: DataFrame, visits: DataFrame) -> DataFrame:
    """``rows`` with their stays as the list ``stay_list``, an entry per ward; NULL without
    a stay. As ``visit_stays``, but a row stays one row. The lists are made where the days
    were looked up, which is by patient and year."""
    days = _days(visits)
    tasks = lookup_tasks(days.count())
    totals = stays_by_day(days, bed_allocation, tasks=tasks)
    entry = F.struct("ward_id", "stays", "known_stays", "stay_days")
    lists = (
        totals.groupBy("patient_id", F.year("visit_date").alias("_year"), "visit_date", "slices")
        .agg(F.collect_list(entry).alias("stay_list"))
        .drop("_year")
    )
    return left_join_sliced(rows, lists, days, DAY, spread="visit_id", tasks=tasks)


def expand_copies(df: DataFrame) -> DataFrame:
    """Write a compact row ``copies`` times: the joined rows themselves."""
    return df.withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    ).drop("_copy", "copies")
