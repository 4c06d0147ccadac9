"""Refresh of what changed: from changed operational rows to fact partitions.

A fact group is found by its day and doctor, both columns of the visit, so a changed row
reaches the fact through the visits whose extract it takes part in:

    visit                            itself; its day and doctor before and after
    diagnosis, outcome, treatment    the visit it names
    medicine                         visits with a treatment by it
    bed allocation                   all visits of its patient on or after admission
    disease, doctor, ward, calendar  groups whose key lookup now ends differently

All groups of the touched (day, doctor) pairs are computed anew from their visits, other
groups of the same years are taken over, and the years are written as new partitions.
Years without a touched pair are not read and stay the files they were.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import written_once
from . import fact
from .warehouse import (
    EXTRACT,
    Reports,
    Tables,
    Warehouse,
    keyed_groups,
    latest,
    publish,
    refresh,
    write_dimensions,
    write_fact,
)

# Returns the changed rows of an operational table, each as it was and as it is, or None.
Changed = Callable[[str], DataFrame | None]
PAIR = ["visit_date", "doctor_id"]
MEASURES = [
    "total_cases", "recovered_cases", "readmitted_cases", "avg_recovery_days",
    "avg_treatment_cost", "total_bed_days",
]


def changes_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of two states of a table that differ: deleted rows, inserted rows, and both
    images of updated ones. Copies of a row count each."""
    return before.exceptAll(after).unionByName(after.exceptAll(before))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def touched_visits(table: Tables, changed: Changed) -> DataFrame | None:
    """Day and doctor of visits whose extract a change may alter, or None without a
    change. Changed rows come with few keys, which meet the large tables in semi joins."""
    found = []
    visits = table("visit").select("visit_id", "patient_id", *PAIR)
    if (rows := changed("visit")) is not None:
        found.append(rows.select(*PAIR))
    ids = [rows.select("visit_id") for name in ("diagnosis", "outcome", "treatment") if (rows := changed(name)) is not None]
    if (rows := changed("medicine")) is not None:
        users = table("treatment").select("visit_id", "medicine_id")
        ids.append(users.join(rows.select("medicine_id").distinct(), "medicine_id", "left_semi").select("visit_id"))
    if ids:
        found.append(visits.join(_union(ids).distinct(), "visit_id", "left_semi").select(*PAIR))
    if (rows := changed("bed_allocation")) is not None:
        since = rows.groupBy("patient_id").agg(F.min("admit_date").alias("since"))
        later = visits.join(since, "patient_id").filter(F.col("visit_date") >= F.col("since"))
        found.append(later.select(*PAIR))
    return _union(found).distinct() if found else None


def _differs(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def rekeyed_groups(previous: Warehouse, now: Warehouse) -> DataFrame | None:
    """Day and doctor of stored groups that the new dimensions key differently, or None
    where dimensions and calendar hold the same keys. Known members keep their keys, so
    without a new calendar only groups that lack a key can change."""

    def fresh(name: str, key: str) -> bool:
        old, new = (wh.dimension(name).select(key) for wh in (previous, now))
        return not new.join(old, key, "left_anti").isEmpty()

    def bounds(wh: Warehouse):
        return wh.dimension("dim_date").agg(F.min("date_id"), F.max("date_id")).first()

    moved = bounds(previous) != bounds(now)
    members = [("dim_disease", "disease_code"), ("dim_doctor", "doctor_id"), ("dim_ward", "ward_id")]
    if not moved and not any(fresh(*member) for member in members):
        return None
    rows = previous.load_rows
    if not moved:
        no_ward = F.col("ward_sk").isNull() & F.col("ward_id").isNotNull()
        rows = rows.filter(F.col("skip_reason").isNotNull() | no_ward)
    keys = {"skip_reason": "_reason", "ward_sk": "_ward"}
    rows = rows.select(*fact.GRAIN, *[F.col(k).alias(v) for k, v in keys.items()])
    again = keyed_groups(rows, now)
    return again.filter(_differs("skip_reason", "_reason") | _differs("ward_sk", "_ward")).select(*PAIR).distinct()


def groups_of(table: Tables, pairs: DataFrame) -> DataFrame:
    """Fact groups of the given days and doctors, from their visits alone. The other
    tables are cut to these visits and patients before anything is joined or summed."""
    visits = written_once(table("visit").join(pairs, PAIR, "left_semi"), "touched-visits")
    ids, patients = visits.select("visit_id").distinct(), visits.select("patient_id").distinct()
    cut = {
        "visit": visits,
        "bed_allocation": table("bed_allocation").join(patients, "patient_id", "left_semi"),
        "medicine": table("medicine"),
    }
    for name in ("diagnosis", "outcome", "treatment"):
        cut[name] = table(name).join(ids, "visit_id", "left_semi")
    return fact.treatment_groups(*[cut[name] for name in EXTRACT])


def refresh_changed(
    spark: SparkSession,
    root: str,
    table: Tables,
    changed: Changed,
    calendar_from: str | dt.date,
    calendar_to: str | dt.date,
    stored_reports: Reports | None = None,
) -> Warehouse:
    """Publish a load that differs from the last one only in the years that ``changed``
    reaches; the result is that of a full refresh of ``table``. The first load is a full
    one. ``table`` gives the tables as they are after the changes."""
    previous = latest(spark, root)
    if previous is None:
        return refresh(spark, root, table, calendar_from, calendar_to, stored_reports)
    wh = write_dimensions(
        spark, root, uuid.uuid4().hex, table, calendar_from, calendar_to, previous
    )
    found = [p for p in (touched_visits(table, changed), rekeyed_groups(previous, wh)) if p is not None]
    wh.parts = previous.parts
    if found:
        pairs = written_once(_union(found).distinct(), "touched")
        years = {r[0] for r in pairs.select(F.year("visit_date")).distinct().collect()}
        if years:
            rest = previous.load_rows.filter(F.col("year_num").isin(*years)).join(pairs, PAIR, "left_anti")
            columns = [*fact.GRAIN, *MEASURES]
            groups = rest.select(*columns).unionByName(groups_of(table, pairs).select(*columns))
            kept = [part for part in previous.parts if part[2] not in years]
            wh.parts = kept + write_fact(groups, wh)
    return publish(wh, stored_reports)
