"""The load at size: what a task takes and what is shuffled."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from clinimart.plans import fact
from clinimart.plans.warehouse import EXTRACT
from clinimart.schemas import operational_schema
from clinimart.sources.sample import with_days_stayed

DAY, LATER = dt.date(2022, 3, 10), dt.date(2022, 5, 1)


def test_tasks_follow_the_visits():
    assert [fact.group_tasks(n) for n in (0, 1, 40_000, 900_000, 54_000_000)] == [1, 1, 8, 9, 540]


def odd(spark, hospital):
    """Visits, diagnoses and outcomes that repeat or lack keys, in the order of an extract."""
    rows = hospital(
        visit=[(1, 1, 1, DAY, "IPD"), (1, 1, 1, DAY, "IPD"), (2, 1, None, LATER, "OPD"), (3, None, 2, LATER, "OPD"),
               (None, 1, 1, DAY, "OPD"), (4, 2, 1, None, "OPD"), (5, 2, 2, LATER, "OPD")],
        diagnosis=[(1, "A1", "Mild"), (1, "A1", "Mild"), (1, None, "Mild"), (2, "B2", "Mild"), (3, "A1", None),
                   (4, "B2", "Mild"), (None, "A1", "Mild")],
        outcome=[(1, "Recovered", LATER), (1, "Readmitted", LATER), (None, "Recovered", LATER), (2, None, None)],
        treatment=[(1, 1, Decimal("10.00"), 3), (1, 2, Decimal("1.50"), 3), (2, 2, Decimal("2.00"), 1)],
        bed_allocation=[(1, 1, 1, DAY, LATER), (2, 1, 1, DAY, None), (3, 1, 2, LATER, None), (4, 1, None, DAY, LATER),
                        (5, None, 1, DAY, LATER), (6, 2, 1, LATER, None)],
    ).rows

    def table(name):
        fields = [f"{f.name} {f.dataType.simpleString()}" for f in operational_schema(name).fields]
        if name != "bed_allocation":
            return spark.createDataFrame(rows[name], ", ".join(fields))
        return with_days_stayed(spark.createDataFrame([(*r, None) for r in rows[name]], ", ".join(fields)))

    return [table(name) for name in EXTRACT]


def test_groups_count_the_rows_of_the_extract(spark, hospital):
    tables = odd(spark, hospital)
    rows = fact.raw_extract(*tables)

    def cases(status):
        return F.sum(F.when(F.col("outcome_status") == status, 1).otherwise(0))

    want = rows.groupBy(*fact.GRAIN).agg(
        F.count("*"), cases("Recovered"), cases("Readmitted"), F.sum("days_stayed"),
        F.round(F.avg("days_stayed"), 2).cast("decimal(6,2)"), F.round(F.avg("treatment_cost"), 2).cast("decimal(10,2)"),
    )
    got = fact.treatment_groups(*tables).select(
        *fact.GRAIN, "total_cases", "recovered_cases", "readmitted_cases", "total_bed_days", "avg_recovery_days",
        "avg_treatment_cost",
    )
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert want.count() == 9


def test_groups_are_summed_where_the_visits_are(spark, hospital, monkeypatch):
    """Neither rows with a disease and a ward nor groups are shuffled."""
    monkeypatch.setattr(fact, "VISITS_PER_TASK", 2)
    plan = fact.treatment_groups(*odd(spark, hospital))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(visit_date" in line]
    assert len(moved) == 1 and "REPARTITION_BY_NUM" in moved[0]
    assert not [line for line in plan.splitlines() if "Exchange" in line and "ward_id" in line and "visit_date" in line]
