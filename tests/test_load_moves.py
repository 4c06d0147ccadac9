"""What a load moves: each visit a fixed number of times, whatever the dimensions' size."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as app
from clinimart.operators import skew
from clinimart.plans import fact, warehouse
from clinimart.plans.warehouse import EXTRACT, Warehouse, keyed_groups, write_dimensions
from clinimart.sources import catalog
from clinimart.sources.sample import SampleMapping

SF_DIR = "/root/testdata/sf0.001"
DAY, LATER = dt.date(2022, 3, 10), dt.date(2022, 5, 1)


@pytest.fixture
def no_broadcast(spark):
    """As with tables beyond the broadcast threshold, planned without run-time changes."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")


def plan_lines(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_tasks_follow_the_diagnoses():
    """Visits with many diagnoses have many groups; a task's share stays the same."""
    assert [fact.summing_tasks(n, 4 * n) for n in (0, 1, 900_000, 54_000_000)] == [1, 1, 36, 2160]
    assert fact.summing_tasks(54_000_000, 0) == 540


def test_visits_meet_hot_keys_without_a_shuffle(spark, monkeypatch):
    """The few hot keys are known when the join is planned, so the left rows move once."""
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "12k")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    left = spark.range(20_000).select("id", F.when(F.col("id") < 950, 1).otherwise(F.col("id")).alias("k"))
    sizes = left.groupBy("k").agg(skew.slices_for(F.count("*")).alias("slices"))
    joined = skew.left_join_sliced(left, sizes.withColumn("label", F.lit("x")), sizes, ["k"], spread="id")
    lines = plan_lines(joined)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")
    top = lines[: next(i for i, line in enumerate(lines) if "BroadcastExchange" in line)]
    assert len([line for line in top if "Exchange hashpartitioning(" in line]) == 1
    rows = joined.collect()
    assert sorted(r.id for r in rows) == list(range(20_000)) and {r.label for r in rows} == {"x"}


def twice(spark, hospital):
    """Visits of a known, a repeated, an unknown and no doctor."""
    h = hospital(
        visit=[(1, 1, 1, DAY, "IPD"), (2, 1, 2, DAY, "IPD"), (3, 1, 9, DAY, "OPD"), (4, 2, None, LATER, "OPD"),
               (5, 2, 2, None, "OPD")],
        diagnosis=[(v, d, "Mild") for v in (1, 2, 3, 4, 5) for d in ("A1", "B2")],
        bed_allocation=[(1, 1, 1, DAY, LATER), (2, 1, 2, DAY, LATER)],
        outcome=[(1, "Recovered", LATER), (2, "Readmitted", LATER)],
    )
    tables = [h.table(name) for name in EXTRACT[1:]]
    nullable = "visit_id BIGINT, patient_id BIGINT, doctor_id BIGINT, visit_date DATE, visit_type STRING"
    visit = spark.createDataFrame(h.rows["visit"], nullable)
    doctors = spark.createDataFrame([(1, 11), (2, 12), (2, 13), (2, 13)], "doctor_id BIGINT, doctor_sk BIGINT")
    return [visit, *tables], doctors


def test_groups_come_with_the_keys_of_their_doctor(spark, hospital):
    """Also where a doctor is repeated: a group once for each of its rows, its sums as before."""
    tables, doctors = twice(spark, hospital)
    want = fact.treatment_groups(*tables).join(doctors, "doctor_id", "left")
    got = fact.treatment_groups(*tables, doctors).select(want.columns)
    assert Counter(map(repr, got.collect())) == Counter(map(repr, want.collect()))
    assert got.count() == 2 * 2 + 2 * 2 * 3 + 2 * 2 + 2 + 2 * 3


def test_doctors_beyond_a_broadcast_do_not_move_the_groups(spark, no_broadcast, folder):
    """Visits meet the doctors before they become rows and groups."""
    site = app.Site.of(spark, SF_DIR)
    wh: Warehouse = write_dimensions(spark, folder, "a", site.table, *site.span, None)
    groups = fact.treatment_groups(*[site.table(name) for name in app.EXTRACT], wh.dimension("dim_doctor"))
    lines = plan_lines(keyed_groups(groups, wh))
    placed = next(i for i, line in enumerate(lines) if "REPARTITION_BY_NUM" in line)
    moved = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(doctor_id" in line]
    assert moved and min(moved) > placed


def test_diagnoses_move_once_to_their_bucket(spark, folder):
    mapping = SampleMapping(spark, SF_DIR)
    placed = mapping.diagnosis(8)
    assert len([line for line in plan_lines(placed) if "Exchange hashpartitioning(visit_id" in line]) == 1
    assert sorted(placed.collect()) == sorted(mapping.diagnosis().collect())
    name = catalog.write_bucketed(placed, folder, "clinimart_placed", "diagnosis", 8, placed=True)
    written = catalog.read_bucketed(spark, name)
    assert len(written.inputFiles()) == 8
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, placed.collect()))
    spark.sql("DROP DATABASE clinimart_placed CASCADE")


def test_groups_are_not_copied_for_their_doctor(spark, hospital):
    """A visit takes the key of its doctor before it becomes rows; nothing is taken out of
    a list above the sums."""
    tables, doctors = twice(spark, hospital)
    lines = plan_lines(fact.treatment_groups(*tables, doctors).select("doctor_sk", "total_cases"))
    sums = next(i for i, line in enumerate(lines) if "HashAggregate(keys=" in line)
    made = [i for i, line in enumerate(lines) if "Generate " in line]
    assert made and min(made) > sums


def test_a_load_is_not_sorted_by_partition(spark, folder, monkeypatch):
    """Groups go to the open files of their years as they come, and only within the load
    is the session set so; further years than files give the same rows."""
    site, name = app.Site.of(spark, SF_DIR), "spark.sql.maxConcurrentOutputFileWriters"
    tables, before = [site.table(t) for t in EXTRACT], spark.conf.get(name)
    found = []
    for files in (32, 2):
        monkeypatch.setattr(warehouse, "OPEN_PARTITIONS", files)
        seen = {}

        def keyed(groups, wh, seen=seen):
            seen["files"] = spark.conf.get(name)
            return keyed_groups(groups, wh)

        monkeypatch.setattr(warehouse, "keyed_groups", keyed)
        wh = write_dimensions(spark, f"{folder}/{files}", "a", site.table, "1993-01-01", "1995-12-31", None)
        wh.parts = warehouse.write_fact(fact.treatment_groups(*tables, wh.dimension("dim_doctor")), wh)
        assert seen["files"] == str(files) and spark.conf.get(name) == before
        found.append(Counter(map(repr, wh.load_rows.collect())))
        assert {p[1] for p in wh.parts} == {"loaded", "skipped"} and len({p[2] for p in wh.parts}) > 5
    assert found[0] == found[1] and max(found[0].values()) == 1
