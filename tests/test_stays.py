from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clinimart.operators import skew, stays
from clinimart.operators.stays import expand_copies, stays_by_day, visit_stays

VISITS = "visit_id BIGINT, patient_id INT, visit_date DATE"
STAYS = "patient_id INT, ward_id INT, admit_date DATE, days_stayed INT"


def make(seed: int, visits: int, stays: int, span: int = 20):
    rng, start = random.Random(seed), dt.date(2022, 1, 1)

    def patient():
        return 1 if rng.random() < 0.4 else rng.randrange(2, 12)

    def date():
        return start + dt.timedelta(days=rng.randrange(span))

    v = [(i, patient(), date()) for i in range(visits)]
    b = [(patient(), rng.randrange(3), date(), rng.choice([None, 2, 5, 20])) for _ in range(stays)]
    return v, b


def brute(v, b):
    for visit_id, patient, day in v:
        joined = [(w, d) for p, w, admitted, d in b if p == patient and admitted <= day]
        for ward, days in joined or [(None, None)]:
            yield visit_id, ward, days


@pytest.mark.parametrize("seed,span", [(0, 20), (1, 20), (2, 3000), (3, 3000)])
def test_compact_rows_hold_the_joined_rows(spark, seed, span):
    v, b = make(seed, 150, 120, span)
    visits, stays = spark.createDataFrame(v, VISITS), spark.createDataFrame(b, STAYS)
    rows = expand_copies(visit_stays(visits, stays, ("ward_id", "days_stayed")))
    got = Counter((r.visit_id, r.ward_id, r.days_stayed) for r in rows.collect())
    assert got == Counter(brute(v, b))


@pytest.mark.parametrize("seed", range(3))
def test_totals_per_ward(spark, seed):
    v, b = make(seed, 150, 120)
    want: dict = {}
    for visit_id, ward, days in brute(v, b):
        copies, known, total = want.get((visit_id, ward), (0, 0, None))
        want[visit_id, ward] = (
            copies + 1, known + (days is not None), total if days is None else (total or 0) + days,
        )
    rows = visit_stays(spark.createDataFrame(v, VISITS), spark.createDataFrame(b, STAYS)).collect()
    got = {(r.visit_id, r.ward_id): (r.copies, r.known_stays or 0, r.stay_days) for r in rows}
    assert got == want and len(rows) == len(want)


def test_hot_patient_never_forms_pairs(spark):
    """300,000 visits and 100,000 stays of one patient are 3 * 10^10 pairs."""
    visits = spark.range(300_000).select(
        F.col("id").alias("visit_id"),
        F.lit(1).alias("patient_id"),
        F.date_add(F.lit("2022-01-01").cast("date"), (F.col("id") % 700).cast("int")).alias("visit_date"),
    )
    stays = spark.range(100_000).select(
        F.lit(1).alias("patient_id"),
        (F.col("id") % 10).cast("int").alias("ward_id"),
        F.date_add(F.lit("2022-01-01").cast("date"), (F.col("id") % 700).cast("int")).alias("admit_date"),
        F.lit(3).alias("days_stayed"),
    )
    total = visit_stays(visits, stays).agg(F.sum("copies").alias("n")).first().n
    per_day = [0] * 700
    for i in range(100_000):
        per_day[i % 700] += 1
    want, so_far = 0, 0
    for offset in range(700):
        so_far += per_day[offset]
        want += so_far * len(range(offset, 300_000, 700))
    assert total == want


@pytest.mark.parametrize("limit", [1, 4])
def test_crowded_days_are_sliced(spark, monkeypatch, limit):
    monkeypatch.setattr(skew, "HOT_ROWS", limit)
    v, b = make(7, 200, 60)
    joined = visit_stays(spark.createDataFrame(v, VISITS), spark.createDataFrame(b, STAYS), ("ward_id", "days_stayed"))
    got = Counter((r.visit_id, r.ward_id, r.days_stayed) for r in expand_copies(joined).collect())
    assert got == Counter(brute(v, b))


def test_slices_spread_one_key(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    left = spark.range(1000).select(F.col("id"), F.lit(1).alias("k"))
    sizes = left.groupBy("k").agg(skew.slices_for(F.count("*")).alias("slices"))
    right = sizes.withColumn("label", F.lit("x"))
    joined = skew.left_join_sliced(left, right, sizes, ["k"], spread="id")
    rows = joined.collect()
    assert sizes.first().slices == 11
    assert sorted(r.id for r in rows) == list(range(1000)) and {r.label for r in rows} == {"x"}


def test_long_history_is_joined_year_by_year(spark):
    """One patient with every row: the stays are looked up under a key per year, and a
    year's days meet only the intervals that reach into it."""
    start = dt.date(1990, 1, 1)
    v = [(i, 1, start + dt.timedelta(days=i)) for i in range(0, 9000, 3)]
    b = [(1, k % 2, start + dt.timedelta(days=5 * k), 2) for k in range(1800)]
    visits, stays = spark.createDataFrame(v, VISITS), spark.createDataFrame(b, STAYS)
    found = visit_stays(visits, stays)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in plan and "year(" in plan
    rows = found.groupBy("ward_id").agg(F.sum("copies").alias("n")).collect()
    want = Counter()
    for visit_id, _, day in v:
        for ward in (0, 1):
            want[ward] += sum(1 for _, w, admitted, _ in b if w == ward and admitted <= day)
        if day < b[0][2]:
            want[None] += 1
    assert {r.ward_id: r.n for r in rows if r.ward_id is not None} == {0: want[0], 1: want[1]}
    by_day = stays_by_day(visits.select("patient_id", "visit_date").distinct(), stays)
    assert by_day.count() == sum(len({w for _, w, a, _ in b if a <= day}) for _, _, day in v)


def test_no_days(spark):
    none = spark.createDataFrame([], VISITS)
    assert visit_stays(none, spark.createDataFrame([(1, 1, dt.date(2020, 1, 1), 2)], STAYS)).count() == 0


def test_lookup_tasks_follow_the_days():
    """A task looks up as many days at any size; few are left to Spark."""
    assert [stays.lookup_tasks(n) for n in (0, 1_000_000, 9_000_000, 54_000_000)] == [None, None, 90, 540]


def test_many_days_are_looked_up_in_a_number_of_tasks(spark, hospital, monkeypatch):
    """Adaptive execution merged the lookup by bytes and its tasks spilled. With a number
    of tasks the stays are the same, also for hot and missing keys."""
    schema = "visit_id BIGINT, patient_id BIGINT, visit_date DATE"
    days = [dt.date(2021 + i % 3, 1 + i % 12, 5) for i in range(60)]
    visits = spark.createDataFrame(
        [(i, i % 4 or None, day if i % 17 else None) for i, day in enumerate(days)], schema
    )
    rows = [(i, i % 5, i % 3, day, day + dt.timedelta(i) if i % 2 else None) for i, day in enumerate(days)]
    beds = hospital(bed_allocation=rows).table("bed_allocation")

    def found():
        lists = stays.visit_stay_lists(visits, beds, visits)
        listed = lists.withColumn("stay_list", F.sort_array("stay_list"))
        return [sorted(map(repr, df.collect())) for df in (listed, stays.visit_stays(visits, beds))], lists

    want, _ = found()
    for name, value in (("FEW_DAYS", 0), ("DAYS_PER_TASK", 2)):
        monkeypatch.setattr(stays, name, value)
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    got, lists = found()
    plan = lists._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == want and len(want[0]) == 60
    numbered = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert len([line for line in numbered if "year(" in line or "_bucket" in line]) == 2
    assert len([line for line in numbered if "_slice" in line]) == 2
