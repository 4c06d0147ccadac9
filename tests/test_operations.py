from __future__ import annotations

import random
from decimal import Decimal

import pytest
from conftest import day
from pyspark.sql import functions as F

from clinimart.operators import admission, quality, tables
from clinimart.plans.warehouse import refresh
from clinimart.schemas import OPERATIONAL, WAREHOUSE, WAREHOUSE_KEYS
from clinimart.streaming import alerts

# --- admission ----------------------------------------------------------------


def decide(hospital, requests, **rows):
    h = hospital(admission_request=requests, **rows)
    decisions = admission.admission_decisions(
        h.table("admission_request"), h.table("ward"), h.table("bed_allocation")
    )
    return h, decisions


def request(i, ward, date="2022-01-01", patient=1):
    return (i, patient, 1, ward, "IPD", day(date))


def test_exactly_full_ward_rejects(hospital):
    open_stays = [(i, 1, 2, day("2022-01-01"), None) for i in (1, 2)]
    _, decisions = decide(hospital, [request(1, 2)], bed_allocation=open_stays)
    assert [(r.accepted, r.reason) for r in decisions.collect()] == [(False, admission.WARD_FULL)]


def test_discharge_frees_the_bed(hospital):
    stays = [(1, 1, 2, day("2022-01-01"), None), (2, 1, 2, day("2022-01-01"), day("2022-01-02"))]
    _, decisions = decide(hospital, [request(1, 2), request(2, 2)], bed_allocation=stays)
    assert {r.request_id: r.accepted for r in decisions.collect()} == {1: True, 2: False}


def test_unknown_ward_is_rejected(hospital):
    _, decisions = decide(hospital, [request(1, 99)])
    assert [r.reason for r in admission.rejected_requests(decisions).collect()] == [admission.WARD_UNKNOWN]


def test_batch_decides_like_one_call_after_the_other(spark, hospital, many_ranges):
    rng = random.Random(5)
    wards = [(w, f"W{w}", "General", rng.randrange(1, 12)) for w in range(1, 5)]
    stays = [(i, 1, rng.randrange(1, 5), day("2021-12-01"), rng.choice([None, day("2021-12-09")])) for i in range(25)]
    requests = [request(i, rng.choice([1, 1, 1, 2, 3, 4, 5]), f"2022-01-0{rng.randrange(1, 4)}") for i in range(80)]
    h, decisions = decide(hospital, requests, ward=wards, bed_allocation=stays)
    taken = {w: sum(1 for s in stays if s[2] == w and s[4] is None) for w, *_ in wards}
    capacity = {w[0]: w[3] for w in wards}
    want = {}
    for i, _, _, ward, _, _ in sorted(requests, key=lambda r: (r[5], r[0])):
        want[i] = ward in capacity and taken[ward] < capacity[ward]
        if want[i]:
            taken[ward] += 1
    assert {r.request_id: r.accepted for r in decisions.collect()} == want
    ids = sorted(i for i, ok in want.items() if ok)
    visits = admission.admitted_visits(decisions, h.table("visit")).collect()
    assert {r.request_id: r.visit_id for r in visits} == {i: 2 + n for n, i in enumerate(ids)}
    beds = admission.admitted_allocations(decisions, h.table("bed_allocation")).collect()
    assert {r.request_id: r.allocation_id for r in beds} == {i: 25 + n for n, i in enumerate(ids)}
    assert all(r.discharge_date is None for r in beds)


def test_occupancy(hospital):
    h = hospital(bed_allocation=[(1, 1, 2, day("2022-01-01"), None), (2, 1, 2, day("2022-01-01"), None)])
    rows = admission.ward_occupancy(h.table("ward"), h.table("bed_allocation")).collect()
    assert {r.ward_id: (r.current_occupancy, r.is_full) for r in rows} == {1: (0, False), 2: (2, True)}


# --- alerts -------------------------------------------------------------------

CHANGES = OPERATIONAL["allocation_change"]


def test_alert_only_above_fourteen_days(hospital):
    stays = [(i, 1, 1, day("2022-01-01"), day(f"2022-01-{d}")) for i, d in enumerate(("15", "16"))]
    h = hospital(bed_allocation=[*stays, (9, 1, 1, day("2022-01-01"), None)])
    got = alerts.alerts_at_rest(h.table("bed_allocation")).collect()
    assert [(r.allocation_id, r.days_stayed) for r in got] == [(1, 15)]
    assert got[0].alert_message == "Patient 1 has stayed 15 days in ward 1. Review required."


def test_stream_alerts_on_every_update_and_never_on_insert(spark, folder):
    source, log, state = f"{folder}/changes", f"{folder}/log", f"{folder}/state"

    def add(*rows):
        spark.createDataFrame(rows, CHANGES).write.mode("append").parquet(source)

    def run():
        alerts.start_alert_stream(spark, source, log, state, files_per_batch=2).awaitTermination()
        return sorted((r.allocation_id, r.change_seq) for r in alerts.read_alert_log(spark, log).collect())

    add((1, 0, "insert", 1, 1, 30), (1, 1, "update", 1, 1, 15), (2, 1, "update", 1, 1, 14), (3, 1, "update", 1, 1, None))
    assert run() == [(1, 1)]
    add((1, 2, "update", 1, 1, 16))
    assert run() == [(1, 1), (1, 2)]
    assert run() == [(1, 1), (1, 2)]


# --- quality ------------------------------------------------------------------


def test_clean_data_breaks_no_rule(hospital):
    h = hospital(admission_request=[], allocation_change=[])
    names = ["patient", "doctor", "ward", "visit", "diagnosis", "treatment", "bed_allocation", "outcome"]
    assert {r.violations for r in quality.null_violations(h.table, names).collect()} == {0}
    assert {r.violations for r in quality.domain_violations(h.table).collect()} == {0}
    assert {r.duplicate_keys for r in quality.duplicate_keys(h.table).collect()} == {0}
    assert {r.orphan_rows for r in quality.orphans(h.table).collect()} == {0}


def test_broken_rows_are_counted(hospital):
    h = hospital(
        patient=[(1, "31-45", "F", None, None), (1, "31-45", "X", "AB+++-", None)],
        ward=[(1, "ICU", "ICU", 0)],
        diagnosis=[(1, "A1", "Mild"), (1, "A1", "Mild"), (1, "A1", "Bad"), (8, "Q", "Mild"), (8, "Q", "Mild")],
        visit=[(1, 1, 1, day("2022-03-10"), "IPD"), (2, 7, 1, day("2022-03-10"), "Video")],
        admission_request=[], allocation_change=[],
    )
    domain = {(r.table_name, r.rule_name): r.violations for r in quality.domain_violations(h.table).collect()}
    assert domain["patient", "gender domain"] == 1 and domain["patient", "blood_group length"] == 1
    assert domain["ward", "capacity domain"] == 1 and domain["visit", "visit_type domain"] == 1
    assert domain["diagnosis", "severity domain"] == 1
    keys = {r.table_name: (r.duplicate_keys, r.surplus_rows) for r in quality.duplicate_keys(h.table).collect()}
    assert keys["patient"] == (1, 1) and keys["diagnosis"] == (2, 3)
    orphan = {(r.table_name, r.column_name): (r.orphan_keys, r.orphan_rows) for r in quality.orphans(h.table).collect()}
    assert orphan["visit", "patient_id"] == (1, 1)
    assert orphan["diagnosis", "visit_id"] == (1, 2) and orphan["diagnosis", "disease_code"] == (1, 2)


def test_missing_values_are_counted(spark):
    df = spark.createDataFrame([(1, None, 1), (None, None, 1)], "ward_id INT, ward_name STRING, capacity INT").selectExpr(
        "ward_id", "ward_name", "'x' ward_type", "capacity"
    )
    got = {r.rule_name: r.violations for r in quality.null_violations(lambda _: df, ["ward"]).collect()}
    assert got == {"ward_id": 1, "ward_name": 2, "ward_type": 0, "capacity": 0}


def test_dedup_append(spark):
    old = spark.createDataFrame([(1, "A")], "v INT, d STRING")
    new = spark.createDataFrame([(1, "A", 1, "x"), (2, "B", 5, "late"), (2, "B", 2, "first"), (3, "C", 1, None)],
                                "v INT, d STRING, n INT, s STRING")
    got = sorted(tuple(r) for r in quality.dedup_append(old, new, ["v", "d"], ["n"]).collect())
    assert got == [(2, "B", 2, "first"), (3, "C", 1, None)]


# --- tables -------------------------------------------------------------------


@pytest.fixture
def listing(spark):
    rows = [("Ward 10", Decimal("5.50")), ("ward 2", None), ("12", Decimal("100.00")), ("9", Decimal("20.25"))]
    return spark.createDataFrame(rows, "name STRING, amount DECIMAL(10,2)")


def test_search(listing):
    def names(text, columns=None):
        return sorted(r.name for r in tables.search(listing, text, columns).collect())

    assert names("  WARD ") == ["Ward 10", "ward 2"]
    assert names("5") == ["9", "Ward 10"]
    assert names("5", ["name"]) == []
    assert len(names("   ")) == 4


def test_sort_puts_numbers_by_value_then_text(listing):
    def names(column, descending=False):
        return [r.name for r in tables.sort_table(listing, column, descending).collect()]

    assert names("name") == ["9", "12", "ward 2", "Ward 10"]
    assert names("name", True) == ["Ward 10", "ward 2", "12", "9"]
    assert names("amount") == ["ward 2", "Ward 10", "9", "12"]


def test_sorts_give_positions(spark, many_ranges):
    cells = ["10", "9", "1e1", "b10", "B9", "a", None, "", " 7 ", "12D", "b2", "10.0"]
    listing = spark.createDataFrame(list(enumerate(cells)), "id INT, cell STRING")

    def order(descending=False, natural=True):
        rows = tables.sorted_table(listing, "cell", descending, natural, then=["id"]).collect()
        assert sorted(r.position for r in rows) == list(range(1, len(cells) + 1))
        return [r.cell for r in sorted(rows, key=lambda r: r.position)]

    assert order() == [None, "", " 7 ", "9", "1e1", "10", "10.0", "12D", "a", "b2", "B9", "b10"]
    assert order(natural=False) == [None, "", " 7 ", "9", "10", "10.0", "1e1", "12D", "a", "b10", "b2", "B9"]
    down = order(descending=True)
    assert down[:5] == ["b10", "B9", "b2", "a", "12D"] and down[-2:] == [None, ""]
    assert [r.cell for r in tables.sort_table(listing, "cell").collect()][-5:] == ["12D", "a", "b2", "B9", "b10"]
    assert tables.with_position(listing.limit(0), ["id"]).count() == 0


def test_all_rules_of_a_table_in_one_scan(spark, hospital, folder):
    h = hospital(admission_request=[], allocation_change=[])
    wh = refresh(spark, folder, h.table, "2022-01-01", "2022-12-31")

    def table(name):
        return wh.fact if name == "fact_treatment" else wh.dimension(name)

    def scans(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return sum("Relation" in line and "total_cases" in line for line in plan.splitlines())

    assert scans(quality.warehouse_orphans(table)) == 1
    assert scans(quality.duplicate_keys(table, WAREHOUSE_KEYS)) == 1
    found = {(r.table_name, r.key_columns): r.checked_rows for r in quality.duplicate_keys(table, WAREHOUSE_KEYS).collect()}
    assert found["dim_date", "full_date"] == 365 and len(found) == 12
    assert {r.violations for r in quality.null_violations(table, list(WAREHOUSE)).collect()} == {0}
    spoilt = wh.fact.withColumn("doctor_sk", F.lit(77).cast("bigint"))
    lost = quality.warehouse_orphans(lambda name: spoilt if name == "fact_treatment" else wh.dimension(name))
    assert {r.column_name: (r.orphan_keys, r.orphan_rows) for r in lost.collect()} == {
        "date_id": (0, 0), "disease_sk": (0, 0), "doctor_sk": (1, wh.fact.count()), "ward_sk": (0, 0),
        "outcome_sk": (0, 0),
    }


def test_keys_of_several_parts_are_told_apart(spark):
    rows = [("1", "11"), ("11", "1"), (None, "11"), ("-", "11"), ("1:1", "1"), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "a STRING, b STRING")
    got = quality.duplicate_keys(lambda _: df, {"t": [["a", "b"], ["b"]]}).collect()
    assert {r.key_columns: (r.checked_rows, r.duplicate_keys, r.surplus_rows) for r in got} == {
        "a, b": (7, 1, 1), "b": (7, 3, 4),
    }


def test_display(listing):
    shown = tables.display(listing, {"amount": "money"}).collect()
    assert [tuple(r) for r in shown] == [("Ward 10", "5.50"), ("ward 2", "0.00"), ("12", "100.00"), ("9", "20.25")]
