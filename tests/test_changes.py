from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal
from pathlib import Path

import pytest
from conftest import Hospital, day
from pyspark.sql import functions as F

from clinimart.plans import changes
from clinimart.plans.warehouse import latest, refresh

CALENDAR = ("2020-01-01", "2023-12-31")
FACT = ["visit_date", "disease_code", "doctor_id", "ward_id", "disease_sk", "doctor_sk", "ward_sk", "date_id"]


def rows_of(wh):
    columns = [*FACT, *changes.MEASURES, "skip_reason", "load_status", "year_num", "fact_id"]
    return sorted(map(tuple, wh.load_rows.select(columns).collect()), key=repr)


def files_of(folder):
    return {str(p.relative_to(folder)) for p in Path(folder).glob("fact_load/**/*.parquet")}


def hospital_of(spark, rng, patients=12):
    """Visits of four years; some keys are unknown to the dimensions."""
    visits, diagnoses, treatments, outcomes, stays = [], [], [], [], []
    for v in range(160):
        on = day("2020-01-01") + dt.timedelta(days=rng.randrange(1500))
        visits.append((v, rng.randrange(patients), rng.choice([1, 2, 9]), on, "IPD"))
        for code in rng.sample(["A1", "B2", "ZZ"], rng.randint(1, 2)):
            diagnoses.append((v, code, "Mild"))
        for _ in range(rng.randint(0, 2)):
            treatments.append((v, rng.choice([1, 2]), Decimal(rng.randint(1, 90)), 1))
        if rng.random() < 0.8:
            outcomes.append((v, rng.choice(["Recovered", "Improved", "Readmitted"]), on))
    for a in range(40):
        on = day("2020-01-01") + dt.timedelta(days=rng.randrange(1400))
        left = on + dt.timedelta(days=rng.randint(1, 20)) if rng.random() < 0.8 else None
        stays.append((a, rng.randrange(patients), rng.choice([1, 2, 7]), on, left))
    return Hospital(
        spark, visit=visits, diagnosis=diagnoses, treatment=treatments, outcome=outcomes,
        bed_allocation=stays,
    )


def altered(rng, hospital, tables):
    """Some rows deleted, some changed, some new, in the named tables."""
    rows = {name: list(r) for name, r in hospital.rows.items()}
    for name in tables:
        own = rows[name]
        del own[rng.randrange(len(own))]
        at = rng.randrange(len(own))
        if name == "visit":
            v = own[at]
            own[at] = (v[0], v[1], 1, v[3] - dt.timedelta(days=400), v[4])
            own.append((900, 3, 2, day("2022-07-07"), "OPD"))
            rows["diagnosis"].append((900, "A1", "Mild"))
        elif name == "diagnosis":
            own.append((own[at][0], "NEW", "Severe"))
        elif name == "treatment":
            own[at] = (*own[at][:2], Decimal("77.50"), 2)
        elif name == "outcome":
            own[at] = (own[at][0], "Deceased", own[at][2])
        elif name == "bed_allocation":
            own[at] = (*own[at][:4], own[at][3] + dt.timedelta(days=33))
            own.append((800, 5, 2, day("2021-02-03"), None))
        elif name == "medicine":
            own.append((1, "Plain", None, Decimal("4.25")))
    return Hospital(hospital.spark, **rows)


def differences(before, after):
    def changed(name):
        old, new = (h.table(name) for h in (before, after))
        found = changes.changes_between(old, new)
        return None if found.isEmpty() else found

    return changed


CASES = [
    ["visit"], ["bed_allocation"], ["diagnosis", "medicine"],
    ["visit", "diagnosis", "treatment", "outcome", "bed_allocation"],
]


@pytest.mark.parametrize("tables", CASES, ids="-".join)
def test_equals_a_full_load_after_changes(spark, folder, tables):
    rng = random.Random("-".join(tables))
    before = hospital_of(spark, rng)
    after = altered(rng, before, tables)
    refresh(spark, folder, before.table, *CALENDAR)
    kept = files_of(folder)
    wh = changes.refresh_changed(spark, folder, after.table, differences(before, after), *CALENDAR)
    whole = refresh(spark, f"{folder}/whole", after.table, *CALENDAR)
    assert rows_of(wh) == rows_of(whole)
    assert latest(spark, folder).parts == wh.parts and kept <= files_of(folder)


def test_untouched_years_are_not_rewritten(spark, folder):
    before = hospital_of(spark, random.Random(4))
    last = max(before.rows["outcome"], key=lambda o: o[2])
    outcomes = [o for o in before.rows["outcome"] if o != last] + [(last[0], "Deceased", last[2])]
    after = Hospital(spark, **{**before.rows, "outcome": outcomes})
    first = refresh(spark, folder, before.table, *CALENDAR)
    wh = changes.refresh_changed(spark, folder, after.table, differences(before, after), *CALENDAR)
    new = {p for p in wh.parts if p[0] == wh.load_id}
    assert {p[2] for p in new} == {last[2].year}
    assert {p for p in wh.parts if p not in new} == {p for p in first.parts if p[2] != last[2].year}
    assert rows_of(wh) == rows_of(refresh(spark, f"{folder}/whole", after.table, *CALENDAR))
    assert rows_of(first) == rows_of(refresh(spark, f"{folder}/old", before.table, *CALENDAR))


def test_late_allocation_reaches_later_visits_of_its_patient(spark, hospital):
    h = hospital(visit=[(k, 1 + k % 2, 1, day(f"20{20 + k % 4}-03-0{1 + k % 9}"), "IPD") for k in range(20)])
    late = spark.createDataFrame([(1, day("2022-01-01"))], "patient_id bigint, admit_date date")
    found = changes.touched_visits(h.table, lambda name: late if name == "bed_allocation" else None)
    wanted = {(v[3], v[2]) for v in h.rows["visit"] if v[1] == 1 and v[3] >= day("2022-01-01")}
    assert {tuple(r) for r in found.collect()} == wanted


@pytest.mark.parametrize("calendar", [CALENDAR, ("2021-06-01", "2022-05-31"), ("2019-01-01", "2025-12-31")])
def test_new_members_and_calendars(spark, folder, calendar):
    before = hospital_of(spark, random.Random(8))
    after = Hospital(
        spark,
        **{
            **before.rows,
            "disease": [*before.rows["disease"], ("ZZ", "Known now", "Renal", "High")],
            "doctor": [*before.rows["doctor"], (9, "Renal", 3, None)],
            "ward": [*before.rows["ward"], (7, "New", "ICU", 3)],
        },
    )
    refresh(spark, folder, before.table, *CALENDAR)
    wh = changes.refresh_changed(spark, folder, after.table, lambda name: None, *calendar)
    again = refresh(spark, folder, after.table, *calendar)
    assert rows_of(wh) == rows_of(again)


def test_nothing_changed_and_nothing_there(spark, folder):
    before = hospital_of(spark, random.Random(9))
    first = changes.refresh_changed(spark, folder, before.table, lambda name: None, *CALENDAR)
    kept = files_of(folder)
    second = changes.refresh_changed(spark, folder, before.table, lambda name: None, *CALENDAR)
    assert second.load_id != first.load_id and second.parts == first.parts and files_of(folder) == kept
    empty = Hospital(spark, visit=[], diagnosis=[], treatment=[], outcome=[])
    wh = changes.refresh_changed(spark, folder, empty.table, differences(before, empty), *CALENDAR)
    assert wh.parts == [] and wh.fact.count() == wh.fact_between("2021-01-01").count() == 0
    assert latest(spark, folder).load_rows.filter(F.col("year_num") > 0).count() == 0
