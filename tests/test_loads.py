"""The load log: counts taken while writing, expiry, and views over a load."""

from __future__ import annotations

import datetime as dt
from datetime import timedelta
from pathlib import Path

import pytest
from conftest import Hospital, day
from pyspark.sql import functions as F

from clinimart.operators import quality
from clinimart.plans import changes, reports, views, warehouse
from clinimart.plans.warehouse import expire, latest, refresh
from clinimart.schemas import OPERATIONAL, WAREHOUSE

CALENDAR = ("2021-01-01", "2023-12-31")
WHOLE = timedelta(0)


@pytest.fixture
def years(hospital):
    """Visits of three years, one of them of an unknown disease."""
    return hospital(
        visit=[(k, 1, 1, day(f"202{1 + k % 3}-03-0{1 + k}"), "IPD") for k in range(6)],
        diagnosis=[(k, "A1" if k else "ZZ", "Mild") for k in range(6)],
        outcome=[(k, "Recovered", day("2023-04-01")) for k in range(6)],
        bed_allocation=[(1, 1, 1, day("2021-01-05"), day("2021-01-09")), (2, 1, 2, day("2022-02-01"), None)],
        admission_request=[], allocation_change=[],
    )


def counts(wh):
    by_name = {r.table_name: r.row_count for r in wh.row_counts().collect()}
    return by_name, wh.counters().first().asDict()


def recounted(wh):
    tables = {name: wh.fact.count() if name == "fact_treatment" else wh.dimension(name).count() for name in WAREHOUSE}
    return tables, quality.load_counters(wh.load_rows).first().asDict()


def test_counts_of_the_log_are_those_of_the_tables(spark, years, folder):
    wh = refresh(spark, folder, years.table, *CALENDAR)
    assert counts(wh) == recounted(wh) == counts(latest(spark, folder))
    assert wh.counters().first().skipped_groups == 1
    more = Hospital(spark, **{**years.rows, "outcome": [(k, "Improved", day("2023-04-01")) for k in range(5)]})
    again = changes.refresh_changed(
        spark, folder, more.table,
        lambda name: years.table("outcome").filter("visit_id = 5") if name == "outcome" else None, *CALENDAR,
    )
    assert counts(again) == recounted(again) == counts(latest(spark, folder))
    assert {p[0] for p in again.parts} == {wh.load_id, again.load_id}


def test_empty_load(spark, hospital, folder):
    wh = refresh(spark, folder, hospital(visit=[], diagnosis=[]).table, *CALENDAR)
    assert counts(latest(spark, folder)) == recounted(wh)
    assert wh.partitions().count() == 0


def test_load_that_keeps_less_than_it_wrote_is_not_published(spark, years, folder, monkeypatch):
    class Lost(warehouse.Observation):
        @property
        def get(self):
            return {**super().get, "rows": 10**6}

    monkeypatch.setattr(warehouse, "Observation", Lost)
    with pytest.raises(RuntimeError):
        refresh(spark, folder, years.table, *CALENDAR)
    assert latest(spark, folder) is None


def folders(root):
    return {p.name for p in Path(root).glob("load=*")} | {p.name for p in Path(root).glob("fact_load/load_id=*")}


def test_old_loads_go_after_the_grace_period(spark, years, folder):
    loads = [refresh(spark, folder, years.table, *CALENDAR) for _ in range(3)]
    rows = sorted(loads[0].load_rows.collect(), key=repr)
    assert expire(spark, folder, keep=2) == []  # marked; a reader that is open can finish
    assert sorted(loads[0].load_rows.collect(), key=repr) == rows
    assert expire(spark, folder, keep=2, grace=WHOLE) == [loads[0].load_id]
    assert folders(folder) == {f"{kind}={wh.load_id}" for wh in loads[1:] for kind in ("load", "load_id")}
    assert expire(spark, folder, keep=2, grace=WHOLE) == []
    assert latest(spark, folder).load_id == loads[2].load_id
    assert sorted(latest(spark, folder).load_rows.collect(), key=repr) == rows
    with pytest.raises(ValueError):
        expire(spark, folder, keep=0)


def test_taken_over_partitions_stay(spark, years, folder):
    first = refresh(spark, folder, years.table, *CALENDAR)
    rows = sorted(first.load_rows.collect(), key=repr)

    def late(name):
        return years.table("visit").filter("year(visit_date) = 2022") if name == "visit" else None

    for _ in range(2):
        last = changes.refresh_changed(spark, folder, years.table, late, *CALENDAR)
    assert expire(spark, folder, keep=1, grace=WHOLE)
    assert sorted(last.load_rows.collect(), key=repr) == rows
    kept = {p.name for p in Path(folder).glob(f"fact_load/load_id={first.load_id}/*/*")}
    assert kept == {"year_num=2021", "year_num=2023"}


def test_statements_with_bound_values(spark, years, folder):
    wh = refresh(spark, folder, years.table, *CALENDAR)
    names = views.register(spark, wh, lambda name: years.table(name) if name in years.rows else spark.createDataFrame([], OPERATIONAL[name]), "t1")
    for bounds in (("2021-01-01", "2023-12-31"), ("2022-02-01", "2022-12-31"), ("2030-01-01", "2030-12-31")):
        for name, report in (("overview", reports.overview), ("disease_resources", reports.disease_resources)):
            asked = views.run(spark, names, name, **views.window(*bounds))
            want = report(wh, *bounds)
            assert sorted(asked.columns) == sorted(want.columns)
            assert sorted(asked.select(want.columns).collect()) == sorted(want.collect())
            assert dict(asked.dtypes) == dict(want.dtypes)
    assert views.window(None, "") == {"date_from": dt.date(2022, 1, 1), "date_to": dt.date(2023, 12, 31)}
    found = views.run(spark, names, "doctors_by_specialization", specialization="x' OR '1'='1", min_visits=0)
    assert found.count() == 0
    found = views.run(spark, names, "doctors_by_specialization", specialization="Surgeon", min_visits=1)
    assert [r.doctor_id for r in found.collect()] == [1]
    plan = views.run(spark, names, "overview", **views.window("2022-02-01", "2022-02-28"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in text.splitlines() if "FileScan" in line and "load_status" in line)
    assert "year_num" in scan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(date_id,20220201)" in scan
    assert spark.sql(f"SELECT * FROM {names['fact_treatment']}").filter(F.col("total_cases") > 0).count() == wh.fact.count()
