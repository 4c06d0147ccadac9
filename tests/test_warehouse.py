from __future__ import annotations

from decimal import Decimal

import pytest
from conftest import day
from pyspark.sql import functions as F

from clinimart.operators import quality
from clinimart.plans import dims, fact, reports, summaries
from clinimart.plans.warehouse import latest, refresh

CALENDAR = ("2022-01-01", "2023-12-31")


def groups(hospital):
    return {
        (r.disease_code, r.ward_id): r for r in fact.treatment_groups(*hospital.extract()).collect()
    }


def test_fan_out_counts_joined_rows(hospital):
    h = hospital(
        bed_allocation=[
            (1, 1, 1, day("2022-03-10"), day("2022-03-14")),
            (2, 1, 1, day("2022-01-05"), None),
            (3, 1, 2, day("2022-02-01"), day("2022-02-21")),
        ]
    )
    assert fact.raw_extract(*h.extract()).count() == 3
    got = groups(h)
    assert {k: r.total_cases for k, r in got.items()} == {("A1", 1): 2, ("A1", 2): 1}
    assert sum(r.recovered_cases for r in got.values()) == 3
    assert got["A1", 1].avg_recovery_days == Decimal("4.00")
    assert got["A1", 1].total_bed_days == 4
    assert got["A1", 2].total_bed_days == 20


def test_later_stay_is_not_joined(hospital):
    h = hospital(bed_allocation=[(1, 1, 1, day("2022-03-11"), None)])
    got = groups(h)
    assert list(got) == [("A1", None)] and got["A1", None].total_cases == 1


def test_open_stays_leave_averages_null(hospital):
    h = hospital(bed_allocation=[(1, 1, 1, day("2022-03-01"), None), (2, 1, 1, day("2022-03-02"), None)])
    row = groups(h)["A1", 1]
    assert (row.total_cases, row.avg_recovery_days, row.total_bed_days) == (2, None, None)


def test_cost_ignores_duration_and_may_be_missing(hospital):
    h = hospital(
        visit=[(1, 1, 1, day("2022-03-10"), "OPD"), (2, 2, 1, day("2022-03-11"), "OPD")],
        diagnosis=[(1, "A1", "Mild"), (2, "B2", "Mild")],
        treatment=[(1, 1, Decimal("10.00"), 3), (1, 2, Decimal("0.50"), 9)],
        outcome=[],
    )
    got = groups(h)
    assert got["A1", None].avg_treatment_cost == Decimal("75.00")
    assert got["B2", None].avg_treatment_cost is None
    assert got["B2", None].recovered_cases == 0 and got["B2", None].total_cases == 1


def test_several_diagnoses_each_count(hospital):
    h = hospital(diagnosis=[(1, "A1", "Mild"), (1, "B2", "Severe")])
    assert {k: r.total_cases for k, r in groups(h).items()} == {("A1", None): 1, ("B2", None): 1}


@pytest.fixture
def mixed(hospital):
    """One loadable visit and one for every reason to skip or to keep."""
    return hospital(
        visit=[
            (1, 1, 1, day("2022-03-10"), "IPD"),
            (2, 1, 1, day("2024-01-01"), "OPD"),
            (3, 2, 9, day("2022-03-10"), "OPD"),
            (4, 2, 2, day("2022-04-10"), "OPD"),
            (5, 2, 2, day("2022-05-10"), "OPD"),
        ],
        diagnosis=[(i, "A1", "Mild") for i in (1, 2, 3, 5)] + [(4, "Z9", "Mild")],
        bed_allocation=[
            (1, 1, 1, day("2022-03-09"), day("2022-03-12")),
            (2, 2, 77, day("2022-05-01"), day("2022-05-04")),
        ],
        outcome=[(1, "Recovered", day("2022-04-01")), (5, "Readmitted", day("2022-06-01"))],
    )


def test_unknown_keys_are_skipped_with_a_reason(spark, mixed, folder):
    wh = refresh(spark, folder, mixed.table, *CALENDAR)
    reasons = {(str(r.visit_date), r.skip_reason) for r in wh.skipped.collect()}
    assert reasons == {
        ("2024-01-01", "date not in calendar"),
        ("2022-03-10", "unknown doctor"),
        ("2022-04-10", "unknown disease"),
    }
    kept = wh.fact.join(wh.dimension("dim_ward"), "ward_sk", "left").collect()
    assert {(r.date_id, r.ward_id) for r in kept} == {(20220310, 1), (20220510, None)}
    assert all(r.outcome_sk is None for r in kept)
    assert len({r.fact_id for r in kept}) == 2
    counters = quality.load_counters(wh.load_rows).first().asDict()
    assert counters == {
        "extracted_rows": 5, "transformed_groups": 5, "loaded_groups": 2, "skipped_groups": 3,
    }
    raw = fact.raw_extract(*mixed.extract()).count()
    assert raw == counters["extracted_rows"]


def test_refresh_again_changes_nothing(spark, mixed, folder):
    first = refresh(spark, folder, mixed.table, *CALENDAR)
    second = refresh(spark, folder, mixed.table, *CALENDAR)
    assert first.root != second.root and latest(spark, folder).root == second.root
    for name in ("dim_date", "dim_disease", "dim_doctor", "dim_ward", "dim_outcome"):
        assert sorted(first.dimension(name).collect()) == sorted(second.dimension(name).collect())
    a, b = (w.fact.drop("fact_id") for w in (first, second))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_unfinished_load_is_not_seen(spark, mixed, folder):
    first = refresh(spark, folder, mixed.table, *CALENDAR)

    def broken(name):
        if name == "treatment":
            raise RuntimeError("source is down")
        return mixed.table(name)

    with pytest.raises(RuntimeError):
        refresh(spark, folder, broken, *CALENDAR)
    assert latest(spark, folder).root == first.root


def test_stored_reports(spark, mixed, folder):
    wh = refresh(spark, folder, mixed.table, *CALENDAR, stored_reports=reports.STORED)
    assert sorted(wh.report("doctor_monthly").collect()) == sorted(reports.doctor_monthly(wh).collect())


def test_dimension_keys_follow_natural_order_and_stay(spark, hospital):
    first = dims.dim_doctor(hospital(doctor=[(5, "S", 5, None), (3, "S", 6, None)]).table("doctor"))
    assert {r.doctor_id: r.doctor_sk for r in first.collect()} == {3: 1, 5: 2}
    later = hospital(doctor=[(1, "S", 20, None), (3, "S", 11, "D"), (9, "S", 0, None)]).table("doctor")
    second = {r.doctor_id: r for r in dims.dim_doctor(later, first).collect()}
    assert {k: r.doctor_sk for k, r in second.items()} == {3: 1, 5: 2, 1: 3, 9: 4}
    assert (second[3].experience_band, second[3].department) == ("11+ yrs", "D")
    assert second[5].experience_band == "0-5 yrs"


def test_calendar(spark):
    rows = dims.dim_date(spark, *CALENDAR).orderBy("date_id").collect()
    assert len(rows) == 730 and rows[0].date_id == 20220101 and rows[-1].date_id == 20231231
    assert (rows[0].day_of_week, rows[0].month_name, rows[-1].quarter) == ("Saturday", "January", 4)


def test_empty_window(spark, mixed, folder):
    wh = refresh(spark, folder, mixed.table, *CALENDAR)
    row = reports.overview(wh, "2023-06-01", "2023-01-01").first()
    assert (row.total_cases, row.total_bed_days, row.avg_treatment_cost) == (0, 0, Decimal("0.00"))
    assert row.recovery_rate_pct is None and row.readmission_rate_pct is None
    assert reports.disease_trend(wh, "2023-06-01", "2023-01-01").isEmpty()
    assert reports.overview_request(wh).first().total_cases == 2


def test_window_prunes_years_and_pushes_keys(spark, mixed, folder):
    wh = refresh(spark, folder, mixed.table, *CALENDAR)
    report = reports.readmission_monthly(wh, "2022-03-01", "2022-03-31")
    plan = report._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "load_status" in line)
    partitions = scan.split("PartitionFilters: ")[1].split("PushedFilters: ")[0]
    assert "load_status" in partitions and "year_num" in partitions
    pushed = scan.split("PushedFilters: ")[1]
    assert "GreaterThanOrEqual(date_id,20220301)" in pushed
    assert "avg_treatment_cost" not in scan.split("ReadSchema: ")[1]


class Facts:
    """Warehouse stand-in with a hand-made fact."""

    def __init__(self, spark, rows, dims_):
        schema = (
            "full_date DATE, year_num INT, month_num INT, disease_sk INT, doctor_sk INT, ward_sk INT, "
            "total_cases BIGINT, recovered_cases BIGINT, readmitted_cases BIGINT, "
            "avg_treatment_cost DECIMAL(10,2), total_bed_days BIGINT"
        )
        full = [(d, d.year, d.month, *rest) for d, *rest in rows]
        self.fact, self.dims = spark.createDataFrame(full, schema), dims_

    def fact_between(self, date_from=None, date_to=None):
        return self.fact

    def dimension(self, name):
        return self.dims[name]


@pytest.fixture
def facts(spark):
    dims_ = {
        "dim_disease": spark.createDataFrame(
            [(1, "A1", "Flu"), (2, "B2", "Sepsis"), (3, "B3", "Sepsis")],
            "disease_sk INT, disease_code STRING, disease_name STRING",
        ),
        "dim_doctor": spark.createDataFrame(
            [(1, 10, "S", "D"), (2, 20, "S", "D"), (3, 30, "T", "D")],
            "doctor_sk INT, doctor_id INT, specialization STRING, department STRING",
        ),
        "dim_ward": spark.createDataFrame(
            [(1, 1, "ICU", "ICU", 10), (2, 2, "Cardiac", "ICU", 8)],
            "ward_sk INT, ward_id INT, ward_name STRING, ward_type STRING, capacity INT",
        ),
    }
    return lambda rows: Facts(spark, rows, dims_)


def row(date, disease=1, doctor=1, ward=None, cases=1, recovered=0, readmitted=0, cost=None, days=None):
    cost = None if cost is None else Decimal(cost)
    return (day(date), disease, doctor, ward, cases, recovered, readmitted, cost, days)


def test_moving_average_runs_over_rows(facts):
    wh = facts([row("2022-01-01", cost="10"), row("2022-02-01", cost="20"), row("2022-09-01", cost="40"),
                row("2023-01-01", cost="80"), row("2022-01-05", disease=2, cost="5")])
    got = {(r.disease_name, r.year_num, r.month_num): r.spend_3m_moving_avg
           for r in reports.disease_trend(wh).collect()}
    assert [got["Flu", 2022, 1], got["Flu", 2022, 2], got["Flu", 2022, 9], got["Flu", 2023, 1]] == [
        Decimal("10.00"), Decimal("15.00"), Decimal("23.33"), Decimal("46.67"),
    ]
    assert got["Sepsis", 2022, 1] == Decimal("5.00")


def test_diseases_of_one_name_are_one(facts):
    wh = facts([row("2022-01-01", disease=2, cases=20, readmitted=3), row("2022-01-02", disease=3, cases=5)])
    got = reports.readmission_by_disease(wh).collect()
    assert [(r.disease_name, r.total_cases, r.readmission_rate_pct) for r in got] == [
        ("Sepsis", 25, Decimal("12.00"))
    ]


def test_minimum_volumes(facts):
    wh = facts([row("2022-01-01", doctor=1, cases=29), row("2022-01-01", doctor=2, cases=30, disease=2)])
    assert [r.doctor_id for r in reports.doctor_ranking(wh).collect()] == [20]
    assert sorted(r.total_cases for r in reports.readmission_by_disease(wh).collect()) == [29, 30]
    small = facts([row("2022-01-01", cases=24)])
    assert reports.readmission_by_disease(small).isEmpty()


def test_ranking_uses_rounded_rates_and_shares_ranks(facts):
    wh = facts([row("2022-01-01", doctor=1, cases=30, recovered=10, cost="10"),
                row("2022-01-01", doctor=2, cases=30, recovered=10),
                row("2022-01-01", doctor=3, cases=31, recovered=10)])
    got = [(r.doctor_id, r.performance_rank, r.weighted_avg_treatment_cost) for r in
           reports.doctor_ranking(wh).collect()]
    assert got == [(10, 1, Decimal("10.00")), (20, 1, Decimal("0.00")), (30, 3, Decimal("0.00"))]


def test_ward_utilization_takes_the_daily_maximum(facts):
    wh = facts([row("2023-08-01", ward=1, days=200), row("2023-08-01", disease=2, ward=1, days=100),
                row("2023-08-02", ward=1, days=47), row("2023-02-10", ward=2, days=168),
                row("2023-02-11", ward=2), row("2023-02-11", days=999)])
    got = {r.ward_name: r for r in reports.ward_utilization(wh).collect()}
    assert (got["ICU"].month_occupied_bed_days, got["ICU"].utilization_pct) == (247, Decimal("79.68"))
    assert (got["Cardiac"].utilization_pct, got["Cardiac"].utilization_band) == (
        Decimal("75.00"), "High Utilization",
    )


def test_cost_trend_weights_and_lags_rounded_values(facts):
    wh = facts([row("2022-01-01", cases=2, cost="10"), row("2022-01-02", cases=1),
                row("2022-02-01", cases=1, cost="10")])
    got = [(r.avg_treatment_cost, r.mom_change_pct) for r in reports.cost_trend(wh).collect()]
    assert got == [(Decimal("6.67"), None), (Decimal("10.00"), Decimal("49.93"))]


def test_two_average_costs_differ(facts):
    wh = facts([row("2022-01-01", cases=9, cost="10"), row("2022-01-02", cases=1, cost="30"),
                row("2022-01-03", cases=10)])
    assert reports.overview(wh).first().avg_treatment_cost == Decimal("20.00")
    assert reports.monthly_trend(wh).first().avg_cost == Decimal("20.00")
    assert reports.cost_trend(wh).first().avg_treatment_cost == Decimal("6.00")


def test_fallback_only_when_the_warehouse_is_empty(spark, mixed, folder):
    wh = refresh(spark, folder, mixed.table, *CALENDAR)
    tables = [mixed.table(n) for n in ("visit", "outcome", "doctor")]
    stored = reports.doctor_monthly_with_fallback(wh, *tables, "2022-03-01", "2022-03-31").collect()
    assert [(r.doctor_id, r.total_cases) for r in stored] == [(1, 1)]
    derived = reports.doctor_monthly_with_fallback(wh, *tables, "2024-01-01", "2024-12-31").collect()
    assert [(r.doctor_id, r.month_label, r.total_cases) for r in derived] == [(1, "2024-01", 1)]


def test_doctor_view_counts_visits_once_and_outcomes_per_row(hospital):
    h = hospital(
        visit=[(1, 1, 1, day("2022-01-01"), "OPD"), (2, 1, 1, day("2022-06-01"), "OPD")],
        outcome=[(1, "Recovered", day("2022-02-01"))],
        bed_allocation=[
            (1, 1, 1, day("2023-01-01"), day("2023-01-05")), (2, 1, 1, day("2023-02-01"), None),
            (3, 1, 2, day("2023-03-01"), day("2023-03-02")),
        ],
    )
    view = reports.doctor_performance_view(
        *[h.table(n) for n in ("doctor", "visit", "bed_allocation", "outcome")]
    )
    got = {r.doctor_id: r for r in view.collect()}
    assert (got[1].total_visits, got[1].recovered_count, got[1].recovery_rate_pct) == (2, 3, Decimal("150.00"))
    assert got[1].avg_patient_stay == Decimal("2.50")
    assert (got[2].total_visits, got[2].recovery_rate_pct, got[2].avg_patient_stay) == (0, None, None)


# --- summaries --------------------------------------------------------------


@pytest.fixture
def ranking(spark):
    rows = [
        (1, "S", 40, Decimal("70.00"), Decimal("5.00")), (2, "S", 50, Decimal("70.00"), Decimal("5.00")),
        (3, "T", 90, Decimal("20.00"), Decimal("30.00")), (12, "T", 35, Decimal("20.00"), Decimal("30.00")),
    ]
    return spark.createDataFrame(
        rows, "doctor_id INT, specialization STRING, total_cases BIGINT, "
        "recovery_rate_pct DECIMAL(18,2), readmission_rate_pct DECIMAL(18,2)",
    )


def test_filters_and_extremes(ranking):
    assert [r.doctor_id for r in summaries.filter_ranking(ranking).collect()] == [2, 1, 3, 12]
    assert [r.doctor_id for r in summaries.filter_ranking(ranking, "T", 40).collect()] == [3]
    assert [r.doctor_id for r in summaries.filter_ranking(ranking, "all").collect()] == [2, 1, 3, 12]
    best, worst = sorted(summaries.doctor_extremes(ranking).collect(), key=lambda r: r.insight, reverse=True)
    assert best.sentence == "Dr. 2 has highest recovery (70.00%) with low readmissions (5.00%)."
    assert worst.sentence == "Dr. 3 needs attention with recovery 20.00% and readmission 30.00%."


def test_doctor_trend_choice(spark, ranking):
    months = spark.createDataFrame(
        [(1, "2022-02"), (1, "2022-01"), (3, "2022-01"), (7, "2022-01")], "doctor_id INT, month_label STRING"
    )
    def trend(requested=None, **filters):
        return [(r.doctor_id, r.month_label) for r in
                summaries.doctor_trend(ranking, months, requested, **filters).collect()]

    assert trend() == [(1, "2022-01"), (1, "2022-02")]
    assert trend(7) == [(7, "2022-01")]
    assert trend(99) == [(1, "2022-01"), (1, "2022-02")]
    assert trend(specialization="T") == [(3, "2022-01")]
    assert trend(specialization="none") == [(1, "2022-01"), (1, "2022-02")]


def test_months_sort_doctor_ids_as_text(spark):
    df = spark.createDataFrame([(2, "S", "2022-01", 9), (10, "S", "2022-01", 9), (1, "S", "2022-02", 2)],
                               "doctor_id INT, specialization STRING, month_label STRING, total_cases BIGINT")
    assert [r.doctor_id for r in summaries.filter_doctor_months(df, min_cases=5).collect()] == [10, 2]


def test_disease_totals_and_columns(spark):
    df = spark.createDataFrame(
        [(2022, 1, "", 1, Decimal("5.00"), None), (2022, 2, None, 2, None, 4), (2022, 2, "Flu", 3, Decimal("9.00"), 1)],
        "year_num INT, month_num INT, disease_name STRING, total_cases BIGINT, "
        "total_treatment_spend DECIMAL(28,2), total_bed_days BIGINT",
    )
    totals = summaries.disease_totals(df)
    assert [tuple(r) for r in totals.collect()] == [
        ("Flu", 3, Decimal("9.00"), 1), ("Unknown Disease", 3, Decimal("5.00"), 4),
    ]
    known = summaries.DISEASE_COLUMNS
    chosen = summaries.choose_columns(totals, ["total_cases", "disease_name"], known)
    assert chosen.columns == ["disease_name", "total_cases"]
    for bad in ([], ["nothing"]):
        with pytest.raises(ValueError):
            summaries.choose_columns(totals, bad, known)
    assert [r.total_cases for r in summaries.cases_by_month(df, "Flu").collect()] == [3]


@pytest.fixture
def wards(spark):
    rows = [(2022, 1, 1, "ICU", "ICU", 10, 300, "96.77", "Critical Over-Utilization"),
            (2022, 2, 1, "ICU", "ICU", 12, 10, "83.23", "High Utilization"),
            (2022, 1, 2, "Bay", "General", 5, 10, "10.00", "Low Utilization")]
    return spark.createDataFrame(
        [(*r[:7], Decimal(r[7]), r[8]) for r in rows],
        "year_num INT, month_num INT, ward_id INT, ward_name STRING, ward_type STRING, capacity INT, "
        "month_occupied_bed_days BIGINT, utilization_pct DECIMAL(18,2), utilization_band STRING",
    )


def test_ward_summaries(wards):
    icu, bay = summaries.ward_summary(wards).collect()
    assert (icu.capacity, icu.months_tracked, icu.total_occupied_bed_days) == (12, 2, 310)
    assert (icu.avg_utilization_pct, icu.peak_utilization_pct) == (Decimal("90.00"), Decimal("96.77"))
    assert icu.avg_utilization_band == "Critical Over-Utilization" and bay.ward_name == "Bay"
    assert [r.ward_name for r in summaries.ward_summary(wards, band="Low Utilization").collect()] == ["Bay"]
    kpis = summaries.ward_kpis(wards).first()
    assert kpis.avg_utilization_pct == Decimal("63.33")
    assert (kpis.most_utilized_ward, kpis.least_utilized_ward) == ("ICU", "Bay")
    assert (kpis.total_capacity_beds, kpis.total_used_bed_days) == (17, 320)
    cells = summaries.ward_heatmap(wards)
    matrix = summaries.ward_heatmap_matrix(cells, ["2022-01", "2022-02"]).collect()
    assert summaries.ward_heatmap_matrix(cells).columns[2:] == summaries.months_of(cells) == ["2022-01", "2022-02"]
    later = cells.unionByName(cells.limit(1).withColumn("month_label", F.lit("2031-07")))
    assert summaries.ward_heatmap_matrix(later).columns[2:] == ["2022-01", "2022-02", "2031-07"]
    assert [tuple(r)[1:] for r in matrix] == [
        ("Bay", Decimal("10.00"), None), ("ICU", Decimal("96.77"), Decimal("83.23")),
    ]


def test_readmission_summaries(spark):
    rows = [("A", 100, 10, 60), ("B", 100, 30, 20), ("C", 50, 0, 10)]
    df = spark.createDataFrame(rows, "disease_name STRING, total_cases BIGINT, readmitted_cases BIGINT, recovered_cases BIGINT")
    rated = reports._rates(df)
    kpis = summaries.readmission_kpis(rated).first()
    assert kpis.avg_readmission_rate_pct == Decimal("16.00") and kpis.disease_count == 3
    assert (kpis.highest_risk_disease, kpis.lowest_recovery_disease) == ("B", "B")
    shares = summaries.readmission_share(rated).collect()
    assert [(r.disease_name, r.readmission_share_pct) for r in shares] == [("B", Decimal("75.00")), ("A", Decimal("25.00"))]
    assert [r.disease_name for r in summaries.filter_risk(rated, "high").collect()] == ["B"]
    assert [r.disease_name for r in summaries.filter_risk(rated, None, 60).orderBy("disease_name").collect()] == ["A", "B"]
    empty = summaries.readmission_kpis(rated.filter("false")).first()
    assert empty.avg_readmission_rate_pct is None and empty.disease_count == 0


def test_missing_rates_are_derived(spark):
    df = spark.createDataFrame(
        [("2022-01", None, 8, 1, 2, None, None), ("2022-01", "A", 0, 0, 0, None, None)],
        "month_label STRING, disease_name STRING, total_cases BIGINT, readmitted_cases BIGINT, "
        "recovered_cases BIGINT, readmission_rate_pct DECIMAL(18,2), recovery_rate_pct DECIMAL(18,2)",
    )
    got = {r.disease_name: (r.readmission_rate_pct, r.recovery_rate_pct) for r in summaries.readmission_months(df).collect()}
    assert got == {"Unknown Disease": (Decimal("12.50"), Decimal("25.00")), "A": (Decimal("0.00"), Decimal("0.00"))}


def test_derived_rate_keeps_its_band(spark):
    """24.996 % shows as 25.00 but is not high; a stored 25.00 is."""
    df = spark.createDataFrame(
        [("2022-01", "A", 10000, 2499, 0, None, None), ("2022-01", "B", 100000, 24996, 0, None, None),
         ("2022-01", "C", 100000, 24996, 0, Decimal("25.00"), None), ("2022-01", "D", 4, 1, 0, None, None),
         ("2022-01", "E", 3_000_000_000, 749_999_999, 0, None, None)],
        "month_label STRING, disease_name STRING, total_cases BIGINT, readmitted_cases BIGINT, "
        "recovered_cases BIGINT, readmission_rate_pct DECIMAL(18,2), recovery_rate_pct DECIMAL(18,2)",
    )
    got = summaries.with_severity(summaries.readmission_months(df)).collect()
    assert {r.disease_name: r.severity for r in got} == {
        "A": "moderate", "B": "moderate", "C": "high", "D": "high", "E": "moderate",
    }
    assert {r.disease_name: round(r.readmission_rate_pct, 3) for r in got}["B"] == Decimal("24.996")


def test_equal_wards_follow_the_rows_of_the_report(spark):
    rows = [(2022, 2, 1, "Alpha", "ICU", 4, 5, Decimal("40.00"), "Low Utilization"),
            (2022, 1, 3, "Zulu", "ICU", 4, 5, Decimal("40.00"), "Low Utilization"),
            (2022, 1, 2, "Mike", "ICU", 4, 5, Decimal("30.00"), "Low Utilization"),
            (2022, 2, 2, "Mike", "ICU", 4, 5, Decimal("50.00"), "Low Utilization")]
    df = spark.createDataFrame(
        rows, "year_num INT, month_num INT, ward_id INT, ward_name STRING, ward_type STRING, capacity INT, "
        "month_occupied_bed_days BIGINT, utilization_pct DECIMAL(18,2), utilization_band STRING",
    )
    got = summaries.ward_kpis(df).first()
    assert (got.most_utilized_ward, got.least_utilized_ward) == ("Zulu", "Zulu")


def test_ranking_scans_the_fact_once(spark, mixed, folder):
    wh = refresh(spark, folder, mixed.table, *CALENDAR)
    plan = reports.doctor_ranking(wh)._jdf.queryExecution().executedPlan().toString()
    assert "load_status" not in plan  # the scores are written, ranking reads them alone


def test_fact_total_equals_kept_rows(spark, mixed, folder):
    wh = refresh(spark, folder, mixed.table, *CALENDAR)
    sums = wh.fact.agg(F.sum("total_cases").alias("n"), F.sum("recovered_cases").alias("a"),
                       F.sum("readmitted_cases").alias("b")).first()
    assert sums.n == 2 and sums.a + sums.b <= sums.n


def test_jobs(spark, mixed, folder):
    from clinimart.__main__ import main
    from clinimart.sources.storage import write_operational

    for name in ("disease", "doctor", "ward", "visit", "diagnosis", "outcome", "bed_allocation",
                 "treatment", "medicine"):
        write_operational(mixed.table(name), f"{folder}/ops", name)
    main(["refresh", f"{folder}/ops", f"{folder}/wh", *CALENDAR])
    main(["report", f"{folder}/wh", "overview", f"{folder}/out", "--from", "2022-05-01"])
    assert spark.read.parquet(f"{folder}/out").first().total_cases == 1
    for name in ("disease", "doctor", "ward", "visit", "diagnosis", "bed_allocation", "treatment", "medicine"):
        write_operational(mixed.table(name), f"{folder}/later", name)
    write_operational(mixed.table("outcome").filter("false"), f"{folder}/later", "outcome")
    main(["update", f"{folder}/ops", f"{folder}/later", f"{folder}/wh", *CALENDAR])
    whole = refresh(spark, f"{folder}/whole", lambda name: spark.read.parquet(f"{folder}/later/{name}"), *CALENDAR)
    a, b = (wh.fact.drop("fact_id") for wh in (latest(spark, f"{folder}/wh"), whole))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    main(["expire", f"{folder}/wh", "--keep", "1", "--grace-days", "0"])
    assert latest(spark, f"{folder}/wh").fact.count() == whole.fact.count()
    with pytest.raises(SystemExit):
        main(["report", f"{folder}/none", "overview", f"{folder}/out2"])
