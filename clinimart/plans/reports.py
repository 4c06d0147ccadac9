"""Decision reports over the warehouse, one function per report.

All follow one shape: join the fact with its (calendar-bounded) dates, aggregate
by surrogate key first, so partial sums shrink the data before any shuffle and
before a dimension is joined, then label and finish on the small aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import MIN_DISEASE_CASES, MIN_DOCTOR_CASES, utilization_band
from ..functions.dates import DEFAULT_FROM, DEFAULT_TO, month_label, request_window
from ..functions.numbers import MONEY, change_percentage, exact_ratio, or_zero, percentage, spend
from ..operators.ordering import rank_rows
from ..operators.skew import left_join_sliced, slices_for
from ..sources.catalog import in_window
from ..sources.storage import written_once
from .warehouse import Warehouse

MONTH = ["year_num", "month_num"]
CASES = ["total_cases", "readmitted_cases", "recovered_cases"]


def _sums(*names: str) -> list[Column]:
    return [F.sum(name).alias(name) for name in names]


def _with_spend(fact: DataFrame) -> DataFrame:
    return fact.withColumn("spend", spend(F.col("avg_treatment_cost"), F.col("total_cases")))


def _rates(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "readmission_rate_pct": percentage("readmitted_cases", "total_cases"),
            "recovery_rate_pct": percentage("recovered_cases", "total_cases"),
        }
    )


def _by_disease(wh: Warehouse, fact: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Sums per ``keys`` and disease name (diseases sharing a name are one)."""
    names = wh.dimension("dim_disease").select("disease_sk", "disease_name")
    return (
        fact.groupBy(*keys, "disease_sk")
        .agg(*_sums(*measures))
        .join(names, "disease_sk")
        .groupBy(*keys, "disease_name")
        .agg(*_sums(*measures))
    )


def _by_doctor(wh: Warehouse, fact: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    doctors = wh.dimension("dim_doctor").select(
        "doctor_sk", "doctor_id", "specialization", "department"
    )
    return (
        fact.groupBy(*keys, "doctor_sk")
        .agg(*_sums(*measures))
        .join(doctors, "doctor_sk")
        .drop("doctor_sk")
    )


def disease_resources(wh: Warehouse, date_from=None, date_to=None) -> DataFrame:
    """Cases, bed days and spend per month and disease, in no order."""
    fact = _with_spend(wh.fact_between(date_from, date_to)).withColumn(
        "bed_days", or_zero(F.col("total_bed_days"))
    )
    monthly = _by_disease(wh, fact, MONTH, ["total_cases", "bed_days", "spend"])
    return monthly.select(
        *MONTH,
        "disease_name",
        "total_cases",
        F.col("bed_days").alias("total_bed_days"),
        F.col("spend").cast(MONEY).alias("total_treatment_spend"),
    )


def disease_trend(wh: Warehouse, date_from=None, date_to=None) -> DataFrame:
    """Disease resources with the mean spend of the disease's last three rows.
    The mean runs over rows that exist, not over calendar months."""
    last_three = Window.partitionBy("disease_name").orderBy(*MONTH).rowsBetween(-2, 0)
    value = F.col("total_treatment_spend")
    return (
        disease_resources(wh, date_from, date_to)
        .withColumns(
            {"_sum": F.sum(value).over(last_three), "_rows": F.count(value).over(last_three)}
        )
        .withColumn("spend_3m_moving_avg", exact_ratio("_sum", "_rows"))
        .drop("_sum", "_rows")
        .orderBy(*MONTH, value.desc(), "disease_name")
    )


def doctor_ranking(wh: Warehouse, date_from=None, date_to=None) -> DataFrame:
    """Doctors with enough cases, ranked by recovery, then low readmission,
    then volume. Rates are rounded before they are ranked. Ranking reads the
    scores, one row per doctor, several times; they are written first, so the fact
    is scanned and summed once."""
    fact = _with_spend(wh.fact_between(date_from, date_to))
    totals = _by_doctor(wh, fact, [], [*CASES, "spend"])
    scored = (
        _rates(totals.filter(F.col("total_cases") >= MIN_DOCTOR_CASES))
        .withColumn("weighted_avg_treatment_cost", exact_ratio("spend", "total_cases"))
        .drop("spend")
    )
    scored = written_once(scored, "scores")
    order = [("recovery_rate_pct", "desc"), ("readmission_rate_pct", "asc"), ("total_cases", "desc")]
    return (
        rank_rows(scored, order, "performance_rank")
        .select(
            "doctor_id",
            "specialization",
            "department",
            "total_cases",
            "recovered_cases",
            "readmitted_cases",
            "recovery_rate_pct",
            "readmission_rate_pct",
            "weighted_avg_treatment_cost",
            "performance_rank",
        )
        .orderBy("performance_rank", "doctor_id")
    )


def ward_day_occupancy(wh: Warehouse, date_from=None, date_to=None) -> DataFrame:
    """Occupied bed days per ward and day: the largest value of the day's fact
    rows, so a stay seen under several diseases counts once."""
    wards = wh.dimension("dim_ward")
    return (
        wh.fact_between(date_from, date_to)
        .filter(F.col("ward_sk").isNotNull())
        .groupBy("full_date", "ward_sk")
        .agg(F.max(or_zero(F.col("total_bed_days"))).alias("occupied_bed_days"))
        .join(wards, "ward_sk")
        .select("full_date", "ward_id", "ward_name", "ward_type", "capacity", "occupied_bed_days")
    )


def ward_utilization(wh: Warehouse, date_from=None, date_to=None) -> DataFrame:
    """Monthly utilization per ward with its band. A month counts all its
    calendar days; the band looks at the unrounded percentage."""
    ward = ["ward_id", "ward_name", "ward_type", "capacity"]
    day = F.col("full_date")
    months = (
        ward_day_occupancy(wh, date_from, date_to)
        .groupBy(F.year(day).alias("year_num"), F.month(day).alias("month_num"), *ward)
        .agg(
            F.sum("occupied_bed_days").alias("month_occupied_bed_days"),
            F.dayofmonth(F.last_day(F.max(day))).alias("days_in_month"),
        )
    )
    used, available = "month_occupied_bed_days", "CAST(capacity AS BIGINT) * days_in_month"
    return months.select(
        *MONTH,
        *ward,
        "month_occupied_bed_days",
        percentage(used, available).alias("utilization_pct"),
        utilization_band(F.col(used) * 100, F.expr(available)).alias("utilization_band"),
    ).orderBy(*MONTH, F.col("utilization_pct").desc(), "ward_id")


def cost_trend(wh: Warehouse, date_from=None, date_to=None) -> DataFrame:
    """Case-weighted cost per month and its change on the month before, taken on
    rounded values. The window orders one row per calendar month."""
    by_month = Window.orderBy(*MONTH)
    return (
        _with_spend(wh.fact_between(date_from, date_to))
        .groupBy(*MONTH)
        .agg(*_sums("spend", "total_cases"))
        .select(*MONTH, exact_ratio("spend", "total_cases").alias("avg_treatment_cost"))
        .withColumn("_previous", F.lag("avg_treatment_cost", 1).over(by_month))
        .withColumn("mom_change_pct", change_percentage("avg_treatment_cost", "_previous"))
        .drop("_previous")
        .orderBy(*MONTH)
    )


def readmission_by_disease(wh: Warehouse, date_from=None, date_to=None) -> DataFrame:
    totals = _by_disease(wh, wh.fact_between(date_from, date_to), [], CASES)
    return _rates(totals.filter(F.col("total_cases") >= MIN_DISEASE_CASES)).orderBy(
        F.col("readmission_rate_pct").desc(), F.col("total_cases").desc(), "disease_name"
    )


def readmission_monthly(wh: Warehouse, date_from=None, date_to=None) -> DataFrame:
    monthly = _by_disease(wh, wh.fact_between(date_from, date_to), MONTH, CASES)
    return (
        _rates(monthly.filter(F.col("total_cases") > 0))
        .withColumn("month_label", month_label(F.col("year_num"), F.col("month_num")))
        .orderBy(*MONTH, F.col("readmission_rate_pct").desc(), "disease_name")
    )


def meta(wh: Warehouse) -> DataFrame:
    """Last date with facts and number of fact rows."""
    return wh.fact_between().agg(
        F.max("full_date").alias("last_fact_date"), F.count("*").alias("fact_rows")
    )


def overview(wh: Warehouse, date_from=None, date_to=None) -> DataFrame:
    """Headline figures as one row, also for an empty window. The cost is the
    plain mean over fact rows that have one, unlike the weighted reports."""
    sums = wh.fact_between(date_from, date_to).agg(
        *[or_zero(F.sum(c)).alias(c) for c in (*CASES, "total_bed_days")],
        F.sum("avg_treatment_cost").alias("_cost"),
        F.count("avg_treatment_cost").alias("_costed"),
    )
    return _rates(sums).select(
        *CASES,
        F.coalesce(
            exact_ratio("_cost", "_costed"), F.lit(0).cast("decimal(18,2)")
        ).alias("avg_treatment_cost"),
        "total_bed_days",
        "recovery_rate_pct",
        "readmission_rate_pct",
    )


def overview_request(
    wh: Warehouse,
    date_from: str | None = None,
    date_to: str | None = None,
    default: tuple[str, str] = (DEFAULT_FROM, DEFAULT_TO),
) -> DataFrame:
    """Overview as a dashboard asks for it: a missing bound takes its default."""
    return overview(wh, *request_window(date_from, date_to, default))


def monthly_trend(wh: Warehouse, date_from=None, date_to=None) -> DataFrame:
    """Cases, plain mean cost and readmissions per month."""
    return (
        wh.fact_between(date_from, date_to)
        .groupBy(*MONTH)
        .agg(
            *_sums("total_cases", "readmitted_cases"),
            F.sum("avg_treatment_cost").alias("_cost"),
            F.count("avg_treatment_cost").alias("_costed"),
        )
        .orderBy(*MONTH)
        .select(
            month_label(F.col("year_num"), F.col("month_num")).alias("month_label"),
            "total_cases",
            exact_ratio("_cost", "_costed").alias("avg_cost"),
            "readmitted_cases",
        )
    )


def labelled_sample(wh: Warehouse, rows: int) -> DataFrame:
    """The first fact rows with their labels. The order on natural keys makes
    the sample repeatable, and rows are cut before any label is joined."""
    order = ["visit_date", "disease_code", "doctor_id", F.col("ward_id").asc_nulls_first()]
    first = wh.load_rows.filter(F.col("load_status") == "loaded").orderBy(*order).limit(rows)
    return (
        first.join(wh.dimension("dim_date").select("date_id", "full_date"), "date_id")
        .join(wh.dimension("dim_disease").select("disease_sk", "disease_name"), "disease_sk")
        .join(wh.dimension("dim_doctor").select("doctor_sk", "specialization"), "doctor_sk")
        .join(wh.dimension("dim_ward").select("ward_sk", "ward_name"), "ward_sk", "left")
        .orderBy(*order)
        .select(
            "full_date",
            "disease_name",
            "specialization",
            "ward_name",
            "total_cases",
            "recovered_cases",
            "avg_treatment_cost",
        )
    )


DOCTOR_MONTH = [
    "doctor_id",
    "specialization",
    "department",
    *MONTH,
    "month_label",
    "total_cases",
    "recovered_cases",
    "readmitted_cases",
    "recovery_rate_pct",
    "readmission_rate_pct",
]


def _doctor_month(totals: DataFrame) -> DataFrame:
    return (
        _rates(totals.filter(F.col("total_cases") > 0))
        .withColumn("month_label", month_label(F.col("year_num"), F.col("month_num")))
        .select(*DOCTOR_MONTH)
    )


def doctor_monthly(wh: Warehouse, date_from=None, date_to=None) -> DataFrame:
    totals = _by_doctor(wh, wh.fact_between(date_from, date_to), MONTH, CASES)
    return _doctor_month(totals).orderBy("doctor_id", *MONTH)


def doctor_monthly_from_visits(
    visit: DataFrame, outcome: DataFrame, doctor: DataFrame, date_from=None, date_to=None
) -> DataFrame:
    """The same report from operational tables: it counts visits, not fact
    cases. Visits are reduced per doctor and month before the doctor join."""
    first, last = request_window(date_from, date_to)
    day, status = F.col("visit_date"), F.col("status")
    totals = (
        in_window(visit, "visit_date", first, last)
        .select("visit_id", "doctor_id", "visit_date")
        .join(outcome.select("visit_id", "status"), "visit_id", "left")
        .groupBy("doctor_id", F.year(day).alias("year_num"), F.month(day).alias("month_num"))
        .agg(
            F.count("*").alias("total_cases"),
            F.count_if(status == "Recovered").alias("recovered_cases"),
            F.count_if(status == "Readmitted").alias("readmitted_cases"),
        )
        .join(doctor.select("doctor_id", "specialization", "department"), "doctor_id")
    )
    return _doctor_month(totals).orderBy("doctor_id", *MONTH)


def doctor_monthly_with_fallback(
    wh: Warehouse,
    visit: DataFrame,
    outcome: DataFrame,
    doctor: DataFrame,
    date_from: str,
    date_to: str,
) -> DataFrame:
    """Warehouse report, or the operational one when the warehouse has nothing
    in the window. One row of the pruned fact decides which side is read at all."""
    if wh.fact_between(date_from, date_to).isEmpty():
        return doctor_monthly_from_visits(visit, outcome, doctor, date_from, date_to)
    return doctor_monthly(wh, date_from, date_to)


def doctor_performance_view(
    doctor: DataFrame, visit: DataFrame, bed_allocation: DataFrame, outcome: DataFrame
) -> DataFrame:
    """Visits, mean stay and outcomes per doctor.

    By definition every visit meets all allocations of its patient, with no date
    condition, so outcomes count joined rows while visits are distinct, and the
    rate may exceed 100. Visits are reduced per patient and doctor, allocations
    per patient, and the counts are multiplied instead of forming the rows; a
    patient with very many visits is spread over tasks by doctor.
    """
    status = F.col("status")
    contacts = (
        visit.select("visit_id", "patient_id", "doctor_id")
        .join(outcome.select("visit_id", "status"), "visit_id", "left")
        .groupBy("patient_id", "doctor_id")
        .agg(
            F.count("*").alias("visits"),
            F.count_if(status == "Recovered").alias("recovered"),
            F.count_if(status == "Readmitted").alias("readmitted"),
        )
    )
    sizes = visit.groupBy("patient_id").agg(slices_for(F.count("*")).alias("slices"))
    stays = (
        bed_allocation.groupBy("patient_id")
        .agg(
            F.count("*").alias("stays"),
            F.count("days_stayed").alias("known"),
            F.sum(F.col("days_stayed").cast("bigint")).alias("days"),
        )
        .join(sizes, "patient_id")
    )
    copies = F.coalesce("stays", F.lit(1))
    per_doctor = (
        left_join_sliced(contacts, stays, sizes, ["patient_id"], spread="doctor_id")
        .groupBy("doctor_id")
        .agg(
            F.sum("visits").alias("visits"),
            F.sum(F.col("visits") * F.col("days")).alias("days"),
            F.sum(F.col("visits") * F.col("known")).alias("known"),
            F.sum(F.col("recovered") * copies).alias("recovered"),
            F.sum(F.col("readmitted") * copies).alias("readmitted"),
        )
    )
    return (
        doctor.select("doctor_id", "specialization", "experience_years")
        .join(per_doctor, "doctor_id", "left")
        .select(
            "doctor_id",
            "specialization",
            "experience_years",
            or_zero(F.col("visits")).alias("total_visits"),
            exact_ratio("days", "known").alias("avg_patient_stay"),
            or_zero(F.col("recovered")).alias("recovered_count"),
            or_zero(F.col("readmitted")).alias("readmission_count"),
            percentage("recovered", "visits").alias("recovery_rate_pct"),
        )
    )


# Reports that page summaries start from.
STORED = {
    "disease_resources": disease_resources,
    "doctor_ranking": doctor_ranking,
    "doctor_monthly": doctor_monthly,
    "ward_utilization": ward_utilization,
    "readmission_by_disease": readmission_by_disease,
    "readmission_monthly": readmission_monthly,
}
