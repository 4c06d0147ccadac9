"""Entry points: the flagship query, all queries, and their reference SQL.

Queries start from operational tables derived from the sample folder. These and
the warehouse load are written once per session (as a scheduled refresh would)
and read by every report; nothing is kept in driver memory.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle  # noqa: E402
from clinimart.functions.text import slug  # noqa: E402
from clinimart.operators import admission, quality, tables  # noqa: E402
from clinimart.operators.stays import visit_stays  # noqa: E402
from clinimart.plans import changes, fact, reports, summaries, views  # noqa: E402
from clinimart.plans.warehouse import Warehouse, refresh  # noqa: E402
from clinimart.schemas import PRIMARY_KEYS, WAREHOUSE, WAREHOUSE_KEYS  # noqa: E402
from clinimart.sources.sample import (  # noqa: E402
    SampleTables,
    with_days_stayed,
)
from clinimart.sources.storage import new_folder, written_once  # noqa: E402
from clinimart.streaming import alerts  # noqa: E402

try:
    import corpus_pipeline
    from clinimart.llm import oracles as llm_oracles
    from clinimart.llm import queries as llm_queries
except ImportError:  # the text operators, or what they need, can be left out
    llm_queries = llm_oracles = corpus_pipeline = None

WINDOW = (oracle.WIN_FROM, oracle.WIN_TO)
CHANGING = ("visit", "diagnosis", "treatment", "outcome", "bed_allocation")
EXTRACT = ("visit", "diagnosis", "outcome", "bed_allocation", "treatment", "medicine")


class Site:
    """One sample folder in one session: operational tables and warehouse."""

    _open: dict[tuple[str, str], Site] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sample = SampleTables(spark, sf_dir)
        self._stored: set[str] = set()

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Site:
        key = (spark.sparkContext.applicationId, str(sf_dir))
        if key not in cls._open:
            cls._open[key] = cls(spark, str(sf_dir))
        return cls._open[key]

    def table(self, name: str, *columns: str) -> DataFrame:
        return self.sample.table(name, *columns)

    def _load(self, date_from, date_to) -> Warehouse:
        return refresh(self.spark, new_folder(self.spark, "warehouse"), self.table, date_from, date_to)

    @cached_property
    def wh(self) -> Warehouse:
        """A load whose calendar covers all visits."""
        return self._load(*self.span)

    @cached_property
    def short_wh(self) -> Warehouse:
        """A load with a calendar of its own, to show what is skipped."""
        return self._load(oracle.SHORT_FROM, oracle.SHORT_TO)

    def earlier_table(self, name: str) -> DataFrame:
        """A table as it was known on a past day: later visits, outcomes and admissions
        are missing, patients discharged since are still admitted, and a ward's
        admissions of some months had not been reported yet."""
        now, day = self.table(name), F.to_date(F.lit(oracle.KNOWN_BEFORE))
        seen = self.table("visit").filter(F.col("visit_date") < day).select("visit_id")
        if name in ("visit", "diagnosis", "treatment"):
            return now.join(seen, "visit_id", "left_semi").select(now.columns)
        if name == "outcome":
            return now.filter(F.col("outcome_date") < day)
        if name == "bed_allocation":
            late = (F.col("ward_id") == oracle.LATE_WARD) & (F.col("admit_date") >= oracle.LATE_FROM)
            left = F.when(F.col("discharge_date") < day, F.col("discharge_date"))
            known = now.filter((F.col("admit_date") < day) & ~late).withColumn("discharge_date", left)
            return with_days_stayed(known).select(now.columns)
        return now

    def changed(self, name: str) -> DataFrame:
        """Rows of a table that differ between that day and now."""
        return written_once(changes.changes_between(self.earlier_table(name), self.table(name)), "changes")

    @cached_property
    def span(self) -> tuple:
        """First and last day with a visit."""
        day = F.col("visit_date")
        return tuple(self.table("visit", "visit_date").agg(F.min(day), F.max(day)).first())

    @cached_property
    def earlier_wh(self) -> Warehouse:
        """A load of that day, with a calendar up to now."""
        return refresh(self.spark, new_folder(self.spark, "warehouse"), self.earlier_table, *self.span)

    @cached_property
    def changed_wh(self) -> Warehouse:
        """The same warehouse after a refresh of what changed since."""
        return changes.refresh_changed(
            self.spark, self.earlier_wh.base, self.table,
            lambda name: self.changed(name) if name in CHANGING else None, *self.span,
        )

    def any_table(self, name: str) -> DataFrame:
        if name == "fact_treatment":
            return self.wh.fact.drop("year_num")
        return self.wh.dimension(name) if name in WAREHOUSE else self.table(name)

    @cached_property
    def views(self) -> dict[str, str]:
        """Names of the registered views of this site."""
        return views.register(self.spark, self.wh, self.table, self.sample.database)

    def report(self, name: str) -> DataFrame:
        """A stored report, computed and written on first use."""
        if name not in self._stored:
            self.wh.store_report(name, reports.STORED[name](self.wh))
            self._stored.add(name)
        return self.wh.report(name)

    def decide(self) -> DataFrame:
        return admission.admission_decisions(
            self.table("admission_request"), self.table("ward"), self.table("bed_allocation")
        )

    @cached_property
    def decisions(self) -> DataFrame:
        """The batch's decisions, written once for all that follows from them."""
        return written_once(self.decide(), "decisions")


def _dim_date(s: Site) -> DataFrame:
    visits = s.table("visit", "visit_date").groupBy("visit_date").agg(F.count("*").alias("visits"))
    dates = s.wh.dimension("dim_date")
    return dates.join(visits, dates.full_date == visits.visit_date, "left").select(
        *dates.columns, F.coalesce("visits", F.lit(0)).alias("visits")
    )


def _dim_outcome(s: Site) -> DataFrame:
    counts = s.table("outcome", "status").groupBy("status").agg(F.count("*").alias("outcomes"))
    labels = s.wh.dimension("dim_outcome")
    return labels.join(counts, labels.outcome_label == counts.status, "left").select(
        *labels.columns, F.coalesce("outcomes", F.lit(0)).alias("outcomes")
    )


def _dedup_append(s: Site) -> DataFrame:
    stored_visits = s.table("visit", "visit_id", "visit_date").filter("visit_date < '1998-01-01'")
    stored = s.table("diagnosis").join(stored_visits, "visit_id", "left_semi")
    incoming = s.sample.mapping.diagnosis_lines()
    return quality.dedup_append(stored, incoming, ["visit_id", "disease_code"], ["quantity"])


def _duplicate_keys(s: Site) -> DataFrame:
    keys = {name: [key] for name, key in PRIMARY_KEYS.items()}
    keys["treatment"] = [["visit_id", "medicine_id", "duration_days"]]
    return quality.duplicate_keys(s.any_table, keys | WAREHOUSE_KEYS)


def _alert_stream(s: Site) -> DataFrame:
    log = new_folder(s.spark, "alerts")
    query = alerts.start_alert_stream(
        s.spark, s.sample.path("allocation_change"), f"{log}/log", f"{log}/checkpoint"
    )
    query.awaitTermination()
    return alerts.read_alert_log(s.spark, f"{log}/log").drop("created_at")


def _display_wards(s: Site) -> DataFrame:
    rows = summaries.ward_months(s.report("ward_utilization")).select(
        "month_label",
        "ward_name",
        "ward_type",
        "capacity",
        "month_occupied_bed_days",
        "utilization_pct",
        "utilization_band",
        slug(F.col("utilization_band")).alias("band_slug"),
    )
    return tables.display(
        rows,
        {"capacity": "count", "month_occupied_bed_days": "count", "utilization_pct": "percent"},
    )


def _display_money(s: Site) -> DataFrame:
    return tables.display(
        summaries.disease_totals(s.report("disease_resources")),
        {"total_treatment_spend": "money", "total_cases": "count", "total_bed_days": "count"},
    )


def _doctor_fallback(s: Site, wh: Warehouse, date_from: str, date_to: str) -> DataFrame:
    return reports.doctor_monthly_with_fallback(
        wh, s.table("visit"), s.table("outcome"), s.table("doctor"), date_from, date_to
    )


def _disease_rows(s: Site) -> DataFrame:
    rows = summaries.disease_totals(s.report("disease_resources"))
    return rows.select("disease_name", "total_cases", "total_bed_days")


def _table_sort(s: Site) -> DataFrame:
    return tables.sort_table(_disease_rows(s).drop("total_bed_days"), "disease_name")


def _sorted(table: str, column: str, **how) -> Callable[[Site], DataFrame]:
    """A sorted table with positions; equal rows stay in the order of their entity."""

    def build(s: Site) -> DataFrame:
        if table == "diseases":
            return tables.sorted_table(_disease_rows(s), column, then=["disease_name"], **how)
        rows = s.report("doctor_ranking").select("doctor_id", "specialization", "recovery_rate_pct")
        labelled = rows.withColumn("doctor_label", F.concat(F.lit("Dr "), F.col("doctor_id").cast("string")))
        return tables.sorted_table(labelled, column, then=["doctor_id"], **how)

    return build


def _ordered(report: str, *order: str) -> Callable[[Site], DataFrame]:
    """A stored report with the place of each row in the report's order."""

    def build(s: Site) -> DataFrame:
        columns = [F.col(o.removesuffix(" desc")) for o in order]
        columns = [c.desc() if o.endswith(" desc") else c for c, o in zip(columns, order, strict=True)]
        return tables.with_position(s.report(report), columns)

    return build


QUERIES: dict[str, Callable[[Site], DataFrame]] = {
    # sources
    "scan_projection": lambda s: s.table("visit", "visit_id", "patient_id", "visit_date"),
    "bed_allocation_days": lambda s: with_days_stayed(
        s.table("bed_allocation", "allocation_id", "admit_date", "discharge_date")
    ),
    "inpatient_visits": lambda s: s.table(
        "visit", "visit_id", "patient_id", "visit_date", "visit_type"
    ).filter(F.col("visit_type").isin("IPD", "Emergency")),
    "dim_date": _dim_date,
    "dim_disease": lambda s: s.wh.dimension("dim_disease"),
    "dim_doctor": lambda s: s.wh.dimension("dim_doctor"),
    "dim_ward": lambda s: s.wh.dimension("dim_ward"),
    "dim_outcome": _dim_outcome,
    # extract and fact
    "visit_treatment_cost": lambda s: fact.visit_treatment_cost(
        s.table("treatment"), s.table("medicine")
    ),
    "visit_stay_range_join": lambda s: visit_stays(
        s.table("visit", "visit_id", "patient_id", "visit_date"), s.table("bed_allocation")
    ),
    "raw_extract": lambda s: fact.raw_extract(*[s.table(name) for name in EXTRACT]),
    "fact_treatment": lambda s: s.wh.fact.drop("fact_id", "year_num"),
    "fact_refreshed": lambda s: s.changed_wh.fact.drop("fact_id", "year_num"),
    "fact_refresh_partitions": lambda s: s.changed_wh.partitions(),
    "fact_date_semi": lambda s: s.short_wh.load_rows.join(
        s.short_wh.dimension("dim_date").select("date_id"), "date_id", "left_semi"
    ).select("visit_date", "disease_code", "doctor_id", "ward_id", "total_cases"),
    "fact_skipped_rows": lambda s: s.short_wh.skipped.select(
        "visit_date", "disease_code", "doctor_id", "ward_id", "total_cases", "skip_reason"
    ),
    "fact_labelled_sample": lambda s: reports.labelled_sample(s.wh, 5),
    "etl_counters": lambda s: s.short_wh.counters(),
    "etl_counters_recounted": lambda s: quality.load_counters(s.short_wh.load_rows),
    # reports
    "disease_trend": lambda s: reports.disease_trend(s.wh),
    "disease_trend_windowed": lambda s: reports.disease_resources(s.wh, *WINDOW),
    "doctor_ranking": lambda s: reports.doctor_ranking(s.wh),
    "doctor_ranking_windowed": lambda s: reports.doctor_ranking(s.wh, *WINDOW),
    "doctor_ranking_filtered": lambda s: summaries.filter_ranking(
        s.report("doctor_ranking"), "NATION_7", 100
    ),
    "ward_day_occupancy": lambda s: reports.ward_day_occupancy(s.wh),
    "ward_utilization": lambda s: reports.ward_utilization(s.wh),
    "cost_trend": lambda s: reports.cost_trend(s.wh),
    "readmission_by_disease": lambda s: reports.readmission_by_disease(s.wh),
    "readmission_monthly": lambda s: reports.readmission_monthly(s.wh),
    "warehouse_meta": lambda s: reports.meta(s.wh),
    "overview": lambda s: reports.overview(s.wh),
    "overview_window": lambda s: reports.overview(s.wh, *WINDOW),
    "overview_from": lambda s: reports.overview(s.wh, date_from=oracle.WIN_FROM),
    "overview_until": lambda s: reports.overview(s.wh, date_to=oracle.WIN_TO),
    "overview_default_window": lambda s: reports.overview_request(s.wh),
    "overview_own_default_window": lambda s: reports.overview_request(s.wh, default=WINDOW),
    "overview_half_open_request": lambda s: reports.overview_request(
        s.wh, date_to=oracle.REQUEST_TO, default=WINDOW
    ),
    "overview_window_sql": lambda s: views.run(
        s.spark, s.views, "overview", **views.window(default=WINDOW)
    ),
    "overview_empty_window_sql": lambda s: views.run(s.spark, s.views, "overview", **views.window()),
    "disease_resources_sql": lambda s: views.run(
        s.spark, s.views, "disease_resources", **views.window(*WINDOW)
    ),
    "doctor_performance_view_sql": lambda s: s.spark.sql(
        f"SELECT * FROM {s.views[views.DOCTOR_VIEW]}"
    ),
    "doctors_by_specialization_sql": lambda s: views.run(
        s.spark, s.views, "doctors_by_specialization", specialization="NATION_7", min_visits=100
    ),
    "monthly_trend": lambda s: reports.monthly_trend(s.wh),
    "doctor_monthly": lambda s: reports.doctor_monthly(s.wh),
    "doctor_monthly_ops": lambda s: reports.doctor_monthly_from_visits(
        s.table("visit"), s.table("outcome"), s.table("doctor"), oracle.FROM, oracle.TO
    ),
    "doctor_monthly_with_fallback": lambda s: _doctor_fallback(s, s.wh, *WINDOW),
    "doctor_monthly_fallback_used": lambda s: _doctor_fallback(
        s, s.short_wh, oracle.FALLBACK_FROM, oracle.FALLBACK_TO
    ),
    "doctor_performance_view": lambda s: reports.doctor_performance_view(
        s.table("doctor"), s.table("visit"), s.table("bed_allocation"), s.table("outcome")
    ),
    "default_doctor_trend": lambda s: summaries.doctor_trend(
        s.report("doctor_ranking"), s.report("doctor_monthly")
    ),
    "requested_doctor_trend": lambda s: summaries.doctor_trend(
        s.report("doctor_ranking"), s.report("doctor_monthly"), requested=7
    ),
    "doctor_monthly_filtered": lambda s: summaries.filter_doctor_months(
        s.report("doctor_monthly"), "NATION_7", 5
    ),
    # summaries
    "disease_totals": lambda s: summaries.disease_totals(s.report("disease_resources")),
    "disease_totals_columns": lambda s: summaries.choose_columns(
        summaries.disease_totals(s.report("disease_resources")),
        summaries.DEFAULT_DISEASE_COLUMNS,
        summaries.DISEASE_COLUMNS,
    ),
    "disease_monthly": lambda s: summaries.disease_monthly(s.report("disease_resources")),
    "cases_by_month": lambda s: summaries.cases_by_month(s.report("disease_resources")),
    "cases_by_month_of_disease": lambda s: summaries.cases_by_month(
        s.report("disease_resources"), "Condition Brand#12"
    ),
    "cases_by_month_unknown_disease": lambda s: summaries.cases_by_month(
        s.report("disease_resources"), "No Such Condition"
    ),
    "top_diseases_by_spend": lambda s: summaries.top_diseases_by_spend(
        s.report("disease_resources")
    ),
    "top_doctors": lambda s: summaries.top_doctors(s.report("doctor_ranking")),
    "doctor_extremes": lambda s: summaries.doctor_extremes(s.report("doctor_ranking")),
    "doctor_extremes_filtered": lambda s: summaries.doctor_extremes(
        summaries.filter_ranking(s.report("doctor_ranking"), "NATION_7", 100)
    ),
    "ward_monthly_filtered": lambda s: summaries.ward_months(
        s.report("ward_utilization"), "ASIA", "Low Utilization"
    ),
    "ward_summary": lambda s: summaries.ward_summary(s.report("ward_utilization")),
    "ward_heatmap": lambda s: summaries.ward_heatmap(s.report("ward_utilization")),
    "ward_heatmap_matrix": lambda s: summaries.ward_heatmap_matrix(
        summaries.ward_heatmap(s.report("ward_utilization"))
    ),
    "ward_kpis": lambda s: summaries.ward_kpis(s.report("ward_utilization")),
    "readmitted_by_month": lambda s: summaries.readmitted_by_month(
        s.report("readmission_monthly")
    ),
    "readmitted_by_month_of_disease": lambda s: summaries.readmitted_by_month(
        s.report("readmission_monthly"), "Condition Brand#12"
    ),
    "readmitted_by_month_unknown_disease": lambda s: summaries.readmitted_by_month(
        s.report("readmission_monthly"), "No Such Condition"
    ),
    "readmission_severity": lambda s: summaries.with_severity(
        summaries.readmission_months(s.report("readmission_monthly"))
    ),
    "readmission_risk_filtered": lambda s: summaries.filter_risk(
        summaries.readmission_months(s.report("readmission_monthly")), "high", 20
    ),
    "readmission_kpis_filtered": lambda s: summaries.readmission_kpis(
        summaries.filter_risk(s.report("readmission_by_disease"), "high", 100)
    ),
    "readmission_kpis": lambda s: summaries.readmission_kpis(s.report("readmission_by_disease")),
    "top_diseases_by_cases": lambda s: summaries.top_diseases_by_cases(
        s.report("readmission_by_disease")
    ),
    "readmission_share": lambda s: summaries.readmission_share(
        s.report("readmission_by_disease")
    ),
    "filter_options": lambda s: summaries.filter_options(
        s.report("doctor_ranking"),
        s.report("ward_utilization"),
        s.report("disease_resources"),
        s.report("readmission_monthly"),
    ),
    # tables
    "table_search": lambda s: tables.search(
        s.report("doctor_ranking"),
        " ASIA ",
        ["doctor_id", "specialization", "department", "total_cases", "recovery_rate_pct"],
    ),
    "table_sort": _table_sort,
    "table_sort_number": _sorted("diseases", "total_cases"),
    "table_sort_number_descending": _sorted("doctors", "recovery_rate_pct", descending=True),
    "table_sort_natural": _sorted("diseases", "disease_name"),
    "table_sort_natural_descending": _sorted("doctors", "doctor_label", descending=True),
    "table_sort_plain": _sorted("diseases", "disease_name", natural=False),
    "table_sort_plain_descending": _sorted("doctors", "specialization", descending=True, natural=False),
    "disease_resources_order": _ordered(
        "disease_resources", "year_num", "month_num", "total_treatment_spend desc", "disease_name"
    ),
    "doctor_ranking_order": _ordered("doctor_ranking", "performance_rank", "doctor_id"),
    "ward_utilization_order": _ordered(
        "ward_utilization", "year_num", "month_num", "utilization_pct desc", "ward_id"
    ),
    "readmission_monthly_order": _ordered(
        "readmission_monthly", "year_num", "month_num", "readmission_rate_pct desc", "disease_name"
    ),
    "display_table": _display_wards,
    "display_money": _display_money,
    # quality
    "dq_duplicate_keys": _duplicate_keys,
    "dq_orphans": lambda s: quality.orphans(s.table),
    "dq_warehouse_orphans": lambda s: quality.warehouse_orphans(s.any_table),
    "dq_nulls": lambda s: quality.null_violations(s.table, oracle.NULL_TABLES),
    "dq_warehouse_nulls": lambda s: quality.null_violations(s.any_table, list(WAREHOUSE)),
    "dq_domains": lambda s: quality.domain_violations(s.table),
    "dq_row_counts": lambda s: quality.row_counts(s.table, oracle.NULL_TABLES).unionByName(
        s.wh.row_counts()
    ),
    "dq_reconcile": lambda s: quality.reconcile(
        s.wh.fact_between(), s.wh.dimension("dim_outcome"), s.table("outcome")
    ),
    "dedup_append": _dedup_append,
    # admission and alerts
    "ward_current_occupancy": lambda s: admission.ward_occupancy(
        s.table("ward"), s.table("bed_allocation")
    ),
    "admission_control": lambda s: s.decide(),
    "admission_visits": lambda s: admission.admitted_visits(s.decisions, s.table("visit")),
    "admission_allocations": lambda s: admission.admitted_allocations(
        s.decisions, s.table("bed_allocation")
    ),
    "admission_rejections": lambda s: admission.rejected_requests(s.decisions),
    "long_stay_alerts": lambda s: alerts.alerts_at_rest(s.table("bed_allocation")),
    "long_stay_alerts_stream": _alert_stream,
}


def _bind(build: Callable[[Site], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Site.of(spark, sf_dir))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: disease resource trend with its moving average."""
    return queries()["disease_trend"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _bind(build) for name, build in QUERIES.items()}
    if llm_queries:
        found |= llm_queries.QUERIES | {"pipeline": corpus_pipeline.run}
    return found


def oracle_sql() -> dict[str, str]:
    found = oracle.all_statements()
    if llm_oracles:
        found |= llm_oracles.STATEMENTS
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
