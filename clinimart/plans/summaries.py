"""Page summaries: further aggregation, filters and top lists over the reports.

Inputs are report results (aggregates), so these run on far fewer rows than the
fact. Ties are always broken by the entity, so a list is the same on every run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import readmission_severity, utilization_band
from ..functions.dates import month_label
from ..functions.numbers import MONEY, exact_ratio, or_zero, percentage

# A rate that may have been worked out here and is not rounded.
EXACT_RATE = "decimal(28,10)"
# Label of a missing name, columns of the disease table, list lengths.
UNKNOWN_DISEASE = "Unknown Disease"
DISEASE_COLUMNS = ["disease_name", "total_treatment_spend", "total_cases", "total_bed_days"]
DEFAULT_DISEASE_COLUMNS = DISEASE_COLUMNS[:3]
TOP_DISEASES, TOP_DOCTORS, TOP_OUTCOMES, TOP_SHARES = 8, 10, 10, 8


def _disease_label() -> Column:
    name = F.col("disease_name")
    return F.when(F.coalesce(name, F.lit("")) == "", UNKNOWN_DISEASE).otherwise(name)


def _label(df: DataFrame) -> DataFrame:
    return df.withColumn("month_label", month_label(F.col("year_num"), F.col("month_num")))


def only(df: DataFrame, column: str, choice: str | None) -> DataFrame:
    """Rows with this category, or all rows for "all" or no choice."""
    return df if choice in (None, "all") else df.filter(F.col(column) == choice)


def only_known(df: DataFrame, column: str, choice: str | None) -> DataFrame:
    """The same, but a choice that does not occur means all rows. The test is a
    subquery, so nothing runs while the plan is made."""
    if choice in (None, "all"):
        return df
    chosen = F.col(column) == choice
    return df.filter(chosen | ~df.filter(chosen).exists())


def at_least(df: DataFrame, min_cases: int = 0) -> DataFrame:
    return df.filter(F.col("total_cases") >= min_cases)


# --- diseases -------------------------------------------------------------


def _resource_sums(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum(or_zero(F.col("total_cases"))).alias("total_cases"),
        F.sum(or_zero(F.col("total_treatment_spend"))).cast(MONEY).alias("total_treatment_spend"),
        F.sum(or_zero(F.col("total_bed_days"))).alias("total_bed_days"),
    )


def disease_totals(resources: DataFrame) -> DataFrame:
    labelled = resources.withColumn("disease_name", _disease_label())
    return _resource_sums(labelled, "disease_name").orderBy(
        F.col("total_treatment_spend").desc(), "disease_name"
    )


def choose_columns(df: DataFrame, visible: Sequence[str], known: Sequence[str]) -> DataFrame:
    """The visible columns in table order; at least one must be kept."""
    unknown = set(visible) - set(known)
    if unknown or not visible:
        raise ValueError(f"choose one or more of {list(known)}, not {sorted(unknown)}")
    return df.select(*[c for c in known if c in visible])


def _disease_months(resources: DataFrame) -> DataFrame:
    labelled = _label(resources).withColumn("disease_name", _disease_label())
    return _resource_sums(labelled, "month_label", "disease_name")


def disease_monthly(resources: DataFrame) -> DataFrame:
    return _disease_months(resources).orderBy("month_label", "disease_name")


def cases_by_month(resources: DataFrame, disease: str | None = None) -> DataFrame:
    return (
        only_known(_disease_months(resources), "disease_name", disease)
        .groupBy("month_label")
        .agg(F.sum("total_cases").alias("total_cases"))
        .orderBy("month_label")
    )


def top_diseases_by_spend(resources: DataFrame) -> DataFrame:
    return (
        disease_totals(resources)
        .select("disease_name", "total_treatment_spend", "total_cases")
        .orderBy(F.col("total_treatment_spend").desc(), "disease_name")
        .limit(TOP_DISEASES)
    )


# --- doctors --------------------------------------------------------------

BEST_FIRST = ("recovery_rate_pct desc", "readmission_rate_pct asc", "total_cases desc")
WORST_FIRST = ("recovery_rate_pct asc", "readmission_rate_pct desc", "total_cases desc")


def _order(keys: Sequence[str]) -> list[Column]:
    return [F.expr(k.split()[0]).desc() if k.endswith("desc") else F.expr(k.split()[0]) for k in keys]


def filter_ranking(ranking: DataFrame, specialization: str | None = None, min_cases: int = 0):
    kept = at_least(only(ranking, "specialization", specialization), min_cases)
    return kept.orderBy(*_order(BEST_FIRST), "doctor_id")


def top_doctors(ranking: DataFrame, specialization: str | None = None, min_cases: int = 0):
    return (
        filter_ranking(ranking, specialization, min_cases)
        .limit(TOP_DOCTORS)
        .select(
            F.concat(F.lit("Dr "), F.col("doctor_id").cast("string")).alias("doctor_label"),
            "recovery_rate_pct",
            "readmission_rate_pct",
            "total_cases",
        )
    )


def doctor_extremes(ranking: DataFrame) -> DataFrame:
    """Best and worst doctor with their sentences."""
    recovery, readmission = F.col("recovery_rate_pct"), F.col("readmission_rate_pct")

    def one(keys: Sequence[str], insight: str, sentence: Column) -> DataFrame:
        return (
            ranking.orderBy(*_order(keys), "doctor_id")
            .limit(1)
            .select(
                F.lit(insight).alias("insight"),
                "doctor_id",
                "recovery_rate_pct",
                "readmission_rate_pct",
                "total_cases",
                sentence.alias("sentence"),
            )
        )

    # Wording of the two sentences.
    best = F.concat(
        F.lit("Dr. "), F.col("doctor_id").cast("string"), F.lit(" has highest recovery ("),
        recovery.cast("string"), F.lit("%) with "), readmission_severity(readmission),
        F.lit(" readmissions ("), readmission.cast("string"), F.lit("%)."),
    )
    worst = F.concat(
        F.lit("Dr. "), F.col("doctor_id").cast("string"), F.lit(" needs attention with recovery "),
        recovery.cast("string"), F.lit("% and readmission "), readmission.cast("string"), F.lit("%."),
    )
    return one(BEST_FIRST, "top performer", best).unionByName(
        one(WORST_FIRST, "needs attention", worst)
    )


def filter_doctor_months(monthly: DataFrame, specialization: str | None = None, min_cases: int = 0):
    """Month table; doctor ids are ordered as text within a month."""
    kept = at_least(only(monthly, "specialization", specialization), min_cases)
    return kept.orderBy("month_label", F.col("doctor_id").cast("string"))


def doctor_trend(
    ranking: DataFrame,
    monthly: DataFrame,
    requested: int | None = None,
    specialization: str | None = None,
    min_cases: int = 0,
) -> DataFrame:
    """Months of one doctor: the requested one if it has data, else the best
    ranked with data, else the first with data."""
    with_data = monthly.select("doctor_id").distinct()
    ranked = at_least(only(ranking, "specialization", specialization), min_cases)
    candidates = (
        ranked.join(with_data, "doctor_id", "left_semi")
        .orderBy(*_order(BEST_FIRST), "doctor_id")
        .limit(1)
        .select("doctor_id", F.lit(1).alias("choice"))
        .unionByName(
            with_data.orderBy("doctor_id").limit(1).select("doctor_id", F.lit(2).alias("choice"))
        )
    )
    if requested is not None:
        candidates = candidates.unionByName(
            with_data.filter(F.col("doctor_id") == requested).select(
                "doctor_id", F.lit(0).alias("choice")
            )
        )
    chosen = candidates.orderBy("choice").limit(1).select("doctor_id")
    return monthly.join(chosen, "doctor_id", "left_semi").orderBy("month_label")


# --- wards ----------------------------------------------------------------


def _ward_rows(utilization: DataFrame, ward_type: str | None, band: str | None) -> DataFrame:
    labelled = _label(only(utilization, "ward_type", ward_type))
    return only(labelled, "utilization_band", band)


def ward_months(utilization: DataFrame, ward_type: str | None = None, band: str | None = None):
    """Ward and month rows with labels, filtered by type and by the month's band."""
    return _ward_rows(utilization, ward_type, band).orderBy(
        F.col("utilization_pct").desc(), "ward_name", "month_label"
    )


def ward_summary(utilization: DataFrame, ward_type: str | None = None, band: str | None = None):
    """One row per ward; the band is that of its mean monthly utilization."""
    rate = or_zero(F.col("utilization_pct"))
    grouped = (
        _label(only(utilization, "ward_type", ward_type))
        .groupBy("ward_id", "ward_name", "ward_type")
        .agg(
            F.max("capacity").alias("capacity"),
            F.count_distinct("month_label").alias("months_tracked"),
            F.sum("month_occupied_bed_days").alias("total_occupied_bed_days"),
            F.sum(rate).alias("_rates"),
            F.count("*").alias("_rows"),
            F.max(rate).alias("peak_utilization_pct"),
        )
    )
    summary = grouped.select(
        "ward_id",
        "ward_name",
        "ward_type",
        "capacity",
        "months_tracked",
        "total_occupied_bed_days",
        exact_ratio("_rates", "_rows").alias("avg_utilization_pct"),
        "peak_utilization_pct",
        utilization_band(F.col("_rates"), F.col("_rows")).alias("avg_utilization_band"),
    )
    return only(summary, "avg_utilization_band", band).orderBy(
        F.col("avg_utilization_pct").desc(), "ward_name"
    )


def ward_heatmap(utilization: DataFrame, ward_type: str | None = None, band: str | None = None):
    """Mean utilization per ward and month, one row per cell."""
    return (
        _ward_rows(utilization, ward_type, band)
        .groupBy("ward_id", "ward_name", "month_label")
        .agg(
            exact_ratio("sum(coalesce(utilization_pct, 0))", "count(*)").alias("utilization_pct")
        )
    )


def months_of(cells: DataFrame) -> list[str]:
    """Months that occur, in order: at most those of the calendar."""
    return sorted(r[0] for r in cells.select("month_label").distinct().collect())


def ward_heatmap_matrix(cells: DataFrame, months: Sequence[str] | None = None) -> DataFrame:
    """Wards by the months that occur, or by those named; a cell without data is NULL."""
    months = months_of(cells) if months is None else months
    return (
        cells.groupBy("ward_id", "ward_name")
        .pivot("month_label", list(months))
        .agg(F.max("utilization_pct"))
        .orderBy("ward_name")
    )


def ward_kpis(utilization: DataFrame, ward_type: str | None = None, band: str | None = None):
    """One row: mean of all month rates, most and least used ward, beds (each
    ward once, at its latest capacity) and bed days."""
    rows = _ward_rows(utilization, ward_type, band)
    rate = or_zero(F.col("utilization_pct"))
    per_ward = rows.groupBy("ward_id", "ward_name").agg(
        F.sum(rate).alias("rates"),
        F.count("*").alias("n"),
        F.max_by("capacity", "month_label").alias("capacity"),
        F.sum("month_occupied_bed_days").alias("bed_days"),
        F.min(F.struct("month_label", -rate, F.col("ward_id"))).alias("first"),
    )
    mean = exact_ratio("rates", "n")
    exact_mean = F.col("rates").cast("decimal(24,2)") / F.col("n").cast("decimal(12,0)")
    ward = F.struct(F.col("ward_name"), mean.alias("mean"))
    # equal wards: the one that comes first in the rows of the utilization report
    return per_ward.agg(
        exact_ratio("sum(rates)", "sum(n)").alias("avg_utilization_pct"),
        F.min_by(ward, F.struct(-exact_mean, F.col("first"))).alias("most"),
        F.min_by(ward, F.struct(exact_mean, F.col("first"))).alias("least"),
        F.sum(F.col("capacity").cast("bigint")).alias("total_capacity_beds"),
        F.sum("bed_days").alias("total_used_bed_days"),
    ).select(
        "avg_utilization_pct",
        F.col("most.ward_name").alias("most_utilized_ward"),
        F.col("most.mean").alias("most_utilized_pct"),
        F.col("least.ward_name").alias("least_utilized_ward"),
        F.col("least.mean").alias("least_utilized_pct"),
        or_zero(F.col("total_capacity_beds")).alias("total_capacity_beds"),
        or_zero(F.col("total_used_bed_days")).alias("total_used_bed_days"),
    )


# --- readmission ----------------------------------------------------------


def _stored_or_derived(rate: str, part: str) -> Column:
    """A missing rate is worked out from the counts; no cases give zero. It is not
    rounded, as its band is that of the exact rate: it is cut after ten decimals, which
    keeps it on its side of every bound."""
    exact = f"(CAST(100 * {part} AS DECIMAL(28,0)) * 10000000000) div nullif(total_cases, 0)"
    derived = F.expr(f"CAST({exact} AS DECIMAL(28,0)) * 0.0000000001BD").cast(EXACT_RATE)
    return F.coalesce(F.col(rate).cast(EXACT_RATE), derived, F.lit(0).cast(EXACT_RATE))


def readmission_months(monthly: DataFrame) -> DataFrame:
    return monthly.select(
        "month_label",
        _disease_label().alias("disease_name"),
        *[or_zero(F.col(c)).alias(c) for c in ("total_cases", "readmitted_cases", "recovered_cases")],
        _stored_or_derived("readmission_rate_pct", "readmitted_cases").alias("readmission_rate_pct"),
        _stored_or_derived("recovery_rate_pct", "recovered_cases").alias("recovery_rate_pct"),
    )


def with_severity(df: DataFrame) -> DataFrame:
    return df.withColumn("severity", readmission_severity(F.col("readmission_rate_pct")))


def filter_risk(df: DataFrame, risk: str | None = None, min_cases: int = 0) -> DataFrame:
    return only(with_severity(at_least(df, min_cases)), "severity", risk)


def readmitted_by_month(monthly: DataFrame, disease: str | None = None) -> DataFrame:
    return (
        only_known(readmission_months(monthly), "disease_name", disease)
        .groupBy("month_label")
        .agg(F.sum("readmitted_cases").alias("readmitted_cases"))
        .orderBy("month_label")
    )


# Order of the rows that lists and extremes are taken from; it decides between equals.
BURDEN_FIRST = ("readmission_rate_pct desc", "total_cases desc", "disease_name asc")


def readmission_kpis(by_disease: DataFrame) -> DataFrame:
    """One row: ratio of sums, the worst disease by either rate, and the count."""
    burden = [-F.col("readmission_rate_pct"), -F.col("total_cases"), F.col("disease_name")]
    return by_disease.agg(
        percentage("sum(readmitted_cases)", "sum(total_cases)").alias("avg_readmission_rate_pct"),
        F.min_by(
            F.struct("disease_name", "readmission_rate_pct"),
            F.struct(*burden),
        ).alias("risk"),
        F.min_by(
            F.struct("disease_name", "recovery_rate_pct"),
            F.struct(F.col("recovery_rate_pct"), *burden),
        ).alias("recovery"),
        F.count("*").alias("disease_count"),
    ).select(
        "avg_readmission_rate_pct",
        F.col("risk.disease_name").alias("highest_risk_disease"),
        F.col("risk.readmission_rate_pct").alias("highest_risk_pct"),
        F.col("recovery.disease_name").alias("lowest_recovery_disease"),
        F.col("recovery.recovery_rate_pct").alias("lowest_recovery_pct"),
        "disease_count",
    )


def top_diseases_by_cases(by_disease: DataFrame) -> DataFrame:
    return (
        by_disease.orderBy(F.col("total_cases").desc(), *_order(BURDEN_FIRST))
        .limit(TOP_OUTCOMES)
        .select("disease_name", "total_cases", "readmitted_cases", "recovered_cases")
    )


def readmission_share(by_disease: DataFrame) -> DataFrame:
    """Largest shares of all readmissions; the total is that of the whole set,
    taken before the list is cut."""
    total = by_disease.agg(F.sum("readmitted_cases").alias("total")).scalar()
    return (
        by_disease.filter(F.col("readmitted_cases") > 0)
        .withColumn("_total", total)
        .orderBy(F.col("readmitted_cases").desc(), *_order(BURDEN_FIRST))
        .limit(TOP_SHARES)
        .select(
            "disease_name",
            "readmitted_cases",
            percentage("readmitted_cases", "_total").alias("readmission_share_pct"),
        )
    )


# --- filter options -------------------------------------------------------


def filter_options(
    ranking: DataFrame, utilization: DataFrame, resources: DataFrame, readmissions: DataFrame
) -> DataFrame:
    """Distinct values of every category filter, blanks left out."""
    sources = [
        ("specialization", ranking, "specialization"),
        ("ward_type", utilization, "ward_type"),
        ("disease", _disease_months(resources), "disease_name"),
        ("readmission_disease", readmission_months(readmissions), "disease_name"),
    ]
    options = None
    for name, df, column in sources:
        part = (
            df.filter(F.coalesce(F.col(column), F.lit("")) != "")
            .select(F.lit(name).alias("filter_name"), F.col(column).alias("option"))
            .distinct()
        )
        options = part if options is None else options.unionByName(part)
    return options.orderBy("filter_name", "option")
