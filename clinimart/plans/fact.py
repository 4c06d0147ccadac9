"""Extract and treatment fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_id
from ..functions.numbers import exact_ratio
from ..operators.stays import expand_copies, visit_stay_lists, visit_stays

GRAIN = ["visit_date", "disease_code", "doctor_id", "ward_id"]
DOCTOR_KEYS = "doctor_sks"
# A key of the list and its place there, which tells apart keys that are repeated.
DOCTOR_KEY = ["_doctor_place", "doctor_sk"]
# Visits whose groups one task sums at most, and tasks for fewer visits.
VISITS_PER_TASK = 100_000
LEAST_TASKS, FEW_VISITS = 8, 5_000
# Diagnoses of these visits at most: what a task holds grows with them and their wards.
DIAGNOSES_PER_TASK = 100_000


def visit_treatment_cost(treatment: DataFrame, medicine: DataFrame) -> DataFrame:
    """Cost per visit: dosage times unit cost over its treatments. The duration
    of a treatment does not enter."""
    cost = F.col("dosage_mg") * F.col("unit_cost")
    return (
        treatment.select("visit_id", "medicine_id", "dosage_mg")
        .join(medicine.select("medicine_id", "unit_cost"), "medicine_id")
        .groupBy("visit_id")
        .agg(F.sum(cost).cast("decimal(22,4)").alias("treatment_cost"))
    )


def _visit_rows(
    visit: DataFrame,
    diagnosis: DataFrame,
    outcome: DataFrame,
    treatment: DataFrame,
    medicine: DataFrame,
) -> DataFrame:
    """A row per visit and diagnosis with all that is keyed by the visit. Everything is
    joined on that key before the stays are, so tables bucketed by it are not shuffled."""
    status = outcome.select("visit_id", F.col("status").alias("outcome_status"))
    return (
        visit.select("visit_id", "patient_id", "doctor_id", "visit_date")
        .join(diagnosis.select("visit_id", "disease_code"), "visit_id")
        .join(status, "visit_id", "left")
        .join(visit_treatment_cost(treatment, medicine), "visit_id", "left")
    )


def raw_extract(
    visit: DataFrame,
    diagnosis: DataFrame,
    outcome: DataFrame,
    bed_allocation: DataFrame,
    treatment: DataFrame,
    medicine: DataFrame,
) -> DataFrame:
    """Row-level extract: one row per visit, diagnosis and bed allocation
    admitted on or before the visit. The fan-out is part of its definition; the
    fact load below gives the same totals without it."""
    rows = _visit_rows(visit, diagnosis, outcome, treatment, medicine)
    stays = visit_stays(rows, bed_allocation, split=("ward_id", "days_stayed"), visits=visit)
    compact = stays.select(
        "visit_id",
        "visit_date",
        "doctor_id",
        "disease_code",
        "outcome_status",
        "days_stayed",
        "ward_id",
        "treatment_cost",
        "copies",
    )
    return expand_copies(compact)


def _visits(
    visit: DataFrame,
    diagnosis: DataFrame,
    outcome: DataFrame,
    treatment: DataFrame,
    medicine: DataFrame,
) -> DataFrame:
    """The same with a row per visit: its ``diseases`` are a list with how often each was
    recorded, no longer than there are diseases."""
    recorded = (
        diagnosis.filter(F.col("visit_id").isNotNull())
        .groupBy("visit_id", "disease_code")
        .agg(F.count("*").alias("times"))
        .groupBy("visit_id")
        .agg(F.collect_list(F.struct("disease_code", "times")).alias("diseases"))
    )
    status = outcome.select("visit_id", F.col("status").alias("outcome_status"))
    return (
        visit.select("visit_id", "patient_id", "doctor_id", "visit_date")
        .join(recorded, "visit_id")
        .join(status, "visit_id", "left")
        .join(visit_treatment_cost(treatment, medicine), "visit_id", "left")
    )


def with_doctor_keys(visits: DataFrame, doctors: DataFrame) -> DataFrame:
    """Visits with the surrogate keys of their doctor as a list, so that a visit stays one
    row; NULL for an unknown doctor. The list has one order, so that a repeated task sees
    a key in the same place."""
    listed = F.sort_array(F.collect_list("doctor_sk"))
    keys = doctors.groupBy("doctor_id").agg(listed.alias(DOCTOR_KEYS))
    return visits.join(keys, "doctor_id", "left")


def group_tasks(visits: int) -> int:
    """Tasks that sum the groups, so that one has about as many whatever the size."""
    return max(1, -(-visits // VISITS_PER_TASK), min(LEAST_TASKS, -(-visits // FEW_VISITS)))


def summing_tasks(visits: int, diagnoses: int) -> int:
    """The same, more where visits have many diagnoses."""
    return max(group_tasks(visits), -(-diagnoses // DIAGNOSES_PER_TASK))


def treatment_groups(
    visit: DataFrame,
    diagnosis: DataFrame,
    outcome: DataFrame,
    bed_allocation: DataFrame,
    treatment: DataFrame,
    medicine: DataFrame,
    doctors: DataFrame | None = None,
) -> DataFrame:
    """Measures per date, disease, doctor and ward (NULL ward is one group).

    Cases count joined rows. Averages and bed days are NULL when nothing was
    observed. ``treatment_cost`` repeats on every joined row of a visit, so it
    is weighted with the number of copies.

    Visits move with lists of their diseases and stays, and by day and doctor, which
    every group has one of. They are written out as rows only where their groups are
    summed, so neither these rows nor the groups are shuffled; in order of the day,
    which the files keep and so get smaller. With ``doctors``, the
    dimension, a visit also takes along the keys of its doctor, and groups come with
    ``doctor_sk``: doctors grow with the visits, and a list of them too large to
    broadcast would move all groups. A visit is repeated for these keys, of which there
    is one as a rule, before it becomes rows: groups, ten times as many, are not copied
    once more for it.
    """
    visits = _visits(visit, diagnosis, outcome, treatment, medicine)
    grain = GRAIN
    if doctors is not None:
        visits, grain = with_doctor_keys(visits, doctors), [*GRAIN, *DOCTOR_KEY]
    tasks = summing_tasks(visit.count(), diagnosis.count())
    placed = (
        visit_stay_lists(visits, bed_allocation, visit)
        .repartition(tasks, "visit_date", "doctor_id")
        .sortWithinPartitions("visit_date")
    )
    if doctors is not None:
        others = [c for c in placed.columns if c != DOCTOR_KEYS]
        placed = placed.select(*others, F.posexplode_outer(DOCTOR_KEYS).alias(*DOCTOR_KEY))
    kept = [*[c for c in grain if c in placed.columns], "outcome_status", "treatment_cost"]
    rows = (
        placed.select(*kept, "stay_list", F.inline("diseases"))
        .select(*kept, "disease_code", "times", F.inline_outer("stay_list"))
        .withColumn("copies", F.coalesce("stays", F.lit(1).cast("bigint")) * F.col("times"))
    )
    copies, cost = F.col("copies"), F.col("treatment_cost")

    def cases_with(status: str):
        return F.sum(F.when(F.col("outcome_status") == status, copies).otherwise(0))

    return (
        rows.groupBy(*grain)
        .agg(
            F.sum(copies).alias("total_cases"),
            cases_with("Recovered").alias("recovered_cases"),
            cases_with("Readmitted").alias("readmitted_cases"),
            F.sum(F.col("stay_days") * F.col("times")).alias("total_bed_days"),
            F.sum(F.col("known_stays") * F.col("times")).alias("_known"),
            F.sum((cost * copies).cast("decimal(28,4)")).alias("_cost"),
            F.sum(F.when(cost.isNotNull(), copies)).alias("_costed"),
        )
        .select(
            *GRAIN,
            "total_cases",
            "recovered_cases",
            "readmitted_cases",
            exact_ratio("total_bed_days", "_known")
            .cast("decimal(6,2)")
            .alias("avg_recovery_days"),
            exact_ratio("_cost", "_costed")
            .cast("decimal(10,2)")
            .alias("avg_treatment_cost"),
            "total_bed_days",
            *[c for c in grain if c == "doctor_sk"],
        )
    )


def grain_key() -> Column:
    """Identifier of a fact row: a hash of its grain, the same in every load. A row
    without ward has a marker in its place; duplicates are looked for by the quality
    checks."""
    grain = ["visit_date", "disease_code", "doctor_id", F.coalesce("ward_id", F.lit(-1))]
    return F.xxhash64(*grain)


def with_surrogates(
    groups: DataFrame,
    dates: DataFrame,
    diseases: DataFrame,
    doctors: DataFrame,
    wards: DataFrame,
) -> DataFrame:
    """Look up all keys and state why a group cannot be loaded. Groups that come with
    their ``doctor_sk`` are not looked up by doctor again.

    An unknown disease, doctor or date is a reason to skip; an unknown ward is
    not, its key stays NULL. No hint is given: Spark broadcasts a dimension only
    while its measured size is under ``spark.sql.autoBroadcastJoinThreshold``
    and joins by shuffle beyond it.
    """
    known_dates = dates.select(F.col("date_id"), F.lit(True).alias("_in_calendar"))
    if "doctor_sk" not in groups.columns:
        groups = groups.join(doctors.select("doctor_id", "doctor_sk"), "doctor_id", "left")
    return (
        groups.withColumn("date_id", date_id(F.col("visit_date")))
        .join(diseases.select("disease_code", "disease_sk"), "disease_code", "left")
        .join(wards.select("ward_id", "ward_sk"), "ward_id", "left")
        .join(known_dates, "date_id", "left")
        .withColumn(
            "skip_reason",
            F.when(F.col("disease_sk").isNull(), "unknown disease")
            .when(F.col("doctor_sk").isNull(), "unknown doctor")
            .when(F.col("_in_calendar").isNull(), "date not in calendar"),
        )
        .drop("_in_calendar")
    )
