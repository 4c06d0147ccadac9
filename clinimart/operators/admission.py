"""Bed occupancy and admission of a batch of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import or_zero
from .ordering import number_in_order

# Messages of a rejected request.
WARD_FULL = "Ward is at full capacity. Cannot admit patient."
WARD_UNKNOWN = "Ward does not exist. Cannot admit patient."


def ward_occupancy(ward: DataFrame, bed_allocation: DataFrame) -> DataFrame:
    """Open allocations per ward against its capacity."""
    taken = (
        bed_allocation.filter(F.col("discharge_date").isNull())
        .groupBy("ward_id")
        .agg(F.count("*").alias("occupied"))
    )
    return ward.join(taken, "ward_id", "left").select(
        "ward_id",
        "ward_name",
        "capacity",
        or_zero(F.col("occupied")).alias("current_occupancy"),
        (or_zero(F.col("occupied")) >= F.col("capacity")).alias("is_full"),
    )


def admission_decisions(
    requests: DataFrame, ward: DataFrame, bed_allocation: DataFrame
) -> DataFrame:
    """Decide all requests of a batch in the order of each ward's queue.

    A request is accepted while the ward's occupancy plus its place in the queue
    stays within capacity; this is what one call after the other would decide,
    as a full ward stays full within the batch. Queues are numbered over ranges of
    (ward, day, request), so a crowded ward is neither sorted nor listed in one task.
    """
    queued = number_in_order(
        requests, ["request_date", "request_id"], "queue_position", within=["ward_id"]
    )
    wards = ward_occupancy(ward, bed_allocation).select("ward_id", "capacity", "current_occupancy")
    fits = F.col("current_occupancy") + F.col("queue_position") <= F.col("capacity")
    return queued.join(wards, "ward_id", "left").select(
        *requests.columns,
        "queue_position",
        F.coalesce(fits, F.lit(False)).alias("accepted"),
        F.when(F.col("capacity").isNull(), WARD_UNKNOWN).when(~fits, WARD_FULL).alias("reason"),
    )


def _numbered(accepted: DataFrame, after: DataFrame, key: str) -> DataFrame:
    last = after.agg(or_zero(F.max(key)).alias("last")).scalar()
    numbered = number_in_order(accepted, ["request_id"], "_number")
    return numbered.withColumn(key, F.col("_number") + last)


def admitted_visits(decisions: DataFrame, visit: DataFrame) -> DataFrame:
    """Visits that the accepted requests create, numbered after existing ones."""
    return _numbered(decisions.filter("accepted"), visit, "visit_id").select(
        "visit_id",
        "patient_id",
        "doctor_id",
        F.col("request_date").alias("visit_date"),
        "visit_type",
        "request_id",
    )


def admitted_allocations(decisions: DataFrame, bed_allocation: DataFrame) -> DataFrame:
    """Open bed allocations that the accepted requests create."""
    return _numbered(decisions.filter("accepted"), bed_allocation, "allocation_id").select(
        "allocation_id",
        "patient_id",
        "ward_id",
        F.col("request_date").alias("admit_date"),
        F.lit(None).cast("date").alias("discharge_date"),
        F.lit(None).cast("int").alias("days_stayed"),
        "request_id",
    )


def rejected_requests(decisions: DataFrame) -> DataFrame:
    return decisions.filter(~F.col("accepted")).select(
        "request_id", "patient_id", "ward_id", "request_date", "reason"
    )
