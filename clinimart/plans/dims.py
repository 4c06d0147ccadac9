"""Dimension tables and their surrogate keys."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bands import experience_band
from ..functions.dates import as_date, date_id
from ..operators.ordering import number_in_order
from ..schemas import OUTCOME_LABELS


def dim_date(spark: SparkSession, start: str | dt.date, end: str | dt.date) -> DataFrame:
    """One row per calendar day, both bounds included. The dimension is bounded
    by the calendar (366 rows a year), whatever the size of the fact."""
    first, last = F.lit(as_date(start)), F.lit(as_date(end))
    day = F.col("full_date")
    return (
        spark.range(1)
        .select(F.explode(F.sequence(first, last)).alias("full_date"))
        .select(
            date_id(day).alias("date_id"),
            day,
            F.date_format(day, "EEEE").alias("day_of_week"),
            F.dayofmonth(day).alias("day_num"),
            F.month(day).alias("month_num"),
            F.date_format(day, "MMMM").alias("month_name"),
            F.quarter(day).alias("quarter"),
            F.year(day).alias("year_num"),
        )
    )


def with_surrogate(
    members: DataFrame,
    natural_key: str,
    surrogate: str,
    previous: DataFrame | None = None,
    kind: str = "int",
) -> DataFrame:
    """Sequential keys in natural-key order.

    With ``previous`` (the dimension of the last load) known members keep their
    key and take the incoming attributes, members that left the source stay as
    they were, and new ones continue the sequence, so a rerun changes nothing.
    """
    attributes = [c for c in members.columns if c != natural_key]
    order = [surrogate, natural_key, *attributes]
    if previous is None:
        numbered = number_in_order(members, [natural_key], surrogate)
        return numbered.withColumn(surrogate, F.col(surrogate).cast(kind)).select(*order)
    known = previous.select(*order).alias("p").join(
        members.withColumn("_present", F.lit(True)).alias("m"), natural_key, "left"
    )
    kept = known.select(
        surrogate,
        natural_key,
        *[
            F.when(F.col("_present"), F.col(f"m.{c}")).otherwise(F.col(f"p.{c}")).alias(c)
            for c in attributes
        ],
    )
    fresh = members.join(previous.select(natural_key), natural_key, "left_anti")
    last = previous.agg(F.coalesce(F.max(surrogate), F.lit(0)).alias("last")).scalar()
    added = number_in_order(fresh, [natural_key], surrogate).withColumn(
        surrogate, (F.col(surrogate) + last).cast(kind)
    )
    return kept.unionByName(added.select(*order))


def dim_disease(disease: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    members = disease.select("disease_code", "disease_name", "category", "severity_tier")
    return with_surrogate(members, "disease_code", "disease_sk", previous)


def dim_doctor(doctor: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    members = doctor.select(
        "doctor_id",
        "specialization",
        experience_band(F.col("experience_years")).alias("experience_band"),
        "department",
    )
    return with_surrogate(members, "doctor_id", "doctor_sk", previous, "bigint")


def dim_ward(ward: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    members = ward.select("ward_id", "ward_name", "ward_type", "capacity")
    return with_surrogate(members, "ward_id", "ward_sk", previous)


def dim_outcome(spark: SparkSession) -> DataFrame:
    """The four outcome labels, numbered in their declared order."""
    labels = F.array(*[F.lit(label) for label in OUTCOME_LABELS])
    return (
        spark.range(1)
        .select(F.posexplode(labels).alias("position", "outcome_label"))
        .select((F.col("position") + 1).alias("outcome_sk"), "outcome_label")
    )
