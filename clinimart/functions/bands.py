"""Bands and severities: every threshold of the system in one place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band labels with their inclusive lower bounds, in order.
UTILIZATION_BANDS = [
    (90, "Critical Over-Utilization"),
    (75, "High Utilization"),
    (50, "Moderate Utilization"),
]
UTILIZATION_LOWEST = "Low Utilization"
SEVERITIES = [(25, "high"), (15, "moderate")]
SEVERITY_LOWEST = "low"
# Experience labels with their inclusive upper bounds in years.
EXPERIENCE_BANDS = [(5, "0-5 yrs"), (10, "6-10 yrs")]
EXPERIENCE_HIGHEST = "11+ yrs"
# Minimum cases in a report, and the stay length that alerts.
MIN_DOCTOR_CASES = 30
MIN_DISEASE_CASES = 25
LONG_STAY_DAYS = 14


def utilization_band(percent_sum: Column, weight: Column) -> Column:
    """Band of ``percent_sum / weight`` percent, compared without dividing so
    that a value just under a bound is not rounded into the band above. A zero
    weight has no utilization and falls in the lowest band."""
    chain = None
    for bound, label in UTILIZATION_BANDS:
        reached = (weight > 0) & (percent_sum >= weight * bound)
        chain = F.when(reached, label) if chain is None else chain.when(reached, label)
    return chain.otherwise(UTILIZATION_LOWEST)


def readmission_severity(rate: Column) -> Column:
    value = F.coalesce(rate, F.lit(0))
    chain = None
    for bound, label in SEVERITIES:
        chain = F.when(value >= bound, label) if chain is None else chain.when(value >= bound, label)
    return chain.otherwise(SEVERITY_LOWEST)


def experience_band(years: Column) -> Column:
    chain = None
    for bound, label in EXPERIENCE_BANDS:
        chain = F.when(years <= bound, label) if chain is None else chain.when(years <= bound, label)
    return chain.otherwise(EXPERIENCE_HIGHEST)
