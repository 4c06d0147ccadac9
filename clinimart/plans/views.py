"""Warehouse and operational data by SQL: registered views and stored statements.

``register`` puts the tables of a load, the operational tables and the doctor view in
the session's catalog of temporary views, under a prefix, so that several loads can be
open side by side. Statements name views as ``{view}`` and take their bounds as named
parameters; values are bound by Spark and never put into the text.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from ..functions.dates import DEFAULT_FROM, DEFAULT_TO, as_date
from ..functions.numbers import MONEY, ratio_sql
from ..schemas import OPERATIONAL, WAREHOUSE
from . import reports
from .warehouse import Tables, Warehouse

DOCTOR_VIEW = "doctor_performance"

# A window by calendar day, put on the fact's partition and key as well.
_WINDOW = """d.full_date BETWEEN :date_from AND :date_to
  AND f.year_num BETWEEN year(:date_from) AND year(:date_to)
  AND f.date_id BETWEEN int(date_format(:date_from, 'yyyyMMdd')) AND int(date_format(:date_to, 'yyyyMMdd'))"""


def _percent(part: str) -> str:
    return f"CAST({ratio_sql(f'100 * CAST({part} AS DECIMAL(26,4))', 'total_cases')} AS DECIMAL(18,2))"


STATEMENTS = {
    "overview": f"""
SELECT total_cases, readmitted_cases, recovered_cases,
  coalesce(CAST({ratio_sql("cost", "costed")} AS DECIMAL(18,2)), 0.00) AS avg_treatment_cost,
  total_bed_days,
  {_percent("recovered_cases")} AS recovery_rate_pct,
  {_percent("readmitted_cases")} AS readmission_rate_pct
FROM (
  SELECT coalesce(sum(total_cases), 0) AS total_cases,
    coalesce(sum(readmitted_cases), 0) AS readmitted_cases,
    coalesce(sum(recovered_cases), 0) AS recovered_cases,
    coalesce(sum(total_bed_days), 0) AS total_bed_days,
    sum(avg_treatment_cost) AS cost, count(avg_treatment_cost) AS costed
  FROM {{fact_treatment}} f JOIN {{dim_date}} d ON f.date_id = d.date_id
  WHERE {_WINDOW})""",
    "disease_resources": f"""
SELECT year_num, month_num, disease_name, sum(cases) AS total_cases,
  sum(bed_days) AS total_bed_days, CAST(sum(spend) AS {MONEY}) AS total_treatment_spend
FROM (
  SELECT d.year_num, d.month_num, f.disease_sk, sum(f.total_cases) AS cases,
    sum(coalesce(f.total_bed_days, 0)) AS bed_days,
    sum(CAST(coalesce(f.avg_treatment_cost, 0) * f.total_cases AS DECIMAL(18,2))) AS spend
  FROM {{fact_treatment}} f JOIN {{dim_date}} d ON f.date_id = d.date_id
  WHERE {_WINDOW}
  GROUP BY d.year_num, d.month_num, f.disease_sk)
JOIN {{dim_disease}} USING (disease_sk)
GROUP BY year_num, month_num, disease_name""",
    "doctors_by_specialization": f"""
SELECT * FROM {{{DOCTOR_VIEW}}}
WHERE specialization = :specialization AND total_visits >= :min_visits""",
}


def register(spark: SparkSession, wh: Warehouse, table: Tables, prefix: str) -> dict[str, str]:
    """Register all views; returns the name of each in the catalog."""
    views: dict[str, DataFrame] = {name: table(name) for name in OPERATIONAL if name != "alert_log"}
    views |= {name: wh.dimension(name) for name in WAREHOUSE if name != "fact_treatment"}
    views["fact_treatment"] = wh.fact
    views[DOCTOR_VIEW] = reports.doctor_performance_view(
        *[table(name) for name in ("doctor", "visit", "bed_allocation", "outcome")]
    )
    names = {name: f"{prefix}_{name}" for name in views}
    for name, df in views.items():
        df.createOrReplaceTempView(names[name])
    return names


def window(
    date_from: str | dt.date | None = None,
    date_to: str | dt.date | None = None,
    default: tuple[str, str] = (DEFAULT_FROM, DEFAULT_TO),
) -> dict[str, dt.date]:
    """Bounds of a statement; a missing or empty one takes its default."""
    return {"date_from": as_date(date_from or default[0]), "date_to": as_date(date_to or default[1])}


def run(spark: SparkSession, names: dict[str, str], statement: str, **values) -> DataFrame:
    """A stored statement over registered views with its parameters bound."""
    return spark.sql(STATEMENTS[statement].format(**names), args=values)
