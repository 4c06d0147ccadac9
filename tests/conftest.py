from __future__ import annotations

import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from clinimart.schemas import OPERATIONAL  # noqa: E402
from clinimart.sources.sample import with_days_stayed  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def many_ranges(spark):
    """Small tables in several ranges, as large ones are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


class Hospital:
    """A small operational database with sound defaults; tests override tables."""

    def __init__(self, spark: SparkSession, **rows):
        self.spark = spark
        self.rows = {
            "patient": [(1, "31-45", "F", None, None), (2, "18-30", "M", None, None)],
            "doctor": [(1, "Surgeon", 5, "Surgery"), (2, "Cardiologist", 11, "Cardiology")],
            "disease": [("A1", "Flu", "Respiratory", "Low"), ("B2", "Sepsis", "Infectious", "Critical")],
            "medicine": [(1, "Plain", None, Decimal("2.50")), (2, "Costly", None, Decimal("100.00"))],
            "ward": [(1, "ICU", "ICU", 10), (2, "General", "General", 2)],
            "visit": [(1, 1, 1, day("2022-03-10"), "IPD")],
            "diagnosis": [(1, "A1", "Mild")],
            "treatment": [(1, 1, Decimal("10.00"), 3)],
            "bed_allocation": [],
            "outcome": [(1, "Recovered", day("2022-03-20"))],
            **rows,
        }

    def table(self, name: str):
        schema = OPERATIONAL[name]
        if name == "bed_allocation":
            rows = [(*row, None) for row in self.rows[name]]
            return with_days_stayed(self.spark.createDataFrame(rows, schema))
        return self.spark.createDataFrame(self.rows[name], schema)

    def extract(self):
        names = ("visit", "diagnosis", "outcome", "bed_allocation", "treatment", "medicine")
        return [self.table(name) for name in names]


@pytest.fixture
def hospital(spark):
    return lambda **rows: Hospital(spark, **rows)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)
