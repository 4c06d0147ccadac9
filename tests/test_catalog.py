from __future__ import annotations

import pytest

import __spark_entry__ as app
from clinimart.plans import fact, reports
from clinimart.sources import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def small_broadcasts(spark):
    """Only the medicine list is under the threshold, as at production size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "12k")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")


def lines(df, word):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if word in line]


def test_fact_load_does_not_shuffle_by_visit(spark, small_broadcasts):
    site = app.Site.of(spark, SF_DIR)
    groups = fact.treatment_groups(*[site.table(name) for name in app.EXTRACT])
    assert len(lines(groups, "SortMergeJoin [visit_id")) == 3
    exchanges = lines(groups, "Exchange hashpartitioning(")
    assert exchanges and not [line for line in exchanges if "hashpartitioning(visit_id" in line]
    assert not lines(groups, "NestedLoop")


def test_window_reads_its_years_only(spark, small_broadcasts):
    site = app.Site.of(spark, SF_DIR)
    report = reports.doctor_monthly_from_visits(
        site.table("visit"), site.table("outcome"), site.table("doctor"), "1997-03-01", "1998-12-31"
    )
    scan = next(line for line in lines(report, "FileScan") if ".visit[" in line)
    assert "visit_year" in scan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert not lines(report, "hashpartitioning(visit_id")


def test_bucket_counts():
    assert catalog.bucket_count(0) == catalog.bucket_count(1000) == catalog.LEAST_BUCKETS
    assert catalog.bucket_count(catalog.ROWS_PER_BUCKET * 20 + 1) == 21


def test_bucketed_table_holds_the_rows(spark, hospital, folder):
    h = hospital()
    name = catalog.write_bucketed(h.table("visit"), folder, "clinimart_test", "visit", 8)
    read = catalog.read_bucketed(spark, name, h.table("visit").columns)
    assert read.collect() == h.table("visit").collect()
    assert catalog.read_bucketed(spark, name).columns[-1] == "visit_year"
    spark.sql("DROP DATABASE clinimart_test CASCADE")
