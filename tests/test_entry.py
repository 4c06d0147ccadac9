from __future__ import annotations

import pytest
from check_oracle import connect, difference

import __spark_entry__ as app
from clinimart.plans import fact
from clinimart.plans.warehouse import keyed_groups

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_query_has_reference_sql():
    assert set(app.QUERIES) <= set(app.oracle_sql())


@pytest.mark.parametrize("name", list(app.QUERIES))
def test_query_equals_reference_sql(spark, db, name):
    assert difference(spark, db, SF_DIR, name) is None


@pytest.mark.parametrize("name", list(app.QUERIES))
def test_plan_has_no_nested_loop(spark, name):
    plan = app.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry_gives_rows(spark):
    assert app.entry(spark).count() > 0


LARGE = [
    "raw_extract", "visit_stay_range_join", "visit_treatment_cost", "fact_labelled_sample", "disease_trend",
    "doctor_ranking", "ward_utilization", "cost_trend", "readmission_by_disease", "overview_window",
    "overview_window_sql", "doctor_monthly_ops", "doctor_performance_view", "dq_orphans",
    "dq_warehouse_orphans", "dq_duplicate_keys", "dedup_append", "ward_current_occupancy", "admission_control",
]


@pytest.fixture
def no_broadcast(spark):
    """As with tables beyond the broadcast threshold, planned without run-time changes."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("name", LARGE)
def test_plan_without_broadcast_shuffles_by_key(spark, no_broadcast, name):
    plan = app.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in ("NestedLoop", "Cartesian", "Broadcast") if word in plan]


def test_load_without_broadcast(spark, no_broadcast):
    site = app.Site.of(spark, SF_DIR)
    groups = fact.treatment_groups(*[site.table(name) for name in app.EXTRACT])
    plan = keyed_groups(groups, site.wh)._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in ("NestedLoop", "Cartesian", "Broadcast") if word in plan]
    # by visit only the costs move, as the price list meets the treatments by medicine
    assert plan.count("Exchange hashpartitioning(visit_id") == 1
