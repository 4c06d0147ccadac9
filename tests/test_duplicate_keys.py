"""What the check of keys moves: no texts, no bucketed tables, large tables in turns."""

from __future__ import annotations

import time

import pytest

import __spark_entry__ as app
from clinimart.operators import quality
from clinimart.schemas import WAREHOUSE_KEYS
from clinimart.sources import storage

SF_DIR = "/root/testdata/sf0.001"


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_tables_bucketed_by_the_visit_are_not_shuffled(spark):
    site = app.Site.of(spark, SF_DIR)
    keys = {"visit": [["visit_id"]], "diagnosis": [["visit_id", "disease_code"]], "outcome": [["visit_id"]],
            "treatment": [["visit_id", "medicine_id", "duration_days"]]}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    lines = exchanges(quality.duplicate_keys(site.table, keys))
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert lines and not [line for line in lines if "visit_id" in line or "key" in line]


def test_keys_move_as_they_are(spark):
    rows = spark.createDataFrame([(1, 2)], "fact_id BIGINT, date_id INT")
    found = quality.duplicate_keys(lambda _: rows, {"t": [["fact_id"], ["date_id"]]})
    assert "cast(fact_id as string)" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("turn_bytes", [1 << 40, 300, 40])
def test_turns_count_every_key_once(spark, monkeypatch, turn_bytes):
    monkeypatch.setattr(quality, "TURN_BYTES", turn_bytes)
    one = [("1", 11), ("11", 1), (None, 11), ("-", 11), ("1:1", 1), (None, None), (None, None)]
    df = spark.createDataFrame(one, "a STRING, b INT")
    got = quality.duplicate_keys(lambda name: df.limit(0) if name == "none" else df, {
        "t": [["a", "b"], ["b"], ["a"]], "one": [["a", "b"]], "none": [["a"], ["b"]], "none one": [["b"]],
    }).collect()
    assert {(r.table_name, r.key_columns): tuple(r)[2:] for r in got} == {
        ("t", "a, b"): (7, 1, 1), ("t", "b"): (7, 3, 4), ("t", "a"): (7, 1, 2), ("one", "a, b"): (7, 1, 1),
        ("none", "a"): (0, 0, 0), ("none", "b"): (0, 0, 0), ("none one", "b"): (7, 3, 4),
    }


def test_a_load_leaves_no_shuffle_files(spark, tmp_path):
    before = shuffle_files(spark)
    storage.write_operational(spark.range(99).repartition(3, "id").selectExpr(
        "id patient_id", "'' age_group", "'' gender", "'' blood_group", "'' city"), str(tmp_path), "patient")
    assert len(storage.written_once(spark.range(99).repartition(3, "id"), "rows").collect()) == 99
    for _ in range(50):  # they go in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before


def test_all_warehouse_keys_are_checked(spark):
    site = app.Site.of(spark, SF_DIR)
    found = quality.duplicate_keys(site.any_table, WAREHOUSE_KEYS).collect()
    rows = site.wh.fact.count()
    fact = {r.key_columns: tuple(r)[2:] for r in found if r.table_name == "fact_treatment"}
    assert fact == {"fact_id": (rows, 0, 0), "date_id, disease_sk, doctor_sk, ward_sk": (rows, 0, 0)}
