"""Executors need not have the package: all that tasks use is sent by value."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])  # of the driver alone
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())

def importable(batches):
    import importlib.util
    for batch in batches:
        yield batch.slice(0, 1 if importlib.util.find_spec("clinimart") else 0)

assert spark.range(9).mapInArrow(importable, "id long").count() == 0
from clinimart.llm.queries import QUERIES
for name in sys.argv[3:]:
    assert QUERIES[name](spark, sys.argv[2]).count() > 0, name
    print("ran", name)
"""
# Those whose tasks run Python.
NAMES = [
    "op1_lm_score", "op2_toxicity", "op3_nearest", "op5_simhash", "op7_language",
    "op9_decontamination", "op10_token_counts", "op12_chat_format",
]


def test_queries_run_on_workers_without_the_package(tmp_path):
    script = tmp_path / "script.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, str(script), str(REPO), "/root/testdata/sf0.001", *NAMES],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900, check=False,
    )
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("ran ") == len(NAMES)


@pytest.mark.parametrize("missing", ["ahocorasick", "tiktoken", "clinimart.llm", "corpus_pipeline"])
def test_base_stands_without_what_the_text_operators_need(missing):
    code = (
        "import sys; sys.path.insert(0, sys.argv[1]); sys.modules[sys.argv[2]] = None\n"
        "import __spark_entry__ as app; print(len(app.QUERIES) <= len(app.queries()))"
    )
    done = subprocess.run(
        [sys.executable, "-c", code, str(REPO), missing], capture_output=True, text=True, timeout=120, check=False
    )
    assert done.stdout.strip() == "True", done.stderr[-2000:]
