"""A filter without room for all counts gives the scores of one that has it."""

from __future__ import annotations

import pytest
from test_lm_score import SF_DIR, key, slow_scores

from clinimart.llm import lm_score


@pytest.mark.parametrize("filter_bits", [1 << 18, 1 << 16])
def test_a_full_filter_loses_no_count(spark, monkeypatch, filter_bits):
    lifts = []
    chosen = lm_score.chosen_lift
    monkeypatch.setattr(lm_score, "chosen_lift", lambda *a: lifts.append(chosen(*a)) or lifts[-1])
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    ours = lm_score.score_documents(docs, frequent=64, bucket_bits=4, filter_bits=filter_bits).collect()
    assert lifts[0][lm_score.PAIRS] < 1
    want = slow_scores([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got, want = sorted(map(tuple, ours), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    off = [abs(a[6] - b[6]) / max(b[2], 1) for a, b in zip(got, want, strict=True)]
    print(lifts, sum(off) / len(off), max(off))
    assert sum(off) / len(off) < 0.02  # an error of the filter now and then
