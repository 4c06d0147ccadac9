"""What a full filter leaves open costs a few bytes a token, and is not kept longer than needed."""

from __future__ import annotations

import random
import time
import zlib
from pathlib import Path

import pytest
from test_lm_score import key, slow_scores

from clinimart.llm import lm_score
from clinimart.sources.storage import shuffles_removed


def texts(n, words):
    draw = random.Random(5)
    return [(i, " ".join(f"w{int(draw.paretovariate(0.4)) % 50_000}" for _ in range(words))) for i in range(n)]


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_open_tokens_take_little_disk(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(lm_score, "new_folder", lambda spark, purpose: f"{tmp_path}/{purpose}")
    rows = texts(60, 5_000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    ours = lm_score.score_documents(docs, frequent=64, bucket_bits=4, filter_bits=1 << 16)
    stored = sum(f.stat().st_size for f in Path(tmp_path, "lm-scored").rglob("*.parquet"))
    tokens = sum(len(t.split()) + 1 for _, t in rows)
    assert stored < 12 * tokens  # eight of them are the hash that the base score joins
    assert not Path(tmp_path, "lm-scored", "asks=true").exists()
    got, want = sorted(map(tuple, ours.collect()), key=key), sorted(slow_scores(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert max(abs(a[6] - b[6]) / b[2] for a, b in zip(got, want, strict=True)) < 0.05


def test_keys_never_seen_are_answered_with_zero(spark):
    """All texts but one are held out: words and pairs unknown to the counts, words that
    cover several chunks, texts without a word."""
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:12]
    learnt = next(i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2)
    rows = [(learnt, "a b c a b")] + [(i, "z " * 400_000 + "a b") for i in held[:6]]
    rows += [(i, t) for i, t in zip(held[6:], ["", None, "a b c", "q", "b a", "a"], strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = lm_score.score_documents(docs, frequent=64, bucket_bits=1, filter_bits=1 << 4)
    got, want = sorted(map(tuple, got.collect()), key=key), sorted(slow_scores(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[6] == pytest.approx(b[6], rel=1e-6)


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    before = shuffle_files(spark)
    with shuffles_removed(spark):
        spark.range(9999).repartition(3, "id").write.parquet(f"{tmp_path}/out")
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert spark.read.parquet(f"{tmp_path}/out").count() == 9999
