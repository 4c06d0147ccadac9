from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pytest

from clinimart.llm import lm_score

SF_DIR = "/root/testdata/sf0.001"
END = object()


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), END]


def slow_scores(rows, mix=0.5, base=1.5):
    held = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in rows]
    words, pairs = Counter(), Counter()
    for (_, text), out in zip(rows, held, strict=True):
        if not out:
            words.update(tokens(text))
            pairs.update(zip([END, *tokens(text)], tokens(text)))
    n, v = sum(words.values()), len(words)

    def quantised(count, lift):
        level = math.floor(math.log(count) / math.log(base) + 1e-9) + lift if count else 0
        return base ** (level - lift + 0.5) if level > 0 else 0.0

    out = []
    for (i, text), is_out in zip(rows, held, strict=True):
        seq = tokens(text)
        plain = sum(math.log10((words[t] + 1) / (n + v + 1)) for t in seq)
        score = 0.0
        for a, b in zip([END, *seq], seq):
            word, before = quantised(words[b], 1), quantised(words[a], 1)
            pair = min(quantised(pairs[a, b], 1), word, before)
            part = mix if before else 0.0
            score += math.log10(part * (pair / before if before else 0) + (1 - part) * min(1, (word + 1) / (n + v + 1)))
        out.append((i, is_out, len(seq), sum(words[t] > 0 for t in seq), n, plain, score))
    return out


def key(row):
    return repr(row[:5]), row[5]


def same(docs, rows):
    ours = sorted(map(tuple, lm_score.score_documents(docs, frequent=64).collect()), key=key)
    want = sorted(slow_scores(rows), key=key)
    assert [r[:5] for r in ours] == [r[:5] for r in want]
    for a, b in zip(ours, want, strict=True):
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-6)


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    same(docs, [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "A a\tÄ"), (3, "a b " * 50_000), (4, "unseen")]
    rows += [(5, "x" * 3_000_000 + " y"), (6, " a  b "), (6, "c\x00d")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    same(docs, rows)


def test_empty_table(spark):
    assert lm_score.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_without_training_rows(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm_score.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert tuple(row) == (held, True, 3, 0, 0, 0.0, 0.0)


def test_a_full_filter_takes_a_larger_unit():
    import numpy as np

    steps = {lm_score.WORDS: np.array([1000, 100, 10]), lm_score.PAIRS: np.array([5000, 500, 50])}
    assert lm_score.chosen_lift(steps, 1e6) == {0: 1, 1: 1}
    assert lm_score.needed(steps, {0: 1, 1: 1}) == 1230 + 6150
    assert lm_score.chosen_lift(steps, 2000) == {0: 1, 1: 0}
    lift = lm_score.chosen_lift(steps, 300)
    assert lift[0] < 1
    assert sum((np.maximum(np.arange(3) + lift[k], 0) * n).sum() for k, n in steps.items()) <= 300
