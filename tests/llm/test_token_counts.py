from __future__ import annotations

import pytest

from clinimart.llm import token_counts as tc

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    return tc.Encoder(tc.read_ranks(tc.VOCABULARY))


def slow_rows(encoder, doc_id, text):
    text = text or ""
    ids = encoder.encoding.encode_ordinary(text)
    tokens = [encoder.encoding.decode_single_token_bytes(i) for i in ids]
    assert b"".join(tokens) == text.encode()
    place = [k for k, c in enumerate(text) for _ in c.encode()]
    lines = text.split("\n")
    spans, at = [], 0
    for k, line in enumerate(lines):
        end = at + len(line) + (k < len(lines) - 1)
        spans.append((at, end))
        at = end
    counts, crossing, at = [0] * len(spans), [0] * len(spans), 0
    for token in tokens:
        first, last = place[at], place[at + len(token) - 1] + 1
        at += len(token)
        shared = [max(0, min(last, b) - max(first, a)) for a, b in spans]
        best = shared.index(max(shared))
        counts[best] += 1
        crossing[best] += shared[best] < last - first
    return [(doc_id, k, a, b, counts[k], crossing[k], len(ids)) for k, (a, b) in enumerate(spans)]


def same(docs, rows, encoder):
    ours = sorted(map(tuple, tc.section_tokens(docs).collect()), key=repr)
    assert ours == sorted((r for row in rows for r in slow_rows(encoder, *row)), key=repr)


def test_whole_table_equals_brute_force(spark, encoder):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    same(docs, [tuple(r) for r in docs.select("doc_id", "text").collect()], encoder)


def test_odd_rows(spark, encoder):
    texts = [None, "", "\n", "a\n\n\n  b\r\nc", "é\n😀😀\n漢字 text", "<|endoftext|>\n \n x", "x" * 20_000, "end\n", " \n\n\t\n y"]
    rows = [(k if k % 4 else None, t) for k, t in enumerate(texts)] + [(2, "\n")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, section int")
    same(docs, rows, encoder)


def test_empty_table(spark):
    assert tc.section_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rule_for_crossing_tokens():
    import numpy as np

    first, last = np.array([0, 3, 5, 8, 20]), np.array([3, 5, 8, 9, 22])
    owner, crossing = tc.attribute(first, last, np.array([0, 4, 10]), np.array([4, 7, 12]))
    assert owner.tolist() == [0, 0, 1, -1, -1]
    assert crossing.tolist() == [False, True, True, True, True]


def test_very_long_run_without_spaces(encoder):
    assert len(encoder.ends(b"ab" * 500_000)) > 0


def test_long_runs_of_white_space(encoder, monkeypatch):
    pieces = [" ", "\n", "　", " \n", "a", "é", "1", "'s", " b", "."]
    texts = ["".join(pieces[(k * k + k * n + n) % 10] * (1 + (k * 7 + n) % 9) for k in range(40)) for n in range(60)]
    whole = [encoder.ends(t.encode()).tolist() for t in texts]
    monkeypatch.setattr(tc, "LONG_RUN", 3)
    assert [encoder.ends(t.encode()).tolist() for t in texts] == whole
    monkeypatch.undo()
    for text in (b" " * 2_000_000 + b"a", b"a" + b"\n" * 2_000_000 + b" b"):
        assert encoder.ends(text)[-1] == len(text)
