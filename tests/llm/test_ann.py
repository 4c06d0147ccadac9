from __future__ import annotations

import numpy as np
import pytest

from clinimart.llm import ann

SF_DIR = "/root/testdata/sf0.01"


def exact(rows, every=20, count=20):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault((i, tuple(v)), np.array(v, np.float64))
    out = {}
    for (i, _), v in good.items():
        if i % every == 0:
            near = [(-float((v * w).sum()), j) for (j, _), w in good.items() if j != i and len(w) == len(v)]
            out[i] = [(j, -s) for s, j in sorted(near)[:count]]
    return out


def found(table, **settings):
    out = {}
    for r in ann.nearest(table, **settings).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return np.mean([len({j for j, _ in got[q]} & {j for j, _ in near}) / len(near) for q, near in want.items()])


@pytest.mark.parametrize("shard_size", [64, 2048])
def test_recall_of_the_whole_table(spark, shard_size):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    want = exact([(r["vec_id"], r["embedding"]) for r in table.collect()])
    got = found(table, shard_size=shard_size)
    assert set(got) == set(want) and all(len(got[q]) == 20 for q in got)
    assert recall(got, want) >= 0.95
    scores = {(q, j): s for q, near in want.items() for j, s in near}
    assert all(s == pytest.approx(scores[q, j], rel=1e-12) for q in got for j, s in got[q] if (q, j) in scores)


@pytest.mark.parametrize("kind", ["gaussian", "spread norms", "far tail"])
def test_recall_on_hard_vectors(spark, kind):
    """Vectors without structure: a fixed beam of 64 finds half of the nearest."""
    rng = np.random.RandomState(7)
    vectors = rng.normal(size=(8000, 64))
    if kind != "gaussian":
        vectors *= rng.lognormal(0, 1 if kind == "spread norms" else 2.5, size=(8000, 1))
    vectors = vectors.astype(np.float32).astype(np.float64)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = found(table)
    scores = vectors[::20] @ vectors.T
    scores[np.arange(400), np.arange(400) * 20] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :20]
    hits = [len({j for j, _ in got[20 * k]} & set(near.tolist())) for k, near in enumerate(want)]
    assert np.mean(hits) / 20 >= 0.95


def test_width_is_measured_and_the_scan_is_exact():
    rng = np.random.RandomState(3)
    vectors = rng.normal(size=(900, 48))
    edges, start = ann.build_graph(ann.lifted(vectors), 16, 32, 1.2)
    width, recall = ann.fitted_beam(vectors, edges, start, 10, 16, 0.5, 40)
    assert 16 <= width < 450 and 0.5 <= recall <= 1
    assert ann.fitted_beam(vectors, np.full((900, 1), -1), start, 10, 16, 0.5, 40) == (0, 1.0)
    best = ann.exact_best(vectors, vectors[:5], 10)
    for k in range(5):
        assert set(best[k][best[k] >= 0]) == set(np.argsort(-(vectors @ vectors[k]))[:10])
    tied = np.vstack([vectors[:3], vectors[:3]])
    assert (ann.exact_best(tied, vectors[:1], 1) >= 0).sum() == 2


def test_odd_rows(spark):
    rng = np.random.RandomState(0)
    same = [float(x) for x in rng.normal(size=4)]
    rows = [(k, same) for k in range(100)] + [(k, [float(x) for x in rng.normal(size=4)]) for k in range(100, 160)]
    rows += [(160, None), (180, [0.0] * 4), (200, [1.0, None, 0.0, 2.0]), (220, [float("nan")] * 4), (240, [float("inf")] * 4)]
    rows += [(None, same), (0, same), (260, [1.0, 2.0]), (261, [2.0, 1.0]), (300, [])]
    table = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, shard int")
    floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = {q: near for q, near in exact(floats).items() if near}
    got = found(table)
    assert {q: [j for j, _ in near] for q, near in got.items()} == {q: [j for j, _ in near] for q, near in want.items()}


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "vec_id long, embedding array<float>")) == {}
