from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from clinimart.llm import simhash
from clinimart.llm.components import components

SF_DIR = "/root/testdata/sf0.001"


def slow_fingerprint(text: str | None) -> int:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, f"{f:016x}", least.get(find(k))) for k, (i, f) in enumerate(fps)), key=repr)


def ours(docs):
    return sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr)


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert ours(docs) == slow_components([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(spark):
    rng = np.random.RandomState(1)
    base = [f"w{rng.randint(500)}" for _ in range(300)]
    rows = [(1, None), (2, ""), (None, " \t\n"), (5, "One"), (4, "one"), (6, "a b c d"), (6, "a b c d")]
    rows += [(None, "Ä ß x\x00y"), (7, "x" * 200_000), (8, " ".join(base * 20))]
    for k in range(40):
        words = list(base)
        words[rng.randint(300)] = "changed"
        rows.append((100 - k, " ".join(words)))
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, fp string, key int")
    assert ours(docs) == slow_components(rows)


def test_empty_table(spark):
    assert ours(spark.createDataFrame([], "doc_id long, text string")) == []


def test_one_document_of_each_group_stays(spark):
    rows = [(3, "same words here ok"), (1, "Same words here ok"), (2, "other"), (2, "other"), (None, "other"), (None, "alone")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, _row string")
    kept = sorted(map(tuple, simhash.representatives(docs).collect()), key=repr)
    assert kept == [(1, "Same words here ok", "s"), (2, "other", "s"), (None, "alone", "s")]


@pytest.mark.parametrize("count", [10, 200_000, 10_000_000, 10**10])
def test_thresholds_cover_the_distance(count):
    sample = np.random.RandomState(2).randint(0, 2**63, 512).astype(np.uint64)
    chosen = simhash.plan(sample, count, 4)
    assert sum(t + 1 for _, t in chosen) == 5
    for at, (mask, _) in enumerate(chosen):
        assert all(mask & other == 0 for other, _ in chosen[at + 1 :])


def test_large_buckets_in_blocks_lose_no_link(spark):
    rng = np.random.RandomState(3)
    centre = int(rng.randint(0, 2**62))
    fps = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.randint(0, 63, (600, 2))}
    fps |= {int(x) for x in rng.randint(0, 2**62, 200)}
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = components(simhash.links(table, 4, block=50)).collect()
    want, left = set(), set(fps)
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 4}
            left -= near
            todo += near
        if len(group) > 1:
            want |= {(x, min(group)) for x in group}
    assert {(r["node"], r["root"]) for r in found} == want


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(3000)] + [(9000, 9001)], "u long, v long")
    found = {(r["node"], r["root"]) for r in components(links).collect()}
    assert found == {(k, 0) for k in range(3001)} | {(9000, 9000), (9001, 9000)}
