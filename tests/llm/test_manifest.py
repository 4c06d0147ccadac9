from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from clinimart.llm import manifest, queries

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(row, text):
    def field(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    return sha(*map(field, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def slow_tree(level):
    """The root of a list of nodes, and each one's siblings level by level."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, a in enumerate(at):
            run = level[a // 16 * 16 : a // 16 * 16 + 16]
            paths[k].append(("".join(run[: a % 16]), "".join(run[a % 16 + 1 :])))
            at[k] = a // 16
        level = [sha(*level[i : i + 16]) for i in range(0, len(level), 16)]
    return level[0], paths


def slow_audit(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row["source"], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        own = [(slow_leaf(r, r["text"]), r) for r in sources[source]]
        own.sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0]))
        trees.append((own, *slow_tree([leaf for leaf, _ in own])))
    root, tops = slow_tree([tree[1] for tree in trees])
    found = []
    for (own, subroot, paths), top in zip(trees, tops, strict=True):
        for (leaf, row), path in zip(own, paths, strict=True):
            path, node = path + top, leaf
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0:
                node = slow_leaf(row, row["text"] and row["text"].translate(LOW))
            for left, right in path:
                node = sha(left, node, right)
            proof = sha(*[left + right for left, right in path])
            found.append((row["doc_id"], leaf, subroot, root, proof, node, node == root))
    return sorted(found, key=repr)


def ours(frame):
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, frame.select(columns).collect()), key=repr)


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_query_equals_brute_force(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    found = ours(queries.op11_manifest(spark, SMALL))
    assert found == slow_audit(docs)
    assert {r[-1] for r in found} == {True, False}


# 1 row: the leaf is the subroot; 17: a run of one; 257 and 300: three levels.
@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 2, 257, 300], [1] * 40])
def test_trees_of_any_height(spark, many_ranges, sizes):
    rng = random.Random(len(sizes))
    rows = [
        (rng.getrandbits(62) - 2**61, f"Text {i} of {s}", "en", f"s{s:02d}", i)
        for s, size in enumerate(sizes)
        for i in range(size)
    ]
    found = ours(manifest.tampered_audit(spark.createDataFrame(rows, DOC)))
    names = ("doc_id", "text", "lang", "source", "n_chars")
    assert found == slow_audit([dict(zip(names, r, strict=True)) for r in rows])


def test_odd_rows(spark, many_ranges):
    copies = [(5, "Same ROW", "en", "hot", 8)] * 600
    odd = [
        (None, "no id", None, None, None), (None, None, None, None, None), (0, "", "", "", 0),
        (1, None, "fr", "", 3), (1, "ÄÖ É\n" * 3, "fr", "", 3), (2, "X" * 300_000, "en", "é", -1),
        (5, "another of that id", "en", "hot", 8), (4, "12:ab", "-", "-", 1),
    ]
    docs = spark.createDataFrame(copies + odd, DOC)
    for name in ("tree", "place", "digest", "path", "leaf", "size", "_number"):
        docs = docs.withColumn(name, F.lit("clash"))
    names = ("doc_id", "text", "lang", "source", "n_chars")
    wanted = slow_audit([dict(zip(names, r, strict=True)) for r in copies + odd])
    assert ours(manifest.tampered_audit(docs)) == wanted


def test_empty_table(spark):
    assert manifest.tampered_audit(spark.createDataFrame([], DOC)).collect() == []


def test_chosen_requests_and_store(spark, many_ranges):
    rows = [(i, f"t{i}", "en", "a" if i % 3 else "b", i) for i in range(700)]
    leaves = spark.createDataFrame(rows, DOC).select(
        "source", "doc_id", manifest.leaf_digest([F.col(c) for c in manifest.FIELDS]).alias("leaf")
    )
    built = manifest.build(leaves)
    for height, records in built.records.items():
        for record in records.collect():
            assert record.digest == sha(*record.children) and 1 <= len(record.children) <= 16, height
    asked = built.leaves.filter("doc_id in (0, 1, 333, 699)")
    proofs = manifest.prove(built, asked.drop("leaf"), ["doc_id"]).collect()
    assert sorted(p.doc_id for p in proofs) == [0, 1, 333, 699]
    for proof in proofs:
        node = proof.leaf
        for run in proof.path:
            node = sha(run.left, node, run.right)
        assert node == proof.root == built.root
