from __future__ import annotations

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from clinimart.llm import filter_audit

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABEL = "doc_id bigint, quality int, toxic int"


def slow_failures(docs):
    """Failed filters of each row, written out from their definitions."""
    failed = []
    for doc_id, text, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = set()
        if len(words) < 200:
            own.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            own.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
            own.add("C")
        if any(c in "#$%&*|" for c in text):
            own.add("D")
        if doc_id is not None and any(
            i is not None and i < doc_id and (other or "") == text for i, other, *_ in docs
        ):
            own.add("E")
        failed.append(own)
    return failed


def slow_audit(docs, labels):
    failed, rows = slow_failures(docs), []
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, mark in labels if mark == 1 and i is not None}
    for part in {lang or "" for _, _, lang, *_ in docs}:
        own = [(d[0], f) for d, f in zip(docs, failed, strict=True) if (d[2] or "") == part]
        table, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [i for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                fails = sum(letter in f for _, f in own)
                only = sum(f == {letter} for _, f in own)
                shapley[letter] += len(gone)
                table.append((
                    part, "".join(order), step, len(left), len(gone), fails - len(gone), only,
                    sum(i in good for i in gone), sum(i in toxic for i in gone), letter,
                ))
        rows += [(*r[:-1], shapley[r[-1]]) for r in table]
    return sorted(rows)


def ours(spark, docs, labels):
    docs = spark.createDataFrame(docs, DOC)
    for name in ("part", "hash", "chars", "bits", "words", "first", "mask", "_hash"):
        docs = docs.withColumn(name, F.lit("clash"))
    marks = spark.createDataFrame(labels, LABEL).withColumn("part", F.lit("clash"))
    found = filter_audit.audit(docs, marks)
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails"]
    return sorted(map(tuple, found.select(*columns, "good_lost", "toxic_lost", "shapley").collect()))


def test_against_one_filter_after_another(spark):
    rng = random.Random(13)
    texts = [
        None, "", " \t\n\x0b\x0c\r ", "one two", "A", "#", " ".join(f"w{i}" for i in range(200)),
        " ".join(f"w{i}" for i in range(199)), " ".join(["same"] * 200), " ".join(["a", "b"] * 100),
        " ".join(f"w{i % 100}" for i in range(200)), " ".join(f"w{i % 99}" for i in range(200)),
        "ABC" + "x" * 97, "ABCD" + "x" * 96, "ÄÖÜ É", "a\x1cb c\x85d", "x " * 300 + "&",
        "w" * 200_000, " ".join(f"v{i}" for i in range(300)) + " | SHOUTING " + "LOUD " * 60,
    ]
    docs = [(i, rng.choice(texts), rng.choice([None, "", "en", "de"]), "s", 1) for i in range(400)]
    docs += [(None, "one two", "en", "s", 1), (None, "A", "en", "s", 1), (7, *docs[7][1:]), (7, "again", "en", "s", 1)]
    rng.shuffle(docs)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 500, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (None, 1, 1), (90_000, 1, 1)]
    assert ours(spark, docs, labels) == slow_audit(docs, labels)


def test_large_group_of_copies_is_joined_once_each(spark):
    docs = [(i, "the same text", "en", "s", 1) for i in range(3000)]
    frame = spark.createDataFrame(docs, DOC)
    seen = filter_audit.failures(frame)
    found = filter_audit.later_copies(frame, seen)
    assert sorted(r.doc_id for r in found.collect()) == list(range(1, 3000))


def test_different_texts_of_one_hash_stay_apart(spark, monkeypatch):
    rows = filter_audit._rows
    monkeypatch.setattr(filter_audit, "_rows", lambda docs: rows(docs).withColumn("hash", F.lit(1).cast("bigint")))
    docs = [(3, "b", "en", "s", 1), (1, "a", "en", "s", 1), (2, "b", "en", "s", 1), (4, "c", "en", "s", 1)]
    frame = spark.createDataFrame(docs, DOC)
    found = filter_audit.later_copies(frame, filter_audit.failures(frame))
    assert [r.doc_id for r in found.collect()] == [3]


def test_empty_tables(spark):
    assert ours(spark, [], [(1, 1, 1)]) == []
    docs = [(1, "x", "en", "s", 1)]
    assert ours(spark, docs, []) == slow_audit(docs, [])
