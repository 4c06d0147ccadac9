from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from clinimart.operators import ordering


def test_numbers_over_the_whole_table(spark, many_ranges):
    ids = random.Random(1).sample(range(500), 120)
    df = spark.createDataFrame([(i,) for i in ids], "id BIGINT")
    got = ordering.number_in_order(df, ["id"], "n")
    assert {r.id: r.n for r in got.collect()} == {k: i for i, k in enumerate(sorted(ids), 1)}


def test_numbers_within_a_hot_key(spark, many_ranges):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", "b"]), rng.randrange(4)) for i in range(300)]
    df = spark.createDataFrame(rows, "id BIGINT, ward STRING, day INT")
    got = ordering.number_in_order(df, ["day", "id"], "n", within=["ward"])
    want, seen = {}, defaultdict(int)
    for i, ward, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        seen[ward] += 1
        want[i] = seen[ward]
    assert {r.id: r.n for r in got.collect()} == want
    assert set(got.columns) == {"ward", "id", "day", "n"}


def test_rank_rows_equals_sql_rank(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 0, 0, 5, 9]), rng.choice([1, 2]), rng.randrange(3)) for i in range(400)]
    df = spark.createDataFrame(rows, "id INT, a INT, b INT, c INT")
    df.createOrReplaceTempView("ranked")
    got = ordering.rank_rows(df, [("a", "desc"), ("b", "asc"), ("c", "desc")], "place")
    want = spark.sql("SELECT id, rank() OVER (ORDER BY a DESC, b ASC, c DESC) place FROM ranked")
    assert {r.id: r.place for r in got.collect()} == {r.id: r.place for r in want.collect()}


def test_rank_leaves_gaps_after_ties(spark):
    df = spark.createDataFrame([(1, 9), (2, 9), (3, 5)], "id INT, a INT")
    got = ordering.rank_rows(df, [("a", "desc")], "place").orderBy("id").collect()
    assert [r.place for r in got] == [1, 1, 3]


def _plain_numbers(rows):
    """Number per key in the order of (key, id), NULL keys first."""
    seen, numbers = {}, []
    for key, row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        seen[key] = seen.get(key, 0) + 1
        numbers.append((key, row, seen[key]))
    return sorted(numbers, key=lambda r: r[1])


def test_numbers_of_any_ids(spark, many_ranges):
    rng = random.Random(5)
    keys = [None, "a", "b", "c"]
    rows = [("hot" if i % 3 == 0 else rng.choice(keys), rng.getrandbits(63) - 2**62) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id bigint")
    found = ordering.number_in_order(df, ["id"], "n", ["k"]).collect()
    assert sorted([tuple(r) for r in found], key=lambda r: r[1]) == _plain_numbers(rows)
    alone = ordering.number_in_order(df, [F.col("id").desc()], "n").orderBy("n").collect()
    assert [r.id for r in alone] == sorted((r[1] for r in rows), reverse=True)
    assert [r.n for r in alone] == list(range(1, 3001))
    assert ordering.number_in_order(df.limit(0), ["id"], "n", ["k"]).count() == 0


def test_running_totals_over_ranges(spark, many_ranges):
    rng = random.Random(6)
    rows = [("hot" if i % 2 else str(i % 7), i, rng.randint(0, 9)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, id bigint, v bigint")
    laid = ordering.lay_out(df, ["k", "id"])
    assert laid.select("_part").distinct().count() > 1
    found = ordering.running_totals(laid, ["k"], {"before": "v"}).orderBy("k", "id").collect()
    so_far = {}
    for key, row, value in sorted(rows):
        assert (found[0].k, found[0].id, found[0].before) == (key, row, so_far.get(key, 0))
        so_far[key] = so_far.get(key, 0) + value
        found = found[1:]
