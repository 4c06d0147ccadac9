"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard.

Vectors are dealt to shards of about ``shard_size`` by hash. A shard's graph starts
from random edges; then each vector, in batches, searches the graph greedily, and
its neighbours are chosen from what the search visited: the nearest one is kept and
all others drop out that are ``alpha`` times nearer to it than to the vector, which
keeps diverse edges; edges are made both ways and pruned the same way. Two rounds
are run, the second with ``alpha`` above 1. A query searches every shard with a beam,
and the best of all shards are merged by exact score.

How wide the beam must be depends on the data, so it is measured: when a shard is
built, ``tried`` of its vectors, spread evenly, are searched in it, and what is found is
held against their exact nearest. Starting with ``beam``, the width is doubled until
``goal`` of these are found; a shard where no width below half its size does it is
scanned by blocked products instead. Width and measured recall are kept with the shard.

Nearness is the inner product. Graph distances are Euclidean after one more
coordinate, sqrt(M^2 - |x|^2) for the largest norm M of the shard, which puts the
largest inner products nearest. Scores are sums of products of the original
components in double precision.

Equal vectors are one node: the node keeps its ``count`` + 1 smallest ids, which are
all that can be among the nearest ``count``, so a vector that a third of all rows
share is one node and ties go to the smaller id. Every row is indexed.

Groups of ``together`` shards and blocks of queries meet in one task per pair, which
gives the best ``count`` of each query; both have bounded size, and neither side is
gathered. As the queries are a share of all rows, pairs grow with the square of the
table's size over the sizes of group and block. Vectors that are null, zero or hold null or non-finite
components take no part, neither as query nor as candidate. Only vectors of one
length are compared; a query is not its own candidate, another row with the same
id and vector is one row. An empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import new_folder

FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Finite components, not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def unify(table: DataFrame) -> DataFrame:
    """``vec_id`` and ``vec`` (doubles; -0 is 0) of the rows that take part, each once."""
    vector = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vec"))
    return rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vec"))).distinct()


def nodes(rows: DataFrame, count: int) -> DataFrame:
    """Distinct vectors, each with its ``count`` + 1 smallest ids. The limit is taken
    in each task before the shuffle."""
    by_vector = Window.partitionBy("vec").orderBy("vec_id")
    first = rows.withColumn("_n", F.row_number().over(by_vector)).filter(F.col("_n") <= count + 1)
    return first.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def search(points: np.ndarray, edges: np.ndarray, start: int, targets: np.ndarray, beam: int, visits: bool = False):
    """Beam search of many targets at once. Returns the beam's points, nearest first,
    and their squared distances; with ``visits`` all points that were expanded."""
    many, degree = len(targets), edges.shape[1]
    norms = (points**2).sum(1)

    def distance(who: np.ndarray, at: np.ndarray) -> np.ndarray:
        return norms[at] - 2 * np.einsum("mkd,md->mk", points[at], targets[who])

    everyone = np.arange(many)
    ids = np.full((many, beam), -1)
    gaps = np.full((many, beam), np.inf)
    done = np.ones((many, beam), bool)
    ids[:, 0], done[:, 0] = start, False
    gaps[:, 0] = distance(everyone, np.full((many, 1), start))[:, 0]
    seen = np.zeros((many, len(points)), bool)
    seen[:, start] = True
    visited: list[tuple[np.ndarray, np.ndarray]] = []
    active = everyone
    while len(active):
        open_gaps = np.where(done[active], np.inf, gaps[active])
        pick = open_gaps.argmin(1)
        live = np.isfinite(open_gaps[np.arange(len(active)), pick])
        active, pick = active[live], pick[live]
        if not len(active):
            break
        here = ids[active, pick]
        done[active, pick] = True
        if visits:
            visited.append((active, here))
        near = edges[here]
        fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
        fresh_rows, fresh_columns = np.nonzero(fresh)
        seen[active[fresh_rows], near[fresh_rows, fresh_columns]] = True
        near_gaps = np.where(fresh, distance(active, np.maximum(near, 0)), np.inf)
        all_ids = np.concatenate([ids[active], near], 1)
        all_gaps = np.concatenate([gaps[active], near_gaps], 1)
        all_done = np.concatenate([done[active], ~fresh], 1)
        best = np.argpartition(all_gaps, beam - 1, axis=1)[:, :beam]
        ids[active] = np.take_along_axis(all_ids, best, 1)
        gaps[active] = np.take_along_axis(all_gaps, best, 1)
        done[active] = np.take_along_axis(all_done, best, 1)
    order = np.argsort(gaps, axis=1, kind="stable")
    ids, gaps = np.take_along_axis(ids, order, 1), np.take_along_axis(gaps, order, 1)
    ids = np.where(np.isfinite(gaps), ids, -1)
    return (ids, gaps, visited) if visits else (ids, gaps)


def robust_prune(points: np.ndarray, node: int, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """The diverse neighbours of a node among the candidates, nearest first."""
    candidates = np.unique(candidates)
    candidates = candidates[(candidates != node) & (candidates >= 0)]
    gaps = ((points[candidates] - points[node]) ** 2).sum(1)
    order = np.argsort(gaps, kind="stable")[: 4 * degree]
    candidates, gaps = candidates[order], gaps[order]
    there = points[candidates]
    squares = (there**2).sum(1)
    between = squares[:, None] + squares[None, :] - 2 * there @ there.T
    alive, kept = np.ones(len(candidates), bool), []
    for k in range(len(candidates)):
        if alive[k]:
            kept.append(candidates[k])
            if len(kept) == degree:
                break
            alive &= alpha * alpha * between[k] > gaps
    return np.array(kept, np.int64)


def build_graph(points: np.ndarray, degree: int, beam: int, alpha: float, batch: int = 256) -> tuple[np.ndarray, int]:
    """Out-edges of each point (-1: none) and the point where searches start."""
    count = len(points)
    rng = np.random.RandomState(count)
    edges = np.full((count, degree), -1)
    if count > 1:
        first = rng.randint(0, count - 1, (count, min(degree, count - 1)))
        edges[:, : first.shape[1]] = first + (first >= np.arange(count)[:, None])
    start = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    for relax in (1.0, alpha):
        order = rng.permutation(count)
        for at in range(0, count, batch):
            some = order[at : at + batch]
            visited = search(points, edges, start, points[some], beam, visits=True)[2]
            who = np.concatenate([w for w, _ in visited])
            what = np.concatenate([v for _, v in visited])
            sort = np.argsort(who, kind="stable")
            who, what = who[sort], what[sort]
            cuts = np.searchsorted(who, np.arange(len(some) + 1))
            back: dict[int, list[int]] = {}
            for k, node in enumerate(some.tolist()):
                own = np.concatenate([what[cuts[k] : cuts[k + 1]], edges[node]])
                kept = robust_prune(points, node, own, relax, degree)
                edges[node] = -1
                edges[node, : len(kept)] = kept
                for other in kept.tolist():
                    back.setdefault(other, []).append(node)
            for other, new in back.items():
                have = edges[other][edges[other] >= 0]
                new = np.setdiff1d(new, have)
                if len(have) + len(new) <= degree:
                    edges[other, len(have) : len(have) + len(new)] = new
                else:
                    kept = robust_prune(points, other, np.concatenate([have, new]), relax, degree)
                    edges[other] = -1
                    edges[other, : len(kept)] = kept
    return edges, start


def lifted(vectors: np.ndarray) -> np.ndarray:
    norms = (vectors**2).sum(1)
    return np.column_stack([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))])


def fitted_beam(
    vectors: np.ndarray, edges: np.ndarray, start: int, count: int, beam: int, goal: float, tried: int
) -> tuple[int, float]:
    """The width at which a sample's searches reach the goal, and the recall measured;
    width 0 stands for the exact scan."""
    some = np.unique(np.linspace(0, len(vectors) - 1, tried).astype(int))
    aim = vectors[some]
    scores = aim @ vectors.T
    most = min(count + 1, len(vectors))
    least = np.partition(scores, -most, axis=1)[:, -most]  # the score that the last of them has
    points, width = lifted(vectors), max(beam, count + 1)
    targets = np.column_stack([aim, np.zeros(len(aim))])
    while 2 * width < len(vectors):
        found, _ = search(points, edges, start, targets, width)
        there = np.where(found >= 0, np.take_along_axis(scores, np.maximum(found, 0), 1), -np.inf)
        good = (there >= least[:, None] - 1e-9 * np.abs(least[:, None])).sum(1)
        recall = float(np.minimum(good, most).sum() / (most * len(aim)))
        if recall >= goal:
            return width, recall
        width *= 2
    return 0, 1.0


def index_shard(
    group: pa.Table, count: int, degree: int, beam: int, alpha: float, goal: float, tried: int
) -> pa.Table:
    vectors = np.array(group.column("vec").to_pylist(), np.float64)
    order = np.lexsort(vectors.T[::-1])
    vectors, ids = vectors[order], group.column("ids").take(pa.array(order))
    edges, start = build_graph(lifted(vectors), degree, beam, alpha)
    width, recall = fitted_beam(vectors, edges, start, count, beam, goal, tried)
    count = len(vectors)
    return pa.table(
        {
            "shard": pa.array(np.full(count, group.column("shard")[0].as_py(), np.int32)),
            "node": pa.array(np.arange(count, dtype=np.int32)),
            "vec": pa.array(list(vectors), pa.list_(pa.float64())),
            "ids": ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids,
            "edges": pa.array([e[e >= 0].astype(np.int32) for e in edges], pa.list_(pa.int32())),
            "start": pa.array(np.full(count, start, np.int32)),
            "beam": pa.array(np.full(count, width, np.int32)),
            "recall": pa.array(np.full(count, recall)),
        }
    )


GRAPH = (
    "shard int, node int, vec array<double>, ids array<long>, edges array<int>, start int, "
    "beam int, recall double"
)


EMPTY = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def search_shards(queries: pa.Table, shards: pa.Table, count: int) -> pa.Table:
    """The ``count`` best of each query over a few shards, searched one by one."""
    found: list[pd.DataFrame] = []
    if queries.num_rows and shards.num_rows:
        numbers = shards.column("shard").to_numpy()
        for number in np.unique(numbers):
            shard = shards.filter(pa.array(numbers == number))
            found = [best_of([*found, *search_shard(queries, shard, count)], count)]
    if not found or not len(found[0]):
        return EMPTY.empty_table()
    return pa.Table.from_pandas(found[0], preserve_index=False).cast(EMPTY)


def best_of(frames: list[pd.DataFrame], count: int) -> pd.DataFrame:
    frame = pd.concat(frames)
    frame = frame.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return frame.groupby("query_id").head(count)


def exact_best(vectors: np.ndarray, part: np.ndarray, count: int) -> np.ndarray:
    """The nearest points of each query by the product with all of them, and any that
    are as near as the last within rounding (-1: none)."""
    scores = part @ vectors.T
    count = min(count, len(vectors))
    last = np.partition(scores, -count, axis=1)[:, -count]
    near = scores >= (last - 1e-9 * np.abs(last))[:, None]
    order = np.argsort(~near, axis=1, kind="stable")[:, : int(near.sum(1).max())]
    return np.where(np.take_along_axis(near, order, 1), order, -1)


def search_shard(queries: pa.Table, shard: pa.Table, count: int) -> list[pd.DataFrame]:
    shard = shard.take(pa.array(np.argsort(shard.column("node").to_numpy())))
    vectors = np.array(shard.column("vec").to_pylist(), np.float64)
    lists = shard.column("edges").to_pylist()
    edges = np.full((len(lists), max(1, max(map(len, lists)))), -1)
    for k, row in enumerate(lists):
        edges[k, : len(row)] = row
    members = shard.column("ids").to_pylist()
    points, start = lifted(vectors), int(shard.column("start")[0].as_py())
    beam = int(shard.column("beam")[0].as_py())
    wanted = np.array(queries.column("vec").to_pylist(), np.float64)
    names = queries.column("query_id").to_numpy()
    out: list[pd.DataFrame] = []
    for at in range(0, len(wanted), 512):
        part = wanted[at : at + 512]
        if beam:
            found, _ = search(points, edges, start, np.column_stack([part, np.zeros(len(part))]), beam)
        else:
            found = exact_best(vectors, part, count + 1)
        rows, columns = np.nonzero(found >= 0)
        at_node = found[rows, columns]
        scores = (vectors[at_node] * part[rows]).sum(1)
        sizes = np.array([len(members[n]) for n in at_node])
        frame = pd.DataFrame(
            {
                "query_id": np.repeat(names[at + rows], sizes),
                "vec_id": np.concatenate([members[n] for n in at_node]),
                "score": np.repeat(scores, sizes),
            }
        )
        out.append(best_of([frame[frame["query_id"] != frame["vec_id"]]], count))
    return out


def nearest(
    table: DataFrame,
    every: int = 20,
    count: int = 20,
    shard_size: int = 2048,
    query_block: int = 4096,
    together: int = 8,
    degree: int = 32,
    beam: int = 64,
    alpha: float = 1.2,
    goal: float = 0.98,
    tried: int = 64,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``count`` nearest found of each query,
    the rows whose id is divisible by ``every``."""
    spark = table.sparkSession
    rows = unify(table)
    folder = new_folder(spark, "ann-nodes")
    nodes(rows, count).write.parquet(folder)
    points = spark.read.parquet(folder)
    per_width = points.groupBy(F.size("vec").alias("width")).count().collect()  # a row per vector length
    shards = {r["width"]: -(-r["count"] // shard_size) for r in per_width}
    if not shards:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def by_width(numbers: dict[int, int]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair]), F.size("vec"))

    def firsts(numbers: dict[int, int]) -> dict[int, int]:
        return {w: sum(n for v, n in numbers.items() if v < w) for w in numbers}

    groups = {w: -(-n // together) for w, n in shards.items()}
    place = F.pmod(F.xxhash64("vec"), by_width(shards)).cast("int")
    graph = points.withColumn("shard", by_width(firsts(shards)) + place).groupBy("shard")
    index = new_folder(spark, "ann-index")
    build = lambda group: index_shard(group, count, degree, beam, alpha, goal, tried)
    graph.applyInArrow(build, GRAPH).write.parquet(index)
    in_group = F.floor((F.col("shard") - by_width(firsts(shards))) / F.lit(together)).cast("int")
    built = spark.read.schema(GRAPH).parquet(index).withColumn("part", by_width(firsts(groups)) + in_group)

    queries = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vec")
    blocks = max(1, -(-queries.count() // query_block))
    first = by_width(firsts(groups))
    asked = queries.select(
        "query_id",
        "vec",
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(first, first + by_width(groups) - 1)).alias("part"),
    )
    held = built.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = asked.groupBy("part", "block").cogroup(held.groupBy("part", "block"))
    found = pairs.applyInArrow(lambda q, s: search_shards(q, s, count), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= count)
    return ranked.select("query_id", "rank", "vec_id", "score")
