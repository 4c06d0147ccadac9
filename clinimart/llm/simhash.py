"""SimHash near-dedup with the generalised pigeonhole principle.

A text's fingerprint has a bit where more than half of the XXH64 values of its
word shingles have it. Two different fingerprints are linked at ``distance`` or
fewer differing bits; documents with one fingerprint are one class.

Search. The 64 bits are grouped into partitions, bits that agree often with one
another together. Each partition i has a threshold T_i; if all T_i + 1 sum up to
distance + 1, two linked fingerprints differ in at most T_i bits of some
partition (T_i = -1: not searched). Number of partitions and thresholds are those
of least cost, by dynamic programming over the partitions, from the number of keys
to probe and of candidates to expect at the table's size; both come from a bounded
sample of fingerprints, which steers the work and never the result. A fingerprint
is put into a bucket for each partition and key within the threshold, and buckets
are compared inside tasks: exact distance for every pair of a small bucket, and for
a large one a search that visits each member once and gives one link for each
member reached. So thousands of near copies give thousands of links, not millions,
and no link that joins two groups is lost. Buckets beyond ``block`` members are
cut into blocks, and each pair of blocks is compared by a task of its own.

Components come from rounds of smallest-neighbour contraction over tables in the
shared folder; no link or fingerprint list is collected.

Nulls: a null text has no words and fingerprint zero, as have texts of white
space; they are linked like any other. A null doc_id takes part in the links but
names no component; where all ids are null, component_id is null. Repeated rows each give
a row. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import new_folder, written_once
from .components import components
from .text import small_batches, with_bytes

SEED = 42


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends[: len(words) - shingle + 1] - [len(w) for w in words[: len(words) - shingle + 1]]).tolist()
    stops = ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts)
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id`` and the fingerprint ``fp`` as a signed long."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, limit=1 << 24):
            found = [fingerprint(t, shingle) for t in batch.column("_utf8").to_pylist()]
            fps = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fps], names=["doc_id", "fp"])

    return with_bytes(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(
        task, "doc_id long, fp long"
    )


# The plan: partitions and thresholds.


def bit_groups(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt to ``parts`` groups of nearly equal size: a group starts with the
    free bit of least variety and takes those that agree (or disagree) most with it."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    centred = bits - bits.mean(0)
    spread = np.sqrt((centred**2).mean(0)) + 1e-9
    linked = np.abs(centred.T @ centred) / len(bits) / np.outer(spread, spread)
    free, groups = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        group = [min(free, key=lambda b: (spread[b], b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (linked[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def keys_within(width: int, threshold: int) -> int:
    total, term = 0, 1
    for k in range(threshold + 1):
        total += term
        term = term * (width - k) // (k + 1)
    return total


def plan(sample: np.ndarray, count: int, distance: int, most_keys: int = 700) -> list[tuple[int, int]]:
    """(mask, threshold) of each partition to search; the cheapest by estimate."""
    pairs = np.bitwise_xor.outer(sample[:1024], sample[:1024])[np.triu_indices(min(len(sample), 1024), 1)]
    best: tuple[float, list[tuple[int, int]]] | None = None
    for parts in range(1, distance + 2):
        groups = bit_groups(sample, parts)
        masks = [sum(1 << b for b in group) for group in groups]
        cost = []
        for mask, group in zip(masks, groups, strict=True):
            apart = np.bitwise_count(pairs & np.uint64(mask)) if len(pairs) else np.zeros(0)
            row = [0.0]  # threshold -1
            for t in range(distance + 1):
                probes = keys_within(len(group), t)
                chance = max(probes / 2.0 ** len(group), float((apart <= t).mean()) if len(apart) else 0.0)
                # a key costs a row in a shuffle; a candidate costs a comparison of two numbers
                row.append(np.inf if probes > most_keys else count * (probes + 0.02 * count * chance / 2))
            cost.append(row)
        need = distance + 1  # sum of T_i + 1
        table = {0: (0.0, ())}
        for row in cost:
            step: dict = {}
            for used, (spent, chosen) in table.items():
                for steps, price in enumerate(row):
                    if used + steps <= need:
                        option = (spent + price, (*chosen, steps - 1))
                        if used + steps not in step or option < step[used + steps]:
                            step[used + steps] = option
            table = step
        if need in table and (best is None or table[need][0] < best[0]):
            chosen = [(m, t) for m, t in zip(masks, table[need][1], strict=True) if t >= 0]
            best = (table[need][0], chosen)
    return best[1]


# Buckets and their comparison.


def flips(mask: int, threshold: int) -> np.ndarray:
    """All changes of up to ``threshold`` bits inside ``mask``."""
    bits = [1 << b for b in range(64) if mask >> b & 1]
    found = {0}
    for _ in range(threshold):
        found |= {f ^ b for f in found for b in bits}
    kept = [f for f in found if f.bit_count() <= threshold]
    return np.array(sorted(kept), np.uint64)


def bucket_rows(fps: DataFrame, partitions: list[tuple[int, int]]) -> DataFrame:
    """A row per fingerprint, partition and key within the threshold. ``own`` marks
    the fingerprint's own key."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changes = [(np.uint64(mask), flips(mask, t)) for mask, t in partitions]
        for batch in batches:
            all_fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(all_fps), 4096):
                part = all_fps[start : start + 4096]
                for k, (mask, change) in enumerate(changes):
                    keys = ((part & mask)[:, None] ^ change[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(keys), k, np.int32)),
                            pa.array(keys.view(np.int64)),
                            pa.array(np.repeat(part, len(change)).view(np.int64)),
                        ],
                        names=["part", "key", "fp"],
                    )

    return fps.mapInArrow(task, "part int, key long, fp long")


def spread_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows with the pair of blocks they are compared in; one pair for most buckets."""
    large = rows.groupBy("part", "key").count().filter(F.col("count") > block)
    large = large.select("part", "key", F.ceil(F.col("count") / block).alias("blocks"))
    marked = rows.join(large, ["part", "key"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other),
    )
    one = F.array(F.lit(0).cast("long"))
    return marked.select(
        "part", "key", "fp", F.explode(F.when(F.col("blocks").isNull(), one).otherwise(pairs)).alias("pair")
    )


def spanning_links(members: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all members which links of the whole set connect."""
    left, links = members, []
    limit = np.uint8(distance)
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = []
            for seed in front:
                near = np.bitwise_count(left ^ seed) <= limit
                if near.any():
                    got = left[near]
                    links.append((np.full(len(got), seed), got))
                    reached.append(got)
                    left = left[~near]
                    if not len(left):
                        break
            front = np.concatenate(reached) if reached else left[:0]
    return links


def small_links(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, distance: int):
    """All links inside small buckets, by array operations over many buckets."""
    first = np.repeat(np.arange(len(fps)), np.repeat(starts + sizes, sizes) - np.arange(len(fps)) - 1)
    begin = np.concatenate(([0], np.cumsum(np.bincount(first, minlength=len(fps)))))[first]
    second = np.arange(len(first)) - begin + first + 1
    near = np.bitwise_count(fps[first] ^ fps[second]) <= distance
    near &= fps[first] != fps[second]
    return fps[first[near]], fps[second[near]]


def bucket_links(batches: Iterator[pa.RecordBatch], distance: int, small: int = 48):
    """Links of the buckets in a sorted stream; a bucket may run over batches."""
    held: list[np.ndarray] = []

    def columns(batch):
        names = ("part", "key", "pair", "fp")
        return np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names])

    def compare(rows: np.ndarray):
        new = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(0)) + 1
        starts = np.concatenate(([0], new)).astype(np.int64)
        sizes = np.diff(np.concatenate((starts, [rows.shape[1]])))
        fps = rows[3].view(np.uint64) if rows[3].flags.c_contiguous else np.ascontiguousarray(rows[3]).view(np.uint64)
        few = (sizes > 1) & (sizes <= small)
        for at in range(0, int(few.sum()), 1024):
            s, n = starts[few][at : at + 1024], sizes[few][at : at + 1024]
            offsets = np.cumsum(n) - n
            take = np.repeat(s - offsets, n) + np.arange(n.sum())
            yield small_links(fps[take], offsets, n, distance)
        for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
            links = spanning_links(np.unique(fps[s : s + n]), distance)
            if links:
                yield np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links])

    def out(pairs):
        for a, b in pairs:
            if len(a):
                a, b = a.view(np.int64), b.view(np.int64)
                both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["u", "v"])

    for batch in batches:
        if batch.num_rows:
            rows = np.concatenate([*held, columns(batch)], axis=1)
            last = rows[:3, -1:]
            open_from = int(np.flatnonzero((rows[:3] != last).any(0))[-1]) + 1 if (rows[:3] != last).any() else 0
            if open_from:
                yield from out(compare(np.ascontiguousarray(rows[:, :open_from])))
            held = [rows[:, open_from:].copy()]
    if held:
        yield from out(compare(held[0]))


def links(fps: DataFrame, distance: int = 4, block: int = 20_000, sample: int = 4096) -> DataFrame:
    """``u > v``: links between different fingerprints, enough to connect all that
    are linked. ``fps`` has each fingerprint once."""
    spark = fps.sparkSession
    some = [r[0] for r in fps.orderBy(F.xxhash64("fp")).limit(sample).collect()]
    if len(some) < 2:
        return spark.createDataFrame([], "u long, v long")
    count = len(some) if len(some) < sample else fps.count()
    partitions = plan(np.array(some, np.int64).view(np.uint64), count, distance)
    rows = spread_blocks(bucket_rows(fps, partitions), block)
    dealt = rows.repartition("part", "key", "pair").sortWithinPartitions("part", "key", "pair")
    return dealt.mapInArrow(lambda batches: bucket_links(batches, distance), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row per document."""
    spark = docs.sparkSession
    folder = new_folder(spark, "fingerprints")
    fingerprints(docs, shingle).write.parquet(folder)
    by_doc = spark.read.schema("doc_id long, fp long").parquet(folder)
    classes = written_once(by_doc.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    roots = components(written_once(links(classes.select("fp"), distance), "fingerprint-links"))
    joined = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    joined = joined.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    names = joined.join(named, "root").select("fp", "component_id")
    return by_doc.join(names, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def representatives(docs: DataFrame, **settings) -> DataFrame:
    """One document of each component, with all columns of ``docs``: that with the
    smallest doc_id, and of several rows with it that with the smallest text. A row
    without doc_id comes after all that have one, in the order of a text hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    stand_in = F.lit(2**62) + F.xxhash64(text).bitwiseAND(F.lit(2**61 - 1))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), stand_in).alias("doc_id"),
        text.alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
    )
    found = near_duplicates(rows.select("doc_id", "text"), **settings)
    chosen = found.filter("doc_id = component_id").select("doc_id").distinct()
    chosen = written_once(chosen, "near-dup-kept")
    kept = rows.join(chosen, "doc_id", "left_semi")
    return kept.groupBy("doc_id").agg(F.min_by("_row", "text").alias("_row")).select("_row.*")
