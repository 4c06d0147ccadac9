"""Language-model scores from a log-frequency Bloom filter.

A text's tokens are its words, A-Z in lower case, and one end token. Training
counts words and pairs of neighbours (the end token also stands before the first
word) over all training texts, exactly: tasks count what they read, the counts meet
by hash bucket, and nothing else is gathered.

The filter holds each word and pair once for every level of its quantised count,
floor(log_b(count / unit)) + 1; it is one array of bits cut into as many segments as
there are buckets, each filled by the task that has the bucket's counts. A count is
read back by probing level 1, 2, ... until one is missing, so it is never too low
and too high by a level with the filter's error rate. The filter has ``filter_bits``
bits at any corpus size, which bounds the broadcast (2^29 bits, 64 MB). As long as all
levels fit at the error rate 2^-probes (93 million of them) the unit is 1 and nothing
is lost: words and pairs seen once have a level. Beyond that the smallest unit for
which all levels fit is taken, from the histogram of all counts, first for pairs
alone. Counts below one unit are then not in the filter but stay in the tables of
counts. Texts are scored in chunks; where the filter finds at most one level of a word
or pair, the chunk asks its bucket: what is kept of the key goes there, packed with all
others of chunk and bucket, and one level a key comes back, the one a larger filter
has (``answers``). Meanwhile the text waits as one level per word and pair. A key costs
4 or 8 bytes on its way and no row of its own. So no count is lost at any size.

The score is the sum over tokens of log10(mix * pair / word before + (1 - mix) *
(word + 1) / (N + V + 1)), with all counts from the filter, the pair's not above
its words'. The base score uses exact counts: of the frequent words (count above
N / ``frequent``, so at most ``frequent`` of them) from a broadcast table, of all
others from a join. Words and pairs are known by 64-bit hashes, of a pair 32 bits
besides its bucket; with 10^9 distinct words two agree with a chance of 3 %.

One bucket's counts are merged in one task. There are 2^10 buckets for up to 1 TB of
input files, and twice as many for every doubling beyond that, up to 2^16.

Nulls: a null text is empty and has the end token only; a null doc_id folds like
an empty id. Repeated rows each count and each give a row. Without training rows N
and V are 0 and every token has probability 1 by the formula of the base.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import new_folder, open_partitions, remove_folder, shuffles_removed
from .text import BLOCK, flat, fold, mixed, small_batches, with_bytes, word_hashes, words

END = np.uint64(0x5851F42D4C957F2D)
PAIR = np.uint64(0xD6E8FEB86659FD93)
WORDS, PAIRS = 0, 1


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a batch of texts, and each text's bounds in them."""
    data, bounds = flat(column)
    starts, ends, split = words(data, bounds)
    hashes = word_hashes(data, starts, ends)[0]
    tokens = np.insert(hashes, split[1:], END)
    return tokens, split + np.arange(len(split))


def pair_hashes(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hash of each token together with the one before it."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = END
    return mixed(before * PAIR + tokens)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, int)
    return keys[new], np.add.reduceat(counts, new) if len(keys) else counts


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def stored(keys: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """What is kept of a key besides its bucket."""
    if kind == WORDS:
        return keys
    return ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def filter_key(keys: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """Where the probes of a key start, from what is kept of it."""
    kept = stored(keys, kind, bits).astype(np.uint64)
    return kept if kind == WORDS else kept * PAIR + np.uint64(1)


# Counting.


def count_batches(batches: Iterator[pa.RecordBatch], bits: int, hold: int) -> Iterator[pa.RecordBatch]:
    """Counts of the batches' words and pairs: a row per bucket and flush."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {WORDS: [], PAIRS: []}
    size = 0

    def flush():
        for kind, parts in held.items():
            keys, counts = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            cuts = np.searchsorted(bucket_of(keys, bits), np.arange((1 << bits) + 1))
            full = np.flatnonzero(np.diff(cuts))
            kept = stored(keys, kind, bits)
            counts = counts.astype(np.uint32) if not len(counts) or counts.max() < 2**32 else counts
            spans = [(cuts[b], cuts[b + 1]) for b in full]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full.astype(np.int32)),
                    pa.array(np.full(len(full), kind, np.int32)),
                    pa.array([kept[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary()),
                ],
                names=["bucket", "kind", "keys", "counts"],
            )
            parts.clear()

    for batch in small_batches(batches):
        tokens, bounds = token_hashes(batch.column("_utf8"))
        for kind, keys in ((WORDS, tokens), (PAIRS, pair_hashes(tokens, bounds))):
            held[kind].append(summed(keys, np.ones(len(keys), np.int64)))
            size += len(held[kind][-1][0])
        if size >= hold:
            yield from flush()
            size = 0
    if size:
        yield from flush()


def unpack(keys: list[bytes], counts: list[bytes], kind: int) -> tuple[np.ndarray, np.ndarray]:
    kept = [np.frombuffer(k, np.uint64 if kind == WORDS else np.uint32) for k in keys]
    numbers = [
        np.frombuffer(c, np.uint32 if len(c) == 4 * len(k) else np.int64).astype(np.int64)
        for c, k in zip(counts, kept, strict=True)
    ]
    return np.concatenate(kept), np.concatenate(numbers)


def merge_bucket(group: pa.Table, base: float) -> pa.Table:
    """One bucket's counts of one kind, and how many are on each level of unit 1."""
    kind = group.column("kind")[0].as_py()
    keys, counts = summed(*unpack(group.column("keys").to_pylist(), group.column("counts").to_pylist(), kind))
    steps = np.floor(np.log(counts) / np.log(base) + 1e-9).astype(np.int64)
    return pa.table(
        {
            "bucket": pa.array([group.column("bucket")[0].as_py()], pa.int32()),
            "kind": pa.array([kind], pa.int32()),
            "keys": pa.array([keys.tobytes()], pa.binary()),
            "counts": pa.array([counts.astype(np.int64).tobytes()], pa.binary()),
            "tokens": pa.array([int(counts.sum())], pa.int64()),
            "types": pa.array([len(keys)], pa.int64()),
            "steps": pa.array([np.bincount(steps).tolist()], pa.list_(pa.int64())),
        }
    )


MERGED = "bucket int, kind int, keys binary, counts binary, tokens long, types long, steps array<long>"


def training_counts(docs: DataFrame, bits: int, base: float, hold: int = 4_000_000) -> DataFrame:
    spark = docs.sparkSession
    parts = with_bytes(docs).mapInArrow(
        lambda batches: count_batches(batches, bits, hold), "bucket int, kind int, keys binary, counts binary"
    )
    merged = parts.groupBy("bucket", "kind").applyInArrow(lambda group: merge_bucket(group, base), MERGED)
    folder = new_folder(spark, "lm-counts")
    with shuffles_removed(spark):
        merged.write.parquet(folder, compression="zstd")
    return spark.read.schema(MERGED).parquet(folder)


# The filter.


def levels(counts: np.ndarray, lift: int, base: float) -> np.ndarray:
    """Level of each count: steps of the logarithm above the unit, none below it."""
    steps = np.floor(np.log(counts) / np.log(base) + 1e-9).astype(np.int64)
    return np.maximum(steps + lift, 0)


def chosen_lift(steps: dict[int, np.ndarray], entries: float) -> dict[int, int]:
    """Steps added to the logarithm of words' and pairs' counts: as many as the
    filter has room for. At best both have a level when seen once; pairs lose theirs
    first."""
    for down in range(1024):
        lift = {WORDS: 1 - down // 2, PAIRS: 1 - (down + 1) // 2}
        if needed(steps, lift) <= entries:
            return lift
    return lift


def needed(steps: dict[int, np.ndarray], lift: dict[int, int]) -> int:
    """Entries of the filter: a key has one for each of its levels."""
    return sum(int((np.maximum(np.arange(len(n)) + lift[kind], 0) * n).sum()) for kind, n in steps.items())


def bucket_bits_of(docs: DataFrame) -> int:
    """Bits of a bucket's number, from the size of the input files."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(min(16, max(10, np.ceil(np.log2(max(size, 1) / 2**30)))))


def places(keys: np.ndarray, level: np.ndarray | int, probes: int, segment_bits: int) -> np.ndarray:
    """Bits inside the segment that stand for each key on the level."""
    x = mixed(keys + np.asarray(level).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first, step = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    rounds = np.arange(probes, dtype=np.uint64)
    return ((first[:, None] + rounds * step[:, None]) & np.uint64(segment_bits - 1)).astype(np.int64)


def fill_segment(group: pa.Table, lift: dict, base: float, probes: int, segment_bits: int) -> pa.Table:
    bits = np.zeros(segment_bits, bool)
    for row in group.to_pylist():
        kind = row["kind"]
        kept, counts = unpack([row["keys"]], [row["counts"]], kind)
        keys = kept if kind == WORDS else kept.astype(np.uint64) * PAIR + np.uint64(1)
        level = levels(counts, lift[kind], base)
        for step in range(1, int(level.max(initial=0)) + 1):
            bits[places(keys[level >= step], step, probes, segment_bits).ravel()] = True
    return pa.table(
        {
            "bucket": pa.array([group.column("bucket")[0].as_py()], pa.int32()),
            "segment": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()),
        }
    )


def counts_of(steps: np.ndarray, base: float) -> np.ndarray:
    """Counts that levels of unit 1 stand for: the middle of a level on the logarithmic scale."""
    return np.where(steps > 0, base ** (steps - 1 + 0.5 * (base > 1.01)), 0.0)


class Filter:
    """The quantised counts, read by probes."""

    def __init__(self, data: np.ndarray, bits: int, lift: dict, base: float, probes: int):
        self.data, self.bits, self.lift, self.base, self.probes = data, bits, lift, base, probes
        self.segment_bits = 8 * len(data) >> bits

    def levels(self, keys: np.ndarray, kind: int, block: int = 1 << 15) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, np.int64)
        return np.concatenate([self._levels(keys[a : a + block], kind) for a in range(0, len(keys), block)])

    def _levels(self, keys: np.ndarray, kind: int) -> np.ndarray:
        found = np.zeros(len(keys), np.int64)
        alive = np.arange(len(keys))
        begin = bucket_of(keys, self.bits) * self.segment_bits
        start = filter_key(keys, kind, self.bits)
        level = 1
        while len(alive) and level < 1024:
            at = places(start[alive], level, self.probes, self.segment_bits) + begin[alive][:, None]
            there = (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(1)
            alive = alive[there]
            found[alive] = level
            level += 1
        return found

    def steps(self, found: np.ndarray, kind: int) -> np.ndarray:
        """Levels of a filter with the unit 1, 0 for what is not found."""
        return np.where(found > 0, found - self.lift[kind] + 1, 0)

    def counts(self, found: np.ndarray, kind: int) -> np.ndarray:
        return counts_of(self.steps(found, kind), self.base)

    def doubtful(self, found: np.ndarray, kind: int) -> np.ndarray:
        """Whether a key may have a count below one unit, or be read a level too high."""
        return (found <= 1) if self.lift[kind] < 1 else np.zeros(len(found), bool)


def build_filter(counts: DataFrame, bits: int, base: float, filter_bits: int, probes: int) -> tuple[tuple, dict]:
    """What the filter is made of, and N and V."""
    spark = counts.sparkSession
    by_step = counts.select("kind", F.posexplode("steps").alias("step", "n")).groupBy("kind", "step")
    steps = {WORDS: np.zeros(1, np.int64), PAIRS: np.zeros(1, np.int64)}
    for row in by_step.agg(F.sum("n").alias("n")).collect():  # a row per step of the logarithm
        kind, step = row["kind"], row["step"]
        steps[kind] = np.pad(steps[kind], (0, max(0, step + 1 - len(steps[kind]))))
        steps[kind][step] = row["n"]
    total = counts.filter(F.col("kind") == WORDS).agg(F.sum("tokens"), F.sum("types")).first()
    lift = chosen_lift(steps, filter_bits * np.log(2) / probes)
    segment_bits = filter_bits >> bits
    data = np.zeros(filter_bits // 8, np.uint8)
    size = segment_bits // 8
    with shuffles_removed(spark):
        segments = counts.groupBy("bucket").applyInArrow(
            lambda group: fill_segment(group, lift, base, probes, segment_bits), "bucket int, segment binary"
        )
        rows = segments.collect()  # filter_bits bits in all
    for row in rows:
        data[row["bucket"] * size : (row["bucket"] + 1) * size] = np.frombuffer(row["segment"], np.uint8)
    return (data, bits, lift, base, probes), {"N": total[0] or 0, "V": total[1] or 0}


# Scoring.


def word_table(counts: DataFrame) -> DataFrame:
    """A row per distinct training word: hash ``h`` and count ``c``."""

    def task(batches):
        for batch in batches:
            for keys, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, c = unpack([keys], [numbers], WORDS)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    return counts.filter(F.col("kind") == WORDS).select("keys", "counts").mapInArrow(task, "h long, c long")


def before_each(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """What the token before each one has; before the first stands the text's last, an end token."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[bounds[:-1]] = values[bounds[1:] - 1]
    return out


def log_probabilities(word: np.ndarray, before: np.ndarray, pair: np.ndarray, model: dict) -> np.ndarray:
    pair = np.minimum(pair, np.minimum(word, before))
    follows = np.divide(pair, before, out=np.zeros_like(pair), where=before > 0)
    alone = np.minimum((word + 1) / (model["N"] + model["V"] + 1), 1.0)
    mix = model["mix"] * (before > 0)
    return np.log10(mix * follows + (1 - mix) * alone)


def binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The values between the cuts as one binary each."""
    offsets = ((cuts - cuts[0]) * values.itemsize).astype(np.int32)
    data = np.ascontiguousarray(values[cuts[0] : cuts[-1]])
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def score_batch(batch: pa.RecordBatch, model: dict) -> tuple[pa.RecordBatch, dict[int, np.ndarray]]:
    """Scores of a batch. With ``late`` its texts also have their levels, ``asked`` where the
    filter leaves them open, and the keys to ask for, in the order of the tokens, come with it."""
    tokens, bounds = token_hashes(batch.column("_utf8"))
    texts = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
    kinds, place = np.unique(tokens, return_inverse=True)
    table = Filter(*model["filter"])
    found = table.levels(kinds, WORDS)
    pair_keys = pair_hashes(tokens, bounds)
    pairs, pair_place = np.unique(pair_keys, return_inverse=True)
    found_pairs = table.levels(pairs, PAIRS)
    columns, names, asked = [], [], {}
    if model["late"]:
        score = np.zeros(batch.num_rows)
        for name, kind, levels_found, at, keys in (
            ("word", WORDS, found, place, tokens),
            ("pair", PAIRS, found_pairs, pair_place, pair_keys),
        ):
            ask = table.doubtful(levels_found, kind)[at]
            steps = np.where(ask, model["asked"], table.steps(levels_found, kind)[at])
            asked[kind] = keys[ask]
            cuts = np.concatenate(([0], np.cumsum(np.bincount(texts[ask], minlength=batch.num_rows))))
            columns += [
                binaries(steps.astype(step_type(table.base)), bounds),
                binaries(bucket_of(asked[kind], table.bits).astype(np.uint16), cuts),
            ]
            names += [f"{name}_steps", f"{name}_buckets"]
    else:
        word = table.counts(found, WORDS)[place]
        pair = table.counts(found_pairs, PAIRS)[pair_place]
        score = np.add.reduceat(log_probabilities(word, before_each(word, bounds), pair, model), bounds[:-1])

    hot_keys, hot_counts = model["hot"]
    at = np.searchsorted(hot_keys, kinds)
    at[at == len(hot_keys)] = 0
    hot = hot_keys[at] == kinds if len(hot_keys) else np.zeros(len(kinds), bool)
    exact = np.where(hot, np.log10((hot_counts[at] if len(hot_counts) else np.zeros(len(kinds))) + 1.0), 0.0)
    rest = np.flatnonzero(~hot[place])
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            batch.column("held_out"),
            pa.array(np.diff(bounds)),
            pa.array(np.add.reduceat(hot[place].astype(np.int64), bounds[:-1])),
            pa.array(np.add.reduceat(exact[place], bounds[:-1])),
            pa.array(score),
            pa.ListArray.from_arrays(
                np.concatenate(([0], np.cumsum(np.bincount(texts[rest], minlength=batch.num_rows)))).astype(np.int32),
                pa.array(tokens[rest].view(np.int64)),
            ),
            *columns,
        ],
        names=["doc_id", "held_out", "n_tokens", "n_hot", "hot_sum", "score", "rest", *names],
    ), asked


SCORED = "doc_id long, held_out boolean, n_tokens long, n_hot long, hot_sum double, score double, rest array<long>"
# What a text waits with, and what a chunk asks a bucket for.
LATE = ", word_steps binary, word_buckets binary, pair_steps binary, pair_buckets binary, chunk long, place int"
ASKS = ", kind int, bucket int, keys binary, asks boolean"
CHUNK = 4  # blocks of text
# Parts of the buckets that are asked one after the other, so that what moves at a time is small.
TURNS = 4


# Levels that the filter has no room for.


def step_type(base: float) -> type:
    """Type that holds all levels of unit 1 and, as its largest value, the mark of an open one."""
    return np.uint8 if 64 * np.log(2) / np.log(base) < 250 else np.uint16


def score_chunks(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    """Rows of the texts, and after those of a chunk a row per bucket that it asks."""
    bits, first = model["filter"][1], TaskContext.get().partitionId() << 32
    schema = None
    held: dict[int, list[np.ndarray]] = {WORDS: [], PAIRS: []}
    chunk, blocks, place = first, 0, 0

    def asks():
        for kind, parts in held.items():
            keys = np.concatenate(parts)
            bucket = bucket_of(keys, bits)
            order = np.argsort(bucket, kind="stable")
            full, starts = np.unique(bucket[order], return_index=True)
            if not len(full):
                continue
            packed = binaries(stored(keys[order], kind, bits), np.append(starts, len(keys)))
            values = {
                "chunk": pa.array(np.full(len(full), chunk)),
                "kind": pa.array(np.full(len(full), kind, np.int32)),
                "bucket": pa.array(full.astype(np.int32)),
                "keys": packed,
                "asks": pa.array(np.ones(len(full), bool)),
            }
            columns = [values.get(f.name, pa.nulls(len(full), f.type)) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in small_batches(batches, limit=BLOCK):
        scored, asked = score_batch(batch, model)
        n = scored.num_rows
        empty = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(np.zeros(n, bool))]
        at = [pa.array(np.full(n, chunk)), pa.array(np.arange(place, place + n, dtype=np.int32))]
        rows = pa.RecordBatch.from_arrays(
            [*scored.columns, *at, *empty], names=[*scored.schema.names, "chunk", "place", "kind", "bucket", "keys", "asks"]
        )
        schema = rows.schema
        yield rows
        for kind, keys in asked.items():
            held[kind].append(keys)
        blocks, place = blocks + 1, place + n
        if blocks == CHUNK:
            yield from asks()
            held = {WORDS: [], PAIRS: []}
            chunk, blocks, place = chunk + 1, 0, 0
    if blocks:
        yield from asks()


def answer_bucket(asks: pa.Table, counts: pa.Table, base: float) -> pa.Table:
    """Levels of unit 1 of the keys that a bucket is asked for, 0 for those not seen."""
    found = []
    for chunk, kind, keys in zip(*(asks.column(c).to_pylist() for c in ("chunk", "kind", "keys")), strict=True):
        if not found:
            packed = [counts.column(c).to_pylist() or [b""] for c in ("keys", "counts")]
            known, numbers = unpack(*packed, kind)
            steps = np.append(levels(numbers, 1, base), 0)
        keys = np.frombuffer(keys, known.dtype)
        at = np.searchsorted(known, keys)
        there = np.append(known, 0)[at] == keys
        found.append(steps[np.where(there, at, len(known))].astype(step_type(base)).tobytes())
    return pa.table(
        {
            "chunk": asks.column("chunk"),
            "kind": asks.column("kind"),
            "bucket": asks.column("bucket"),
            "steps": pa.array(found, pa.binary()),
        }
    )


def answers(asks: DataFrame, counts: DataFrame, base: float) -> DataFrame:
    """Per chunk, kind and bucket the levels of the keys asked for, from the exact counts."""
    spark, folder = asks.sparkSession, new_folder(asks.sparkSession, "lm-answers")
    schema = "chunk long, kind int, bucket int, steps binary"
    for turn in range(TURNS):
        own = F.col("bucket") % TURNS == turn
        left = asks.filter(own).select("chunk", "kind", "bucket", "keys").groupBy("kind", "bucket")
        right = counts.filter(own).select("kind", "bucket", "keys", "counts").groupBy("kind", "bucket")
        found = left.cogroup(right).applyInArrow(lambda x, y: answer_bucket(x, y, base), schema)
        with shuffles_removed(spark):
            found.write.mode("append").parquet(folder, compression="zstd")
    return spark.read.schema(schema).parquet(folder)


def late_chunk(texts: pa.Table, found: pa.Table, model: dict) -> pa.Table:
    """Scores of a chunk's texts, with the answers where the filter left a level open."""
    texts = texts.sort_by("place")
    found = found.sort_by("bucket")
    base, asked = model["base"], model["asked"]
    counts = {}
    for name, kind in (("word", WORDS), ("pair", PAIRS)):
        parts = [np.frombuffer(x, step_type(base)) for x in texts.column(f"{name}_steps").to_pylist()]
        steps = np.concatenate(parts).astype(np.int64)
        buckets = np.frombuffer(b"".join(texts.column(f"{name}_buckets").to_pylist()), np.uint16)
        own = found.filter(pc.field("kind") == kind).column("steps").to_pylist()
        late = np.empty(len(buckets), np.int64)
        late[np.argsort(buckets, kind="stable")] = np.frombuffer(b"".join(own), step_type(base))
        steps[steps == asked] = late
        counts[kind] = counts_of(steps, base)
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
    logs = log_probabilities(counts[WORDS], before_each(counts[WORDS], bounds), counts[PAIRS], model)
    return pa.table({"row": texts.column("row"), "late_score": pa.array(np.add.reduceat(logs, bounds[:-1]))})


def late_scores(texts: DataFrame, found: DataFrame, model: dict) -> DataFrame:
    """Scores of all texts by row, once the buckets have answered."""
    spark, folder, schema = texts.sparkSession, new_folder(texts.sparkSession, "lm-late"), "row long, late_score double"
    waiting = texts.select("chunk", "place", "row", "word_steps", "word_buckets", "pair_steps", "pair_buckets")
    scores = (
        waiting.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(lambda x, y: late_chunk(x, y, model), schema)
    )
    with shuffles_removed(spark):
        scores.write.parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def score_documents(
    docs: DataFrame,
    folds: int = 7,
    held_out: int = 2,
    base: float = 1.5,
    bucket_bits: int | None = None,
    filter_bits: int = 1 << 29,
    probes: int = 4,
    mix: float = 0.5,
    frequent: int = 1 << 20,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        (fold(F.col("doc_id"), folds) == held_out).alias("held_out"),
    )
    bucket_bits = bucket_bits_of(docs) if bucket_bits is None else bucket_bits
    counts = training_counts(rows.filter(~F.col("held_out")), bucket_bits, base)
    table, total = build_filter(counts, bucket_bits, base, filter_bits, probes)
    vocabulary = word_table(counts)
    least = total["N"] / frequent
    hot = vocabulary.filter(F.col("c") > least).toArrow()  # at most ``frequent`` rows
    keys, numbers = hot.column("h").to_numpy().view(np.uint64), hot.column("c").to_numpy()
    order = np.argsort(keys)
    lift = table[2]
    late = min(lift.values()) < 1
    plain = total | {"mix": mix, "base": base, "asked": np.iinfo(step_type(base)).max}
    model = spark.sparkContext.broadcast(
        plain | {"filter": table, "hot": (keys[order], numbers[order]), "late": late}
    )

    def task(batches):
        if late:
            yield from score_chunks(batches, model.value)
        else:
            for batch in small_batches(batches, limit=BLOCK):
                yield score_batch(batch, model.value)[0]

    folder = new_folder(spark, "lm-scored")
    schema = SCORED + (LATE + ASKS) * late
    rows_out = with_bytes(rows, "doc_id", "held_out").mapInArrow(task, schema).withColumn(
        "row", F.monotonically_increasing_id()
    )
    if late:
        with open_partitions(spark, 2):
            rows_out.write.partitionBy("asks").parquet(folder, compression="zstd")
        stored_rows = spark.read.schema(rows_out.schema).parquet(folder)
        found = answers(stored_rows.filter("asks"), counts, base)
        remove_folder(spark, f"{folder}/asks=true")
        scored = spark.read.schema(rows_out.schema).parquet(folder)
        late_sums = late_scores(scored, found, plain)
    else:
        rows_out.write.parquet(folder)
        scored = spark.read.parquet(folder)
    rare = vocabulary.filter(F.col("c") <= least)
    asked = scored.select("row", F.explode("rest").alias("h")).join(rare, "h")
    found = asked.groupBy("row").agg(
        F.count("*").alias("n_rare"), F.sum(F.log10(F.col("c") + 1.0)).alias("rare_sum")
    )
    floor = float(np.log10(total["N"] + total["V"] + 1))
    own = ["row", "doc_id", "held_out", "n_tokens", "n_hot", "hot_sum", "score"]
    full = scored.select(own).join(found, "row", "left")
    if late:
        full = full.join(late_sums, "row").withColumn("score", F.col("late_score"))
    return full.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(total["N"]).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + F.coalesce("rare_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        "score",
    )
