"""Toxic spans and document scores from a linear-chain conditional random field.

Each word is tagged toxic or not. A word's evidence for the toxic tag is the sum of
the weights of its features (the word, and its first 4, 5 and 6 bytes), the chain
adds weights of neighbouring tags, and forward-backward gives each word's marginal.
Marginals aggregate to the document's score, by a logistic curve over the largest
marginal and the number of words above one half, and to the offending spans: runs
of words with a marginal of one half or more, in code points of the original text.

With two tags a step of the recursion is a 2 x 2 matrix. All texts of a batch form
one stream; a text's first step ignores the tag before it, which keeps texts apart.
The stream is cut into stretches that run side by side, and their products join
them, so a very long text costs as much per word as short ones.

Labels are of documents. Words are labelled from them: in a toxic document a word is
labelled toxic if one of its features occurs in a share of at least ``support`` of
the toxic documents, which is at least ``odds`` times its share of the others. Fitting uses a bounded sample: of the labelled rows outside the held-out
fold the ``sample`` of each label that come first in the order of an id digest,
with texts up to ``sample_bytes`` bytes, equal texts once; ``prior`` is the share of
toxic documents that the curve expects. All texts are scored
whole. Language, source and id are no inputs.

Nulls: a null or empty text has no words and the curve's score for none. Labels
that are null teach nothing; a document with several labels is toxic if one says so.
A null id folds like an empty id and meets no label. Repeated rows each give a row.
Without toxic training rows the score is 0. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written_once
from .text import code_points, flat, fold, rows_of, small_batches, with_bytes, word_hashes, words

PREFIXES = (4, 5, 6)
TABLE_BITS = 20
FOUND = ["score", "predicted", "spans"]
FOUND_TYPES = "score double, predicted int, spans array<array<bigint>>"


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each word's features as 64-bit numbers, a row per kind."""
    hashes = word_hashes(data, starts, ends, PREFIXES)
    return np.stack([h * np.uint64(2 * k + 0x9E3779B1) for k, h in enumerate(hashes)])


def _scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Forward messages of the steps [[a, b], [c, d]]: the share of the second tag in
    the row vector (1, 1) A_1 ... A_t, for each t."""
    count = len(a)
    stretch = max(1, int(np.sqrt(count)) // 2)
    lanes = -(-count // stretch)

    def side_by_side(x: np.ndarray, rest: float) -> np.ndarray:
        whole = np.full(lanes * stretch, float(rest))
        whole[:count] = x
        return np.ascontiguousarray(whole.reshape(lanes, stretch).T)

    a, b, c, d = side_by_side(a, 1), side_by_side(b, 0), side_by_side(c, 0), side_by_side(d, 1)
    p, q, r, s = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for t in range(stretch):
        p, q, r, s = p * a[t] + q * c[t], p * b[t] + q * d[t], r * a[t] + s * c[t], r * b[t] + s * d[t]
        scale = 1 / (p + q + r + s)
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
    share, entry = 0.5, np.empty(lanes)
    for lane, (p1, q1, r1, s1) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        entry[lane] = share
        plain, toxic = (1 - share) * p1 + share * r1, (1 - share) * q1 + share * s1
        share = toxic / (plain + toxic)
    out = np.empty((stretch, lanes))
    for t in range(stretch):
        plain, toxic = (1 - entry) * a[t] + entry * c[t], (1 - entry) * b[t] + entry * d[t]
        entry = toxic / (plain + toxic)
        out[t] = entry
    return out.T.ravel()[:count]


def marginals(evidence: np.ndarray, first: np.ndarray, chain: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Chance of the toxic tag for each word of a stream, and the expected number of
    each pair of neighbouring tags. ``first`` marks texts' first words;
    ``chain[i, j]`` is the weight of tag j after tag i, ``start`` that of a toxic
    first word."""
    if not len(evidence):
        return np.empty(0), np.zeros((2, 2))
    evidence = np.clip(evidence, -30, 30)
    plain, toxic = np.exp(-np.maximum(evidence, 0)), np.exp(np.minimum(evidence, 0))
    e = np.exp(chain)
    a, b = np.where(first, plain, e[0, 0] * plain), np.where(first, np.exp(start) * toxic, e[0, 1] * toxic)
    c, d = np.where(first, plain, e[1, 0] * plain), np.where(first, np.exp(start) * toxic, e[1, 1] * toxic)
    ahead = _scan(a, b, c, d)

    def from_end(x: np.ndarray) -> np.ndarray:
        return np.concatenate(([1.0], x[:0:-1]))

    behind = _scan(from_end(a), from_end(c), from_end(b), from_end(d))[::-1]
    both = ahead * behind
    both = both / (both + (1 - ahead) * (1 - behind))
    before = np.roll(ahead, 1)
    joint = np.stack([(1 - before) * a * (1 - behind), (1 - before) * b * behind, before * c * (1 - behind), before * d * behind])
    joint = np.where(first, 0.0, joint / joint.sum(0))
    return both, joint.sum(1).reshape(2, 2)


class Tagger:
    """Weights of features in a table; a cell answers only to its own feature."""

    def __init__(self, features: np.ndarray, weights: np.ndarray):
        order = np.argsort(np.abs(weights), kind="stable")  # the larger weight keeps a shared cell
        at = (features[order] >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        self.owner, self.weight = np.zeros(1 << TABLE_BITS, np.uint32), np.zeros(1 << TABLE_BITS, np.float32)
        self.owner[at], self.weight[at] = features[order].astype(np.uint32), weights[order]
        self.bias, self.chain, self.start, self.curve = 0.0, np.zeros((2, 2)), 0.0, np.zeros(3)

    @classmethod
    def of(cls, state: dict) -> Tagger:
        tagger = cls.__new__(cls)
        vars(tagger).update(state)
        return tagger

    def tag(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        first = np.zeros(features.shape[1], bool)
        first[bounds[:-1][np.diff(bounds) > 0]] = True
        evidence = np.full(features.shape[1], self.bias)
        for row in features:
            at = (row >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            evidence += np.where(self.owner[at] == row.astype(np.uint32), self.weight[at], 0.0)
        return marginals(evidence, first, self.chain, self.start)[0]

    def score(self, marginal: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        x = summary(marginal, bounds) @ self.curve
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def summary(marginal: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text: logit of the largest marginal, log of the words above one half, 1."""
    sizes = np.diff(bounds)
    largest, many = np.zeros(len(sizes)), np.zeros(len(sizes))
    full = sizes > 0
    if full.any():
        largest[full] = np.maximum.reduceat(marginal, bounds[:-1][full])
        many[full] = np.add.reduceat((marginal >= 0.5).astype(float), bounds[:-1][full])
    largest = np.clip(largest, 1e-4, 1 - 1e-4)
    return np.stack([np.log(largest / (1 - largest)), np.log1p(many), np.ones(len(sizes))], 1)


def weak_labels(place: np.ndarray, owner: np.ndarray, toxic: np.ndarray, support: float, odds: float) -> np.ndarray:
    """Which words of the sample are labelled toxic; ``place`` numbers their features."""
    labelled = np.zeros(place.shape[1], bool)
    count = int(place.max(initial=-1)) + 1
    for row in place:
        cells = np.unique(row * len(toxic) + owner)
        at, doc = cells // len(toxic), cells % len(toxic)
        bad = np.bincount(at[toxic[doc]], minlength=count)
        good = np.bincount(at[~toxic[doc]], minlength=count)
        bad_rate, good_rate = bad / toxic.sum(), (good + 0.5) / (~toxic).sum()
        telling = (bad >= 3) & (bad_rate >= support) & (bad_rate >= odds * good_rate)
        labelled |= telling[row] & toxic[owner]
    return labelled


def adam(gradient, size: int, rounds: int, rate: float) -> np.ndarray:
    """Ascent along ``gradient`` by steps of adapted length."""
    x, mean, square = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        g = gradient(x)
        mean = 0.9 * mean + 0.1 * g
        square = 0.99 * square + 0.01 * g * g
        x += rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return x


def fit(
    texts: list[bytes], toxic: np.ndarray, support: float = 0.01, odds: float = 10.0, prior: float = 0.1, rounds: int = 40
) -> Tagger:
    """Weights by gradient ascent on the likelihood of the labelled words."""
    data, bounds = flat(pa.array(texts, pa.binary()))
    starts, ends, split = words(data, bounds)
    features = word_features(data, starts, ends)
    sizes = np.diff(split)
    owner = np.repeat(np.arange(len(texts)), sizes)
    names, place = np.unique(features, return_inverse=True)
    place = place.reshape(features.shape)
    tags = weak_labels(place, owner, toxic, support, odds)
    told = ~toxic
    told[owner[tags]] = True  # a toxic text without a toxic word would teach the opposite
    keep = told[owner]
    first = np.zeros(len(owner), bool)
    first[split[:-1][sizes > 0]] = True
    first, tags, place = first[keep], tags[keep], place[:, keep]
    count = len(names)
    follows = np.flatnonzero(~first)
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (tags[follows - 1].astype(int), tags[follows].astype(int)), 1)

    def gradient(x: np.ndarray) -> np.ndarray:
        w, bias, chain, start = x[:count], x[count], x[count + 1 : count + 5].reshape(2, 2), x[count + 5]
        evidence = np.full(len(first), bias)
        for row in place:
            evidence += w[row]
        found, pairs = marginals(evidence, first, chain, start)
        gap = tags - found
        slope = sum(np.bincount(row, weights=gap, minlength=count) for row in place)
        return np.concatenate(
            [slope - 0.5 * w, [gap.sum()], (seen_pairs - pairs).ravel() - 0.1 * chain.ravel(), [gap[first].sum()]]
        )

    x = adam(gradient, count + 6, rounds, 0.25) if len(first) else np.zeros(count + 6)
    tagger = Tagger(names, x[:count])
    tagger.bias, tagger.chain, tagger.start = x[count], x[count + 1 : count + 5].reshape(2, 2), x[count + 5]
    seen = summary(tagger.tag(features, split), split)
    share = np.where(toxic, prior / toxic.sum(), (1 - prior) / (~toxic).sum())

    def curve_gradient(c: np.ndarray) -> np.ndarray:
        return seen.T @ (share * (toxic - 1 / (1 + np.exp(-np.clip(seen @ c, -500, 500))))) - 1e-4 * c

    tagger.curve = adam(curve_gradient, 3, 400, 0.1)
    return tagger


def sampled(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, sample: int, sample_bytes: int) -> DataFrame:
    """``text`` and ``toxic`` of the rows to learn from. Ids are chosen first, among
    those with a text of a usable size, so that no text is moved: ids and labels meet by
    id, and the texts of at most 2 * ``sample`` ids are looked up."""
    usable_texts = docs.filter(F.octet_length("text") <= sample_bytes)
    there = usable_texts.select(F.col("doc_id").cast("long").alias("id")).distinct()
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("toxic") > 0).alias("toxic"))
    usable = usable.filter(fold(F.col("id"), folds) != held_out).join(there, "id", "left_semi")
    usable = written_once(usable, "toxic-labels")
    order = [F.xxhash64("id", F.lit(11)), F.col("id")]
    chosen = [usable.filter(F.col("toxic") == side).orderBy(*order).limit(sample) for side in (True, False)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample rows
    found = usable_texts.join(ids, F.col("doc_id").cast("long") == F.col("id"))
    few = found.select("id", "text", "toxic")
    return few.orderBy("id", "text").limit(4 * sample)  # an id may have any number of rows


def train(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 5,
    held_out: int = 0,
    sample: int = 1200,
    sample_bytes: int = 1 << 14,
) -> Tagger | None:
    rows = docs.select("doc_id", "text")
    found = sampled(rows, labels, folds, held_out, sample, sample_bytes)
    texts = {r["text"].encode(): r["toxic"] for r in found.collect()}
    toxic = np.array([texts[t] for t in sorted(texts)], bool)
    if not toxic.any() or toxic.all():
        return None
    return fit(sorted(texts), toxic)


def word_runs(text: bytes, starts: np.ndarray, ends: np.ndarray, bad: np.ndarray) -> list[list[int]]:
    counts = code_points(np.frombuffer(text, np.uint8))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], bad, [False])).astype(np.int8)))
    return [[int(counts[starts[a]]), int(counts[ends[b - 1]])] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def score_batch(batch: pa.RecordBatch, tagger: Tagger | None) -> list[pa.Array]:
    data, bounds = flat(batch.column("_utf8"))
    spans: list[list[list[int]]] = [[] for _ in range(batch.num_rows)]
    score = np.zeros(batch.num_rows)
    if tagger is not None:
        starts, ends, split = words(data, bounds)
        marginal = tagger.tag(word_features(data, starts, ends), split)
        score = tagger.score(marginal, split)
        bad = marginal >= 0.5
        for k in np.unique(np.searchsorted(split, np.flatnonzero(bad), "right") - 1):
            a, b, at = split[k], split[k + 1], bounds[k]
            spans[k] = word_runs(data[at : bounds[k + 1]].tobytes(), starts[a:b] - at, ends[a:b] - at, bad[a:b])
    return [
        pa.array(score),
        pa.array((score >= 0.5).astype(np.int32)),
        pa.array(spans, pa.list_(pa.list_(pa.int64()))),
    ]


def tagged(docs: DataFrame, tagger: Tagger | None, keep: tuple[str, ...], types: str) -> DataFrame:
    """The columns ``keep`` with ``score, predicted, spans``."""
    state = tagger and vars(tagger)  # plain arrays: workers need not have this package
    shared = docs.sparkSession.sparkContext.broadcast(state)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value and Tagger.of(shared.value)
        for batch in small_batches(batches):
            kept = [batch.column(name) for name in keep]
            yield pa.RecordBatch.from_arrays([*kept, *score_batch(batch, known)], names=[*keep, *FOUND])

    return with_bytes(docs, *keep).mapInArrow(task, f"{types}, {FOUND_TYPES}")


def scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, **settings) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans``, one row per document."""
    tagger = train(docs, labels, folds, held_out, **settings)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold(F.col("doc_id"), folds) == held_out).alias("held_out"),
        "text",
    )
    return tagged(rows, tagger, ("doc_id", "held_out"), "doc_id long, held_out boolean")


def harmless(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents not predicted toxic, with all their columns."""
    tagger = train(docs, labels, **settings)
    rows = rows_of(docs)
    types = f"_row {rows.schema['_row'].dataType.simpleString()}"
    return tagged(rows, tagger, ("_row",), types).filter("predicted = 0").select("_row.*")
