"""Language identification by prediction by partial matching.

One tree of byte contexts serves all languages. A node is a context of up to
``order`` bytes; for each language it holds the code length of every next byte. In
a context that a language has seen n times with d different next bytes, a seen byte
has probability count / (n + d), and the escape, d / (n + d), is shared by the
unseen bytes in the proportions of the next shorter context. The shortest context
escapes to all 256 bytes alike. Statistics are frozen after training, so the code
lengths of a node are computed once, and a text's exact code length in a language
is the sum, over all its bytes, of the code length in the longest context kept.
The language with the shortest code is predicted; of equal ones the first by code
point.

Fitting uses a bounded sample: of the ``most_langs`` languages with most labelled
documents, for each the ``sample`` documents that come first in the order of an id
digest, of texts up to ``sample_bytes`` bytes; other languages are not learned.
Documents are chosen by digest, and the texts of those chosen are fetched; no other
text leaves its task. Contexts seen ``least`` times are kept, the most frequent
``contexts``, or ``cells`` / languages if that is fewer, which bounds the tree (64
languages: 750 contexts, 49 MB). All texts are scored whole. A-Z are lower-cased, in
training and scoring.

``score`` is the share of the predicted language among all, with code lengths
tempered by the square root of the text's length. ``und`` with score 0 is given to
texts that are null or have no letter, and to all when nothing was learned.

Nulls: a null id folds like an empty id; labelled rows with a null text teach
nothing. Repeated rows each give a row and are learned from once. An empty table gives an empty result. No
other column is read, and language and source are not read in scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written_once
from .text import LOWERED, flat, fold, small_batches, with_bytes

PAD = 32
SCORED = "doc_id long, held_out boolean, lang_pred string, score double"


def sampled(docs: DataFrame, sample: int, sample_bytes: int, most_langs: int) -> DataFrame:
    """``lang``, ``digest`` and ``text`` of the documents to learn from. Only languages
    and digests are counted, thinned (to about four times the sample) and sorted; at
    most ``sample * most_langs`` digests are then looked up in the documents."""
    digest = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text"))
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = usable.filter(F.octet_length("text") <= sample_bytes).withColumn("digest", digest)
    light = usable.select("lang", "digest").distinct()
    counts = written_once(light.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    largest = counts.orderBy(F.col("n").desc(), "lang").limit(most_langs)
    shares = F.broadcast(largest.select("lang", (F.lit(4.0 * sample) / F.col("n")).alias("share")))
    thin = light.join(shares, "lang").filter((F.col("digest") / F.lit(2.0**64) + 0.5) < F.col("share"))
    first = Window.partitionBy("lang").orderBy("digest")
    chosen = thin.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= sample)
    chosen = F.broadcast(written_once(chosen.select("lang", "digest"), "chosen"))  # bounded, see above
    return usable.select("lang", "digest", "text").join(chosen, ["lang", "digest"])


def padded(data: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with ``order`` spaces before each text, and the places of
    the texts' own bytes."""
    place = np.arange(len(data)) + order * np.repeat(np.arange(1, len(bounds)), np.diff(bounds))
    out = np.full(len(data) + order * (len(bounds) - 1), PAD, np.uint8)
    out[place] = LOWERED[data]
    return out, place


class ContextTree:
    """``child[node, byte]`` is the context one older byte longer, or 0;
    ``cost[node, byte, language]`` the code length in bits."""

    def __init__(self, langs: list[str], child: np.ndarray, cost: np.ndarray, order: int):
        self.langs, self.child, self.cost, self.order = langs, child, cost, order

    def nodes(self, line: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The longest kept context before each place."""
        node = np.zeros(len(place), np.int32)
        alive = np.arange(len(place))
        for back in range(1, self.order + 1):
            longer = self.child[node[alive], line[place[alive] - back]]
            alive = alive[longer > 0]
            node[alive] = longer[longer > 0]
        return node

    def lengths(self, data: np.ndarray, bounds: np.ndarray, block: int = 1 << 18) -> np.ndarray:
        """Code length of each text in each language, in bits."""
        line, place = padded(data, bounds, self.order)
        total = np.zeros((len(bounds) - 1, len(self.langs)))
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for at in range(0, len(place), block):
            here, who = place[at : at + block], owner[at : at + block]
            cost = self.cost[self.nodes(line, here), line[here]]
            new = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
            total[who[new]] += np.add.reduceat(cost, new, axis=0, dtype=np.float64)
        return total


def fit(texts: dict[str, list[bytes]], order: int = 5, least: int = 12, contexts: int = 6000) -> ContextTree:
    langs = sorted(texts, key=lambda lang: lang.encode())
    lines = []
    for lang in langs:
        data = np.frombuffer(b"".join(texts[lang]), np.uint8)
        lines.append(padded(data, np.concatenate(([0], np.cumsum([len(t) for t in texts[lang]]))), order))
    child = np.zeros((1, 256), np.int32)
    seen = [np.zeros((1, 256, len(langs)))]
    parent = np.zeros(1, np.int64)
    at = [np.zeros(len(place), np.int64) for _, place in lines]  # the context of each place
    active = [np.arange(len(place)) for _, place in lines]
    for k, (line, place) in enumerate(lines):
        seen[0][0, :, k] = np.bincount(line[place], minlength=256)
    for back in range(1, order + 1):
        keys = [at[k][a] * 256 + line[place[a] - back] for k, ((line, place), a) in enumerate(zip(lines, active))]
        found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(inverse, minlength=len(found)) if len(found) else np.empty(0, int)
        room = contexts - len(child)
        wanted = np.flatnonzero(counts >= least)
        wanted = np.sort(wanted[np.argsort(-counts[wanted], kind="stable")][: max(room, 0)])
        if not len(wanted):
            break
        number = np.zeros(len(found), np.int64)
        number[wanted] = len(child) + np.arange(len(wanted))
        child = np.concatenate([child, np.zeros((len(wanted), 256), np.int32)])
        child[found[wanted] // 256, found[wanted] % 256] = number[wanted]
        parent = np.concatenate([parent, found[wanted] // 256])
        level = np.zeros((len(wanted), 256, len(langs)))
        begin = 0
        for k, (line, place) in enumerate(lines):
            now = number[inverse[begin : begin + len(keys[k])]]
            begin += len(keys[k])
            active[k], now = active[k][now > 0], now[now > 0]
            at[k][active[k]] = now
            next_byte = line[place[active[k]]].astype(np.int64)
            cells = (now - (len(child) - len(wanted))) * 256 + next_byte
            level[:, :, k] = np.bincount(cells, minlength=level.shape[0] * 256).reshape(-1, 256)
        seen.append(level)
    counts = np.concatenate(seen)
    chance = np.empty_like(counts)
    flat_chance = np.full((256, len(langs)), 1 / 256)
    for node in range(len(counts)):  # a shorter context has a smaller number
        shorter = chance[parent[node]] if node else flat_chance
        here = counts[node]
        total, kinds = here.sum(0), (here > 0).sum(0)
        unseen = np.where(here > 0, 0.0, shorter)
        spread = unseen.sum(0)
        escape = np.where(spread > 0, kinds / np.maximum(total + kinds, 1), 0.0)
        of_seen = np.maximum(np.where(spread > 0, total + kinds, total), 1)
        shared = unseen * (escape / np.where(spread > 0, spread, 1))
        chance[node] = np.where(total > 0, np.where(here > 0, here / of_seen, shared), shorter)
    return ContextTree(langs, child, (-np.log2(chance)).astype(np.float32), order)


def train(
    docs: DataFrame,
    sample: int = 250,
    sample_bytes: int = 1 << 14,
    most_langs: int = 64,
    contexts: int = 6000,
    cells: int = 48_000,
) -> ContextTree | None:
    found = sampled(docs, sample, sample_bytes, most_langs).dropDuplicates(["lang", "digest"])
    texts: dict[str, list[bytes]] = {}
    for lang, _, text in found.collect():  # bounded by the settings
        texts.setdefault(lang, []).append(text.encode())
    texts = {lang: sorted(t) for lang, t in texts.items() if any(t)}
    return fit(texts, contexts=min(contexts, cells // len(texts))) if texts else None


def judge(lengths: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best = lengths.argmin(1)
    worse = (lengths - lengths.min(1, keepdims=True)) / np.sqrt(np.maximum(sizes, 1))[:, None]
    return best, 1 / np.exp2(-np.minimum(worse, 1000)).sum(1)


def languages(docs: DataFrame, folds: int = 3, held_out: int = 1, **settings) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, one row per document."""
    out = fold(F.col("doc_id"), folds) == held_out
    tree = train(docs.filter(~out).select("doc_id", "lang", "text"), **settings)
    parts = tree and (tree.langs, tree.child, tree.cost, tree.order)
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), letter.alias("letter"), "text"
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value and ContextTree(*shared.value)
        for batch in small_batches(batches):
            letters = batch.column("letter").to_pylist()
            names, scores = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            if known is not None:
                data, bounds = flat(batch.column("_utf8"))
                best, sure = judge(known.lengths(data, bounds), np.diff(bounds))
                names = [known.langs[b] if has else "und" for b, has in zip(best, letters, strict=True)]
                scores = [float(s) if has else 0.0 for s, has in zip(sure, letters, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names), pa.array(scores)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return with_bytes(rows, "doc_id", "held_out", "letter").mapInArrow(task, SCORED)
