"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all
benchmark items, run over each text once.

Words are runs of ASCII letters and digits and of anything beyond ASCII, with
A-Z lower-cased. A window is ``window`` consecutive words of an item; an item of
fewer words, but not none, is one window. A text's word inside any occurrence of
a window is hit. The words of item and text are joined by single spaces, with one
at each end, so that windows match whole words only.

The automaton grows with the benchmark, not with the documents. Windows are made,
united and counted on Spark and dealt by hash to groups of about ``group_bytes``; one
group at a time reaches the driver and the tasks, where a task builds its automaton
once. With one group (about a hundred thousand questions) the documents are read once
and nothing is shuffled. With more, they are written once with a number, scanned once
per group, and the hit runs of a document from all groups are united by its number.

Nulls: a null text has no words. Items without text or words have no window. A
null item_id is left out of the item counts, its windows still hit. Repeated
documents each give a row; repeated items count once per item_id. An empty
benchmark contaminates nothing. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written_once
from .text import LOWERED, code_points, rows_of, small_batches, with_bytes

_codes = np.arange(256)
_WORD = (_codes >= 128) | ((_codes >= 48) & (_codes <= 57)) | ((_codes >= 97) & (_codes <= 122))
TABLE = bytes(int(LOWERED[c]) if _WORD[LOWERED[c]] else 32 for c in range(256))
RUN = "struct<first: bigint, last: bigint, start: bigint, end: bigint>"
FOUND = f"n_words bigint, item_ids array<string>, runs array<{RUN}>"
_RUN = pa.struct([(name, pa.int64()) for name in ("first", "last", "start", "end")])
WINDOWS = "key binary, size int, item string"


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def window_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """A row per item and distinct window of it."""
    for batch in small_batches(batches, limit=1 << 20):
        keys, sizes, owners = [], [], []
        for item, text in zip(batch.column("item").to_pylist(), batch.column("_utf8").to_pylist(), strict=True):
            words = normal_words(text)
            size = min(window, len(words))
            spans = range(len(words) - size + 1 if words else 0)
            own = {b" " + b" ".join(words[at : at + size]) + b" " for at in spans}
            keys += own
            sizes += [size] * len(own)
            owners += [item] * len(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(owners, pa.string())],
            names=["key", "size", "item"],
        )


def window_table(benchmark: DataFrame, window: int) -> DataFrame:
    """Each window once, with its number of words and the items that have it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    rows = with_bytes(items, "item").mapInArrow(lambda batches: window_batches(batches, window), WINDOWS)
    united = rows.groupBy("key").agg(F.max("size").alias("size"), F.collect_set("item").alias("items"))
    return written_once(united, "windows")


def group_of(windows: DataFrame, number: int, groups: int) -> list[tuple]:
    """The windows of one group, about ``group_bytes`` of them."""
    rows = windows.filter(F.pmod(F.xxhash64("key"), F.lit(groups)) == number).collect()
    return [(bytes(row["key"]).decode("latin-1"), row["size"], tuple(row["items"])) for row in rows]


def automaton(group: list[tuple]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for key, size, ids in group:
        built.add_word(key, (len(key), size, ids))
    built.make_automaton()
    return built


def runs_of(data: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of hit words: first and last+1 word, and the code points of the original
    text from the first to the last word, end exclusive."""
    inside = np.frombuffer(data.translate(TABLE), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    counts = code_points(np.frombuffer(data, np.uint8))
    runs = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    first, last = runs[::2], runs[1::2]
    begin, end = counts[edges[::2][first]], counts[edges[1::2][last - 1]]
    rows = zip(first.tolist(), last.tolist(), begin.tolist(), end.tolist(), strict=True)
    return [dict(zip(("first", "last", "start", "end"), row, strict=True)) for row in rows]


def scan(text: bytes, built: ahocorasick.Automaton, words: list[bytes]) -> tuple[list[dict], set]:
    """The runs of hit words, and the items whose windows occur."""
    line = " " + b" ".join(words).decode("latin-1") + " "
    hits, ids = [], set()
    for end, (length, size, owners) in built.iter(line):
        hits.append((end - length + 1, size))
        ids.update(owners)
    if not hits:
        return [], ids
    places = np.cumsum([0, *(len(w) + 1 for w in words)])
    firsts = np.searchsorted(places, [at for at, _ in hits])
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, firsts, 1)
    np.add.at(change, firsts + [size for _, size in hits], -1)
    return runs_of(text, np.cumsum(change[:-1]) > 0), ids


def scan_batches(batches: Iterator[pa.RecordBatch], group: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The batches' columns but the text, with the words, items and runs of each text."""
    built = automaton(group) if group else None
    for batch in small_batches(batches, limit=1 << 24):
        counts, items, runs = [], [], []
        for text in batch.column("_utf8").to_pylist():
            words = normal_words(text)
            found, owners = scan(text, built, words) if words and built else ([], set())
            counts.append(len(words))
            items.append(sorted(owners))
            runs.append(found)
        kept = [name for name in batch.schema.names if name != "_utf8"]
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(name) for name in kept],
                pa.array(counts, pa.int64()),
                pa.array(items, pa.list_(pa.string())),
                pa.array(runs, pa.list_(_RUN)),
            ],
            names=[*kept, "n_words", "item_ids", "runs"],
        )


def _scanned(rows: DataFrame, group: list[tuple], keep: tuple[str, ...]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(group)
    fields = [*[rows.schema[name] for name in keep], *T.StructType.fromDDL(FOUND).fields]
    task = lambda batches: scan_batches(batches, shared.value)
    return rows.select(*keep, "_utf8").mapInArrow(task, T.StructType(fields))


def _united(runs: Column) -> Column:
    """Runs that meet or touch as one, in order."""

    def add(done: Column, run: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(
            last["first"].alias("first"), F.greatest(last["last"], run["last"]).alias("last"),
            last["start"].alias("start"), F.greatest(last["end"], run["end"]).alias("end"),
        )
        new = (F.size(done) == 0) | (run["first"] > F.try_element_at(done, F.lit(-1))["last"])
        head = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(new, F.concat(done, F.array(run))).otherwise(F.concat(head, F.array(longer)))

    return F.aggregate(F.sort_array(runs), F.array().cast(f"array<{RUN}>"), add)


def _by_groups(source: DataFrame, windows: DataFrame, groups: int, keep: tuple[str, ...]) -> DataFrame:
    """One scan of the documents per group, united by document."""
    numbered = written_once(source.withColumn("_place", F.monotonically_increasing_id()), "texts")
    words, hits = None, []
    for number in range(groups):
        found = _scanned(numbered, group_of(windows, number, groups), ("_place",))
        if words is None:  # the first scan also counts the words of all documents
            found = written_once(found, "scanned")
            words = found.select("_place", "n_words")
            hits.append(found.filter(F.size("runs") > 0))
        else:
            hits.append(written_once(found.filter(F.size("runs") > 0), "scanned"))
    union = hits[0]
    for more in hits[1:]:
        union = union.unionByName(more)
    per_document = union.groupBy("_place").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        _united(F.flatten(F.collect_list("runs"))).alias("runs"),
    )
    none = {"item_ids": "array<string>", "runs": f"array<{RUN}>"}
    return (
        numbered.select("_place", *keep)
        .join(words, "_place")
        .join(per_document, "_place", "left")
        .select(*keep, "n_words", *[F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in none.items()])
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    one_in: int = 20,
    group_bytes: int = 64 << 20,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """For each document, next to the columns ``keep``: its number of words, of hit
    words, the items found, the hit spans of the original text, and whether it is
    contaminated: some word hit and at least one word in ``one_in``."""
    windows, source = window_table(benchmark, window), with_bytes(docs, *keep)
    size = windows.agg(F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()[0]
    groups = -(-size // group_bytes)
    if groups > 1:
        found = _by_groups(source, windows, groups, keep)
    else:
        found = _scanned(source, group_of(windows, 0, 1) if groups else [], keep)
    hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, run: n + run["last"] - run["first"])
    judged = (F.col("n_hit") > 0) & (F.lit(one_in) * F.col("n_hit") >= F.col("n_words"))
    return found.select(
        *keep,
        "n_words",
        hit.alias("n_hit"),
        "item_ids",
        F.transform("runs", lambda run: F.array(run["start"], run["end"])).alias("spans"),
    ).withColumn("contaminated", judged)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the report, one row per document."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    found = contamination(rows_of(docs), benchmark, keep=("_row",), **settings)
    return found.filter(~F.col("contaminated")).select("_row.*")
