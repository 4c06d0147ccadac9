"""Filter interaction audit: what each of five document filters removes, in any order.

    A  under 200 words                       B  under half of the words distinct
    C  over 3 % capital A-Z                  D  any of # $ % & * |
    E  the text is that of a document with a smaller doc_id

A to D are bits of a row, found in one scan of the texts. E is an existential self-join:
a left-semi join on the text's hash, the exact text and a smaller doc_id. Its right side
keeps one row per distinct text, that of the smallest doc_id, found with partial minima
before the shuffle: a document has a smaller twin exactly if that one is smaller, so
pairs inside a group of copies are never formed and a join partition that a large group
fills can be split. Only documents whose hash occurs under two doc_ids bring their texts.

E's ids are united with the other failures, and bits are added up per document; the
table then shrinks to at most 32 combinations of failures per part, from which the 120
orders follow. A document fails or passes each filter whatever ran before, so an order
decides only which filter removes it.

Documents are counted, not texts or doc_ids: repeated rows count each, and have the same
failures. A null text is empty (and a copy of an empty one); a null lang belongs to part
'' as an empty one does. A null doc_id is neither smaller nor larger than another, so it
fails E never. Of several labels of a doc_id the larger quality and toxic hold; labels
without a document are not counted. An empty table gives no rows. Other columns are not
read. A row is known by doc_id, part, length and 64-bit hash from the scan on; the exact
texts are compared in the join alone.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written_once
from .text import SPACES, UPPER

FILTERS = "ABCDE"
BIT = {letter: 1 << i for i, letter in enumerate(FILTERS)}
# Fixed values of the five filters.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, SYMBOLS = 200, 50, 3, "[#$%&*|]"
KEY = ("doc_id", "part", "hash", "chars")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.xxhash64(text).alias("hash"),
        text.alias("text"),
    )


def failures(docs: DataFrame) -> DataFrame:
    """``KEY`` and the bits of A to D in ``bits``, a row per document."""
    text, words, chars = F.col("text"), F.col("words"), F.col("chars")
    spaced = F.translate(text, SPACES, " " * len(SPACES))
    rows = _rows(docs).withColumns(
        {"words": F.array_remove(F.split(spaced, " "), ""), "chars": F.length(text)}
    )
    capitals = chars - F.length(F.translate(text, UPPER, ""))
    failed = {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
        "C": 100 * capitals.cast("bigint") > MAX_CAPITAL_PERCENT * chars,
        "D": text.rlike(SYMBOLS),
    }
    bits = sum((F.when(hit, BIT[k]).otherwise(0) for k, hit in failed.items()), F.lit(0))
    return rows.select(*KEY, bits.alias("bits"))


def later_copies(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """``KEY`` of documents whose text is that of a smaller doc_id; ``seen`` has the
    ``KEY`` of all documents."""
    repeated = (
        seen.groupBy("hash")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter("first < last")
        .select("hash", "first")
    )
    # written, so that its size is known: a broadcast below the threshold, else a shuffle
    repeated = written_once(repeated, "repeated")
    suspects = written_once(_rows(docs).join(repeated, "hash"), "suspects")
    smallest = (
        suspects.filter("doc_id is not null")
        .groupBy(F.col("hash").alias("_hash"), F.col("text").alias("_text"))
        .agg(F.min("doc_id").alias("_smaller"))
    )
    twin = (
        (F.col("hash") == F.col("_hash"))
        & (F.col("text") == F.col("_text"))
        & (F.col("_smaller") < F.col("doc_id"))
    )
    later = suspects.filter("doc_id > first").join(smallest, twin, "left_semi")
    return later.select("doc_id", "part", "hash", F.length("text").alias("chars")).distinct()


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, failed filters as ``mask``, and the number of documents, of good and of
    toxic ones: a row per combination that occurs."""
    seen = written_once(failures(docs), "failures")
    copies = later_copies(docs, seen).select(*KEY, F.lit(BIT["E"]).alias("bits"), F.lit(0).alias("n"))
    failed = seen.select(*KEY, "bits", F.lit(1).alias("n")).unionByName(copies)
    masks = failed.groupBy(*KEY).agg(F.bit_or("bits").alias("mask"), F.sum("n").alias("n"))

    def any_one(column: str) -> Column:
        return F.coalesce(F.max(F.col(column) == 1), F.lit(False)).alias(column)

    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "toxic")
    marks = marks.groupBy("doc_id").agg(any_one("quality"), any_one("toxic"))
    return (
        masks.join(marks, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(
            F.sum("n").alias("docs"),
            F.sum(F.when(F.col("quality"), F.col("n")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
        )
    )


def _steps() -> Column:
    """All orders and their steps, with the bit of the step's filter and of those before."""
    entries = []
    for order in map("".join, permutations(FILTERS)):
        for step, letter in enumerate(order, 1):
            before = sum(BIT[earlier] for earlier in order[: step - 1])
            names = {"filter_order": order, "step": step, "bit": BIT[letter], "before": before}
            entries.append(F.struct(*[F.lit(v).alias(k) for k, v in names.items()]))
    return F.array(*entries)


def interactions(combos: DataFrame) -> DataFrame:
    """Per part, order and step: documents kept after it, removed by it, failing it but
    removed earlier, failing it alone, good and toxic ones removed, and what its filter
    removes in all orders together."""
    rows = combos.withColumn("at", F.explode(_steps())).select(*combos.columns, "at.*")
    mask, bit, before = F.col("mask"), F.col("bit"), F.col("before")
    fails, earlier = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0

    def total(condition: Column, column: str = "docs") -> Column:
        return F.sum(F.when(condition, F.col(column)).otherwise(0))

    steps = rows.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~earlier).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(mask == bit).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"),
    )
    same_filter = Window.partitionBy("part", "bit")  # 600 rows at most
    return steps.withColumn("shapley", F.sum("removed").over(same_filter)).drop("bit")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return interactions(combinations(docs, labels))
