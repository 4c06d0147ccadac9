"""Mixing sources to target weights by weighted fair queueing.

The documents of a source wait in a shuffled queue (order of a seeded digest).
Document copy e of a source has the virtual finish time (words of its source up
to and including it) / target; all copies are sorted by that time over all
sources and the mix is cut at the total budget, inside a copy if need be. A
source whose target exceeds its size goes round again, three times at most.

Sources weigh 1, 2, 3, 1, 2, 3, ... by code point, null last, and share all
words. A target stops at ``most`` times the source's size and the excess goes to
the others by weight, until no target is above its limit. With limits sorted as
r = most * size / weight this is one pass: while the water level, words left over
weights left, reaches r, that source is full.

Nothing is summed in one task but counts: both cumulative sums (in a source's
queue, and along virtual time) add up ranges first and order documents within a
range only. A range holds about ``per_range`` rows of any source, so a source with
a third of all rows is spread like the rest. The cut is one row.

Nulls: a null text has size 0; a null source is a source of its own, sorted last;
a null doc_id is queued like any id. Size 0 takes nothing. Repeated rows each
give a row and each may be taken. An empty table gives an empty result. The
order depends on ids and texts only, so reruns agree. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written_once

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def queue_key(seed: str) -> Column:
    """Shuffled place of a document in its source's queue."""
    parts = [F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))]
    return F.md5(F.concat_ws(":", *parts))


def source_targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """From ``source, source_size``: the weight and target of each source."""
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(ranked) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (place + 1).cast("int"))
    limit = F.col("source_size") * most
    by_limit = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    onward = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(onward)
    full = F.col("level") * F.col("weight") >= F.col("limit")
    return (
        sizes.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("weight", weight)
        .withColumn("limit", limit)
        .withColumn("level", level)
        .withColumn("common", F.max(F.when(~full, F.col("level"))).over(Window.partitionBy()))
        .select(
            "source",
            "source_size",
            "total",
            F.when(full, F.col("limit").cast("double"))
            .otherwise(F.col("common") * F.col("weight"))
            .alias("target"),
        )
    )


def running_sum(rows: DataFrame, group: list[str], ranges: Column, order: list[str], value: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over what comes earlier in its
    group. ``ranges`` numbers stretches of the order; only they are summed up whole."""
    marked = rows.withColumn("_range", ranges)
    keys = [F.col(c).alias(f"_of_{c}") for c in [*group, "_range"]]
    sums = marked.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    own_group = [f"_of_{c}" for c in group]
    earlier = Window.partitionBy(*own_group).orderBy("_of__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_earlier", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    condition = F.col("_range") == F.col("_of__range")
    for c in group:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    joined = marked.join(sums, condition).drop(*own_group, "_of__range")
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return joined.withColumn("before", F.col("_earlier") + own).drop("_earlier", "_range")


def finish_times(docs: DataFrame, seed: str, most: int, per_range: int) -> DataFrame:
    """One row per document with its queue position and its source's target."""
    sized = written_once(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), queue_key(seed).alias("queue")),
        "mix-sizes",
    )
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written_once(source_targets(by_source, most), "mix-targets")
    width = max(1, -(-sized.count() // per_range))
    ranges = F.floor(F.conv(F.substring("queue", 1, 8), 16, 10).cast("long") * F.lit(width) / F.lit(2**32))
    placed = running_sum(sized, ["source"], ranges, ["queue", "doc_id", "size"], "size")
    t = targets.withColumnRenamed("source", "_source")
    return placed.join(t, placed["source"].eqNullSafe(t["_source"]), "left").drop("_source")


def copies(placed: DataFrame, most: int) -> DataFrame:
    """A row per document copy that may be reached, with its virtual finish time."""
    rounds = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("copy")
    through = F.col("copy") * F.col("source_size") + F.col("before") + F.col("size")
    return (
        placed.filter("size > 0")
        .select("source", "queue", "doc_id", "size", "before", "source_size", "target", rounds)
        .withColumn("finish", through / F.col("target"))
    )


ORDER = ["finish", "source", "queue", "doc_id", "copy"]


def cut(placed: DataFrame, total: int, most: int, per_range: int) -> dict | None:
    """The first copy that does not fit whole, with the words left for it."""
    rows = copies(placed, most)
    width = max(1, -(-placed.count() // per_range))
    ranges = F.least(F.floor(F.col("finish") * F.lit(width)), F.lit(8 * width))
    sums = rows.groupBy(ranges.alias("_range")).agg(F.sum("size").alias("_sum"))
    so_far = Window.orderBy("_range")
    reached = sums.withColumn("_through", F.sum("_sum").over(so_far)).filter(F.col("_through") > total)
    first = reached.orderBy("_range").select("_range", (F.col("_through") - F.col("_sum")).alias("_before")).first()
    if first is None:
        return None
    inside = Window.partitionBy().orderBy(*[F.col(c).asc_nulls_first() for c in ORDER])
    there = rows.filter(ranges == first["_range"]).select(*ORDER, "size")
    there = there.withColumn("_through", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    over = there.filter(F.col("_through") + F.lit(first["_before"]) > total)
    row = over.orderBy("_through").first()
    return row.asDict() | {"left": total - first["_before"] - row["_through"] + row["size"]}


def mix(docs: DataFrame, seed: str = "mix", most: int = 3, per_range: int = 2_000) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and the source, one row per document."""
    placed = written_once(finish_times(docs, seed, most, per_range), "mix-queue")
    any_row = placed.select("total").first()
    at = cut(placed, any_row["total"], most, per_range) if any_row else None
    taken = F.lit(0)
    for copy in range(most):
        through = F.lit(copy) * F.col("source_size") + F.col("before") + F.col("size")
        finish = through / F.col("target")
        if at is None:
            part = F.col("size")
        else:
            key = F.struct(
                finish.alias("finish"), "source", "queue", "doc_id", F.lit(copy).alias("copy")
            )
            types = dict(placed.dtypes)
            stop = F.struct(
                F.lit(at["finish"]).cast("double").alias("finish"),
                *[F.lit(at[c]).cast(types[c]).alias(c) for c in ("source", "queue", "doc_id")],
                F.lit(at["copy"]).alias("copy"),
            )
            part = F.when(key < stop, F.col("size")).when(key == stop, F.lit(at["left"])).otherwise(0)
        taken = taken + F.when(F.col("size") > 0, part).otherwise(0)
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def report(docs: DataFrame, **settings) -> DataFrame:
    return mix(docs, **settings).select("doc_id", "size", "source_size", "target", "taken")
