"""Row numbers and ranks that never sort a whole table in one task.

A window without a partition, or with a hot partition key, would bring all its
rows to one task. Everything here works in two levels: rows fall in ranges of the
order, totals of the ranges that come earlier are added up, and rows are ordered
only inside a range.

Ranges are quantiles that Spark samples from the order itself, so they hold about
the same number of rows for any keys: a third of all rows under one ``within`` key is
spread over many ranges, and sparse 64-bit ids do not give a range of their own each.
Their number is that of the shuffle partitions, which is all that a single task adds
up. ``rank_rows`` instead counts per distinct value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written_once

_PLACE_BITS = 33


def rank_rows(df: DataFrame, order: Sequence[tuple[str, str]], into: str) -> DataFrame:
    """SQL ``RANK()`` over ``order``, a list of (column, "asc" or "desc").

    Works on the distinct values of the order columns, one column per level:
    rows ahead = rows with a better first value + rows with the same first and a
    better second value + ... A level's window partition therefore holds one row
    per distinct value of that column, however many rows share it, and the first
    level (which has no partition) should be a column with few distinct values,
    such as a percentage with two decimals. Columns must not be NULL.
    """
    names = [name for name, _ in order]
    counts = df.groupBy(*names).agg(F.count("*").alias("_rows"))
    ahead, total = counts.drop("_rows"), F.lit(1)
    for level, (name, direction) in enumerate(order):
        prefix, before = names[:level], f"_ahead{level}"
        sort = F.col(name).desc() if direction == "desc" else F.col(name).asc()
        better = (
            Window.partitionBy(*prefix).orderBy(sort).rowsBetween(Window.unboundedPreceding, -1)
        )
        step = (
            counts.groupBy(*prefix, name)
            .agg(F.sum("_rows").alias("_rows"))
            .select(*prefix, name, F.coalesce(F.sum("_rows").over(better), F.lit(0)).alias(before))
        )
        ahead = ahead.join(step, [*prefix, name])
        total = total + F.col(before)
    return df.join(ahead.select(*names, total.cast("bigint").alias(into)), names)


def lay_out(df: DataFrame, order: Sequence[str | Column], purpose: str = "ordered") -> DataFrame:
    """``df`` sorted by ``order`` over ranges and written, with the range of each row in
    ``_part`` and its place in the range, from 0, in ``_at``.

    NULL sorts as Spark sorts it. Rows with equal values in all of ``order`` stay in
    one range, so give an order that tells rows apart. ``df`` is read twice, once to
    sample its quantiles. As the result is written, later steps and retried tasks all
    see the same places.
    """
    id_ = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written_once(
        placed.select(
            "*",
            F.shiftright(id_, _PLACE_BITS).cast("int").alias("_part"),
            id_.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("_at"),
        ),
        purpose,
    )


def _earlier_ranges(laid: DataFrame, within: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Per ``within`` key and range: place of its first row, and totals of the ranges
    before it. One row per range and key that it holds, written so that Spark knows
    its size and broadcasts it only below its threshold."""
    sums = laid.groupBy(*within, "_part").agg(
        F.min("_at").alias("_first"), *[value.alias(name) for name, value in totals.items()]
    )
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return written_once(
        sums.select(
            *[F.col(k).alias(f"_within{i}") for i, k in enumerate(within)],
            F.col("_part").alias("_range"),
            "_first",
            *[F.sum(name).over(before).alias(name) for name in totals],
        ),
        "ranges",
    )


def _with_ranges(laid: DataFrame, ranges: DataFrame, within: Sequence[str]) -> DataFrame:
    same = F.col("_part") == F.col("_range")
    for i, key in enumerate(within):
        same &= F.col(key).eqNullSafe(F.col(f"_within{i}"))
    return laid.join(ranges, same).drop("_range", *[f"_within{i}" for i in range(len(within))])


def numbered(laid: DataFrame, into: str, within: Sequence[str] = ()) -> DataFrame:
    """``laid`` (from ``lay_out``, ordered by ``within`` first) with the number of each
    row from 1, separately for each ``within`` key; NULL is a key of its own."""
    ranges = _earlier_ranges(laid, within, {"_before": F.count("*")})
    number = F.coalesce("_before", F.lit(0)) + F.col("_at") - F.col("_first") + 1
    return _with_ranges(laid, ranges, within).select(*laid.columns, number.alias(into))


def number_in_order(
    df: DataFrame, order: Sequence[str | Column], into: str, within: Sequence[str] = ()
) -> DataFrame:
    """Number rows from 1 in ``order``, separately for each ``within`` key, for keys of
    any type and spread."""
    return numbered(lay_out(df, [*within, *order]), into, within).drop("_part", "_at")


def running_totals(laid: DataFrame, within: Sequence[str], totals: dict[str, str]) -> DataFrame:
    """``laid`` (from ``lay_out``, ordered by ``within`` first) with a total per entry of
    ``totals`` (new column: summed column) over all earlier rows of the same key, 0 for
    the first."""
    sums = {f"_sum_{new}": F.sum(old) for new, old in totals.items()}
    ranges = _earlier_ranges(laid, within, sums)
    here = (
        Window.partitionBy(*within, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = laid.withColumns(
        {new: F.coalesce(F.sum(old).over(here), F.lit(0)) for new, old in totals.items()}
    )
    added = {new: F.col(new) + F.coalesce(f"_sum_{new}", F.lit(0)) for new in totals}
    return (
        _with_ranges(inside, ranges, within).withColumns(added).drop("_first", "_part", "_at", *sums)
    )
