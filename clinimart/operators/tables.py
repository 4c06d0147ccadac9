"""Search, sort and display of a result table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import to_number
from ..functions.text import natural_key, show_count, show_money, show_percent, show_text
from .ordering import number_in_order

FORMATS = {"count": show_count, "money": show_money, "percent": show_percent, "text": show_text}


def search(df: DataFrame, text: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with ``text`` somewhere in the named (visible) columns; case and
    surrounding blanks are ignored, and a blank search keeps every row."""
    wanted = text.strip().lower()
    if not wanted:
        return df
    hits = [
        F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(wanted)
        for c in (columns or df.columns)
    ]
    return df.filter(reduce(lambda a, b: a | b, hits))


def with_sort_keys(df: DataFrame, column: str) -> DataFrame:
    """Keys of a table sort: the cell as a number, and as natural text."""
    return df.withColumns(
        {"sort_number": to_number(F.col(column)), "sort_text": natural_key(F.col(column))}
    )


def sort_order(column: str, descending: bool = False, natural: bool = True) -> list[Column]:
    """Order of a table sort: numbers by value, other cells by text after them (before
    them when descending). Cells of equal value are ordered by text too. Text is
    ``natural`` (digit runs by value) or plain; both ignore case first."""
    number, text = to_number(F.col(column)), F.coalesce(F.col(column).cast("string"), F.lit(""))
    keys = [natural_key(F.col(column))] if natural else [F.lower(text), text]
    if descending:
        return [number.desc_nulls_first(), *[key.desc() for key in keys]]
    return [number.asc_nulls_last(), *[key.asc() for key in keys]]


def sort_table(df: DataFrame, column: str, descending: bool = False, natural: bool = True) -> DataFrame:
    """Rows of ``with_sort_keys`` in the order of a table sort."""
    return with_sort_keys(df, column).orderBy(*sort_order(column, descending, natural))


def with_position(
    df: DataFrame, order: Sequence[str | Column], into: str = "position"
) -> DataFrame:
    """The rows with their place in an order, from 1, so that the order is part of the
    data and survives writing. The order must tell rows apart; ranges of it are numbered
    on their own and no task sorts the table."""
    return number_in_order(df, order, into)


def sorted_table(
    df: DataFrame, column: str, descending: bool = False, natural: bool = True, then: Sequence[str] = ()
) -> DataFrame:
    """A sorted table with its ``position``. Rows that the sort leaves equal keep the
    order of the columns ``then``, as the table had it before."""
    return with_position(df, [*sort_order(column, descending, natural), *then])


def display(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """The table as shown: each column in its format, plain text otherwise."""
    return df.select(*[FORMATS[formats.get(c, "text")](F.col(c)).alias(c) for c in df.columns])
