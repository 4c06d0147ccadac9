"""Display formats and text keys for result tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import to_number

# Fixed value: what a cell without a usable number shows.
NOT_AVAILABLE = "n/a"


def show_count(value: Column) -> Column:
    """Grouped digits and up to three decimals."""
    shown = F.call_function("format_number", to_number(value), F.lit("#,##0.###"))
    return F.coalesce(shown, F.lit(NOT_AVAILABLE))


def show_money(value: Column) -> Column:
    return F.coalesce(F.format_number(to_number(value), 2), F.lit(NOT_AVAILABLE))


def show_percent(value: Column) -> Column:
    number = to_number(value)
    return F.when(number.isNull(), NOT_AVAILABLE).otherwise(F.format_string("%.2f%%", number))


def show_text(value: Column) -> Column:
    text = value.cast("string")
    return F.when(F.coalesce(text, F.lit("")) == "", NOT_AVAILABLE).otherwise(text)


def slug(value: Column) -> Column:
    """Lower-case label with every run of other characters as one hyphen."""
    text = F.lower(F.coalesce(value.cast("string"), F.lit("")))
    return F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def natural_key(value: Column) -> Column:
    """Sort key for natural text order: case ignored, digit runs by value.

    A run is written as its length (five digits) and its digits without leading
    zeros, so plain text comparison orders runs by value."""
    text = F.lower(F.coalesce(value.cast("string"), F.lit("")))
    pieces = F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def encode(piece: Column) -> Column:
        digits = F.regexp_replace(piece, "^0+", "")
        length = F.lpad(F.length(digits).cast("string"), 5, "0")  # runs up to 99,999 digits
        return F.when(piece.rlike("^[0-9]"), F.concat(length, digits)).otherwise(piece)

    return F.array_join(F.transform(pieces, encode), "")
