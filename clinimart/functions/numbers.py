"""Exact ratios and percentages.

Rates, averages and percentage changes are reported with two decimals, rounded
half away from zero. They are computed on integers and decimals only, so a
result does not depend on the order in which partial sums arrive and two runs
over the same data agree to the last digit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = "decimal(18,2)"
MONEY = "decimal(28,2)"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


# Values up to 10^12 have products that fit a BIGINT at four decimals.
_RATIO = """
CAST(CAST(sign({n}) AS INT) * CASE
  WHEN abs({n}) < 1000000000000 AND {d} < 1000000000000 THEN
    (CAST(abs({n}) * 10000 AS BIGINT) * 200 + CAST({d} * 10000 AS BIGINT))
    div (2 * nullif(CAST({d} * 10000 AS BIGINT), 0))
  ELSE
    (CAST(abs({n}) AS DECIMAL(30,4)) * 200 + CAST({d} AS DECIMAL(24,4)))
    div (2 * nullif(CAST({d} AS DECIMAL(24,4)), 0))
END AS DECIMAL(18,0)) * 0.01"""


def exact_ratio(numerator: str, denominator: str) -> Column:
    """``numerator / denominator`` to two places; NULL when either is NULL or
    the denominator is zero. Both are SQL expressions, usually column names,
    with up to four decimals, the denominator is not negative, and the result is
    below 10^16 as its type says (more is an error, not a wrong number). Ordinary
    values stay in BIGINT arithmetic; only huge ones take the decimal way."""
    return F.expr(ratio_sql(numerator, denominator)).cast(RATE)


def ratio_sql(numerator: str, denominator: str) -> str:
    """The same as text of a SQL expression."""
    return _RATIO.format(n=f"({numerator})", d=f"({denominator})")


def percentage(part: str, whole: str) -> Column:
    """100 * part / whole to two places, NULL for an empty whole."""
    return exact_ratio(f"100 * CAST({part} AS DECIMAL(26,4))", whole)


def change_percentage(current: str, previous: str) -> Column:
    """Relative change from ``previous`` to ``current`` in percent."""
    return percentage(f"{current} - {previous}", previous)


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def spend(average: Column, cases: Column) -> Column:
    """Money behind ``cases`` fact cases with this average; an unknown average
    counts as nothing spent while its cases still count."""
    return (or_zero(average) * cases).cast("decimal(18,2)")


def to_number(value: Column) -> Column:
    """A table cell as a number for sorting and display: a missing or blank
    cell reads as zero, text that is not a finite decimal number (such as "12D",
    "0x10" or "Infinity") reads as NULL."""
    text = F.trim(value.cast("string"))
    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0.0)).when(finite, number)
