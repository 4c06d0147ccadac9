"""Declared constraints as checks, and load reconciliation.

Every check gives one row per rule with the number of rows looked at and the
number that break it, also when none does. All rules of a table are counted in
one pass over it, keys and references included.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import month_label
from ..functions.numbers import or_zero
from ..schemas import (
    DOMAIN_RULES,
    FOREIGN_KEYS,
    LENGTH_RULES,
    PRIMARY_KEYS,
    WAREHOUSE_FOREIGN_KEYS,
    required_columns,
)
from ..sources.storage import written_once

Tables = Callable[[str], DataFrame]
# Size of a table, or of its keys, of which all keys are counted at a time.
TURN_BYTES = 1 << 29


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _count_rules(df: DataFrame, table: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """One pass: rows of ``df`` that break each rule, as one row per rule."""
    totals = df.agg(
        F.count("*").alias("checked_rows"),
        *[F.count_if(broken).alias(f"_{i}") for i, (_, broken) in enumerate(rules)],
    )
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("rule_name"), F.col(f"_{i}").alias("violations"))
            for i, (name, _) in enumerate(rules)
        ]
    )
    return totals.select(
        F.lit(table).alias("table_name"), "checked_rows", F.explode(entries).alias("rule")
    ).select("table_name", "rule.rule_name", "checked_rows", "rule.violations")


def null_violations(tables: Tables, names: Sequence[str]) -> DataFrame:
    """Missing values in required columns of operational or warehouse tables, all
    columns of a table in one pass."""
    parts = []
    for table in names:
        rules = [(c, F.col(c).isNull()) for c in required_columns(table)]
        parts.append(_count_rules(tables(table), table, rules))
    return _union(parts)


def domain_violations(tables: Tables) -> DataFrame:
    """Values outside their declared domain, range or text length."""
    rules: dict[str, list[tuple[str, Column]]] = {}
    for table, column, rule in DOMAIN_RULES:
        rules.setdefault(table, []).append((f"{column} domain", ~F.expr(rule)))
    for table, column, longest in LENGTH_RULES:
        rules.setdefault(table, []).append((f"{column} length", F.length(column) > longest))
    return _union([_count_rules(tables(table), table, checks) for table, checks in rules.items()])


def _turns(df: DataFrame) -> int:
    """In how many turns the keys of a table are counted, by the size Spark knows of it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, -(-size // TURN_BYTES)) if size < 1 << 60 else 1


def _key_counts(df: DataFrame, own: Sequence[Sequence[str]], turn: int, turns: int) -> DataFrame:
    """Rows ``_n`` of each key of a turn, ``_rule`` is the place of the key's columns in
    ``own``. Keys keep their types and are not padded to text; the one key of a table that
    is bucketed by a part of it is counted where it lies."""

    def now(key: Sequence[str]) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(turns)) == turn

    if len(own) == 1:
        rows = df.filter(now(own[0])) if turns > 1 else df
        return rows.groupBy(*own[0]).agg(F.count("*").alias("_n")).select(F.lit(0).alias("_rule"), "_n")
    types = {c: df.schema[c].dataType for key in own for c in key}
    entries = []
    for i, key in enumerate(own):
        parts = [(F.col(c) if c in key else F.lit(None).cast(kind)).alias(c) for c, kind in types.items()]
        entry = F.struct(F.lit(i).alias("_rule"), *parts)
        entries.append(F.when(now(key), entry) if turns > 1 else entry)
    every = F.array(*entries)
    rows = df.select(F.explode(F.array_compact(every) if turns > 1 else every).alias("k")).select("k.*")
    return rows.groupBy("_rule", *types).agg(F.count("*").alias("_n")).select("_rule", "_n")


def _sums(counts: DataFrame, table: str) -> DataFrame:
    n = F.col("_n")
    summed = counts.groupBy("_rule").agg(
        F.sum(n).alias("checked_rows"),
        F.count_if(n > 1).alias("duplicate_keys"),
        F.sum(n - 1).alias("surplus_rows"),
    )
    return summed.withColumn("table_name", F.lit(table))


def _rules(spark: SparkSession, rows: Sequence[tuple], columns: str) -> DataFrame:
    """The list of rules as rows, so that a rule without data is reported too."""
    return spark.createDataFrame(list(rows), columns)


def duplicate_keys(
    tables: Tables, keys: dict[str, Sequence[Sequence[str]]] | None = None
) -> DataFrame:
    """Keys that occur more than once, and the rows beyond the first of each.

    ``keys`` lists the keys of each table. A table is scanned once for all its keys, with no
    more than their columns; keys are counted before and after a shuffle, which tables
    bucketed by a part of their key do without, and the counts are summed per rule. A table
    larger than ``TURN_BYTES`` is scanned once per turn: each takes its share of the keys, by
    their hash, and its shuffle is gone before the next. The last turn is left to the query."""
    keys = keys or {table: [key] for table, key in PRIMARY_KEYS.items()}
    names = [(table, i, ", ".join(key)) for table, own in keys.items() for i, key in enumerate(own)]
    parts = []
    for table, own in keys.items():
        df = tables(table).select(*dict.fromkeys(c for key in own for c in key))
        turns = _turns(df)
        for turn in range(turns):
            sums = _sums(_key_counts(df, own, turn, turns), table)
            parts.append(sums if turn == turns - 1 else written_once(sums, "key-counts"))
    counted = ["checked_rows", "duplicate_keys", "surplus_rows"]
    found = _union(parts).groupBy("table_name", "_rule").agg(*[F.sum(c).alias(c) for c in counted])
    rules = _rules(found.sparkSession, names, "table_name string, _rule int, key_columns string")
    return rules.join(found, ["table_name", "_rule"], "left").select(
        "table_name", "key_columns", *[or_zero(F.col(c)).alias(c) for c in counted]
    )


def orphans(tables: Tables, keys: Sequence[tuple[str, str, str, str]] = FOREIGN_KEYS) -> DataFrame:
    """Foreign keys without a parent; NULL keys refer to nothing and pass.

    A child table is scanned once for all its foreign keys, a parent once for all that
    refer to it: rows become (rule, value) pairs, children's pairs are counted before
    and after one shuffle, and one join with the parents' pairs answers all rules."""
    rules = [(i, child, column, parent) for i, (child, column, parent, _) in enumerate(keys)]

    def pairs(table: str, columns: list[tuple[int, str]]) -> DataFrame:
        entries = [
            F.struct(F.lit(i).alias("rule"), F.col(c).cast("string").alias("value")) for i, c in columns
        ]
        rows = tables(table).select(F.explode(F.array(*entries)).alias("p")).select("p.*")
        return rows.filter("value is not null")

    children: dict[str, list[tuple[int, str]]] = {}
    parents: dict[str, list[tuple[int, str]]] = {}
    for i, (child, column, parent, parent_column) in enumerate(keys):
        children.setdefault(child, []).append((i, column))
        parents.setdefault(parent, []).append((i, parent_column))
    used = _union([pairs(table, columns) for table, columns in children.items()])
    used = used.groupBy("rule", "value").agg(F.count("*").alias("n"))
    known = _union([pairs(table, columns) for table, columns in parents.items()])
    lost = (
        used.join(known, ["rule", "value"], "left_anti")
        .groupBy("rule")
        .agg(F.count("*").alias("orphan_keys"), F.sum("n").alias("orphan_rows"))
    )
    names = _rules(
        lost.sparkSession, rules, "rule int, table_name string, column_name string, parent_table string"
    )
    return names.join(lost, "rule", "left").select(
        "table_name", "column_name", "parent_table",
        *[or_zero(F.col(c)).alias(c) for c in ("orphan_keys", "orphan_rows")],
    )


def warehouse_orphans(tables: Tables) -> DataFrame:
    return orphans(tables, WAREHOUSE_FOREIGN_KEYS)


def row_counts(tables: Tables, names: Sequence[str]) -> DataFrame:
    return _union(
        [
            tables(name).agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"))
            for name in names
        ]
    )


def reconcile(fact_with_dates: DataFrame, dim_outcome: DataFrame, outcome: DataFrame) -> DataFrame:
    """Cases per month of the fact, and outcomes per label of the operations;
    a label that never occurs shows zero."""
    months = fact_with_dates.groupBy("year_num", "month_num").agg(
        F.sum("total_cases").alias("amount")
    )
    counts = outcome.groupBy(F.col("status").alias("outcome_label")).agg(
        F.count("*").alias("amount")
    )
    labels = dim_outcome.join(counts, "outcome_label", "left")
    return months.select(
        F.lit("cases by month").alias("measure"),
        month_label(F.col("year_num"), F.col("month_num")).alias("item"),
        "amount",
    ).unionByName(
        labels.select(
            F.lit("rows by outcome").alias("measure"),
            F.col("outcome_label").alias("item"),
            F.coalesce("amount", F.lit(0)).alias("amount"),
        )
    )


def dedup_append(
    existing: DataFrame, incoming: DataFrame, key: Sequence[str], first_by: Sequence[str]
) -> DataFrame:
    """Rows to append: keys not stored yet, each once. Of several incoming rows
    with a key the first by ``first_by`` wins, so the result does not depend on
    arrival; partial minima are taken before the shuffle."""
    rest = [c for c in incoming.columns if c not in key]
    order = [*first_by, *[c for c in rest if c not in first_by]]
    return (
        incoming.groupBy(*key)
        .agg(F.min(F.struct(*order)).alias("row"))
        .join(existing.select(*key), list(key), "left_anti")
        .select(*key, *[F.col(f"row.{c}").alias(c) for c in rest])
    )


def load_counters(load_rows: DataFrame) -> DataFrame:
    """Extracted rows, groups, loaded and skipped groups of a load."""
    status = F.col("load_status")
    return load_rows.agg(
        F.coalesce(F.sum("total_cases"), F.lit(0)).alias("extracted_rows"),
        F.count("*").alias("transformed_groups"),
        F.count_if(status == "loaded").alias("loaded_groups"),
        F.count_if(status == "skipped").alias("skipped_groups"),
    )
