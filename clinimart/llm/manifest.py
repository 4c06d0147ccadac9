"""Merkle manifest of a dataset, and inclusion proofs by descent of its node store.

Every row is a leaf: the SHA-256 of its fields, each written with its length. Leaves of
a source stand in the order of their doc_id; 16 neighbours at a time have a parent, the
digest of their digests, until one node is left, the source's subroot. The subroots, in
order of the source, get parents in the same way up to the root.

The store is content-addressed: a record holds a node's digest and its children's
digests, and nothing says where a node is. A proof is found by descent: a request names
a leaf by its rank, whose digits to base 16 say which child to follow from the subroot
down (the source's rank does so from the root). Each step joins the digest reached with
its record, moves to the child of the digit and keeps the other children as a segment of
the path; reversed, the segments are the proof from the leaf to the root.

Requests with the same leading digits walk together, so a step has a row per distinct
prefix and not one per request: every request passes the root, but the root is joined
once. The last step joins up to 16 requests with their leaves' parent, where proofs are
hashed and folded at once; whole paths of single requests are never shuffled.

Leaves are numbered over sampled ranges (``operators.ordering``), so a source with a
third of all rows is spread over many tasks. Nothing depends on the number of tasks.

Nulls: a null field is written as ``-``; null sources are one source, the first; null
doc_ids come first in theirs, and are never tampered with. Equal doc_ids are ordered by
their leaves; repeated rows are leaves of their own with equal digests (equal
neighbourhoods then share one record). Empty text is a field of length 0. An empty table
has no root and no proofs. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import number_in_order
from ..sources.storage import written_once
from .text import ascii_lower

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SEGMENT = "array<struct<left: string, right: string>>"


def digest(parts: Column) -> Column:
    """SHA-256 in lower-case hex of an array of texts, one after the other."""
    return F.sha2(F.array_join(parts, ""), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of a row's fields: UTF-8 length, colon and value, or ``-`` for null."""
    written = [
        F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-"))
        for f in (field.cast("string") for field in fields)
    ]
    return F.sha2(F.concat(*written), 256)


@dataclass
class Manifest:
    """``leaves``: ``tree, place`` (ranks of source and row, from 0) and the given
    columns. ``trees``: ``tree, source, size, height, subroot``. ``records[h]`` and
    ``top_records[h]``: ``digest, children`` of nodes ``h`` above the leaves or subroots."""

    leaves: DataFrame
    trees: DataFrame
    records: dict[int, DataFrame]
    top_records: dict[int, DataFrame]
    root: str | None


def _grow(level: DataFrame, size: int, purpose: str) -> tuple[dict[int, DataFrame], DataFrame]:
    """Parents of ``level`` (``tree, place, size, digest``) up to one node per tree:
    records by height, and ``tree, height, digest`` of the nodes left. ``size`` is the
    largest tree's."""
    records, tops, height = {}, [], 0
    while True:
        done = level.filter("size = 1")
        tops.append(done.select("tree", F.lit(height).alias("height"), "digest"))
        if size <= 1:
            break
        runs = (
            level.filter("size > 1")
            .groupBy("tree", F.expr(f"place div {FANOUT}").alias("up"), "size")
            .agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("run"))
        )
        parents = runs.select(
            "tree",
            F.col("up").alias("place"),
            F.expr(f"(size + {FANOUT - 1}) div {FANOUT}").alias("size"),
            F.transform("run", lambda node: node["digest"]).alias("children"),
        )
        level = written_once(parents.withColumn("digest", digest(F.col("children"))), purpose)
        height, size = height + 1, -(-size // FANOUT)
        records[height] = level.select("digest", "children").dropDuplicates(["digest"])
    last = tops[0]
    for more in tops[1:]:
        last = last.unionByName(more)
    return records, last


def build(leaves: DataFrame) -> Manifest:
    """Manifest of ``leaves``: ``source, doc_id, leaf`` and columns to carry. They are
    written once, as they are read for sampling, sizes and the tree."""
    leaves = written_once(leaves, "leaves")
    tie = F.xxhash64(F.monotonically_increasing_id())  # spreads rows that are equal in all
    numbered = number_in_order(
        leaves.withColumn("_tie", tie), ["doc_id", "leaf", "_tie"], "_number", ["source"]
    ).drop("_tie")
    sizes = leaves.groupBy("source").agg(F.count("*").alias("size"))
    sources = number_in_order(sizes, ["source"], "_tree")
    sources = sources.select((F.col("_tree") - 1).alias("tree"), "source", "size")
    of_source = sources.select(F.col("source").alias("_source"), "tree", "size")
    placed = (
        numbered.join(of_source, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("place", F.col("_number") - 1)
        .drop("_source", "_number")
    )
    count, largest = sources.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    nodes = placed.select("tree", "place", "size", F.col("leaf").alias("digest"))
    records, tops = _grow(nodes, largest, "merkle")
    subroots = tops.withColumnRenamed("digest", "subroot")
    trees = written_once(sources.join(subroots, "tree"), "subroots")
    top = trees.select(
        F.lit(0).alias("tree"), F.col("tree").alias("place"), F.lit(count).alias("size"),
        F.col("subroot").alias("digest"),
    )
    top_records, roots = _grow(top, count, "merkle-top")
    root = roots.first()
    return Manifest(placed.drop("size"), trees, records, top_records, root.digest if root else None)


def _segment(digit: Column) -> Column:
    """The other children of a node, before and after the one of ``digit`` (from 0)."""
    before = F.slice("children", F.lit(1), digit)
    after = F.slice("children", digit + 2, F.lit(FANOUT))
    return F.struct(
        F.array_join(before, "").alias("left"), F.array_join(after, "").alias("right")
    )


def _step(frontier: DataFrame, records: DataFrame, wanted: DataFrame) -> DataFrame:
    """One level down: each node of ``frontier`` (``tree, place, digest, path`` and more)
    gives its children at the ``digits`` that ``wanted`` has for it."""
    reached = frontier.join(wanted, ["tree", "place"]).join(records, "digest")
    digit = F.col("_digit")
    more = [c for c in frontier.columns if c not in ("tree", "place", "digest", "path")]
    return reached.withColumn("_digit", F.explode("digits")).select(
        "tree",
        (F.col("place") * FANOUT + digit).alias("place"),
        F.get("children", digit).alias("digest"),
        F.concat("path", F.array(_segment(digit))).alias("path"),
        *more,
    )


def _prefixes(wanted: DataFrame, heights: int) -> dict[int, DataFrame]:
    """Per height the prefixes of ``wanted`` (distinct ``tree, place``) with the digits
    that continue them."""
    found, below = {}, wanted
    for height in range(1, heights + 1):
        up = F.expr(f"place div {FANOUT}").alias("up")
        digits = F.sort_array(F.collect_list(F.expr(f"cast(place % {FANOUT} as int)"))).alias("digits")
        rows = below.groupBy("tree", up).agg(digits)
        found[height] = rows.select("tree", F.col("up").alias("place"), "digits")
        below = found[height].select("tree", "place")
    return found


def prove(manifest: Manifest, requests: DataFrame, payload: Sequence[str]) -> DataFrame:
    """Proofs for ``requests`` (``tree, place`` and the ``payload`` columns, a row per
    leaf): the payload, ``leaf`` (as the descent finds it), ``subroot``, ``root`` and
    ``path``, the siblings to the left and right of each level from the leaf up."""
    spark = requests.sparkSession
    if manifest.root is None:
        return requests.select(
            *payload, *[F.lit(None).cast("string").alias(c) for c in ("leaf", "subroot", "root")],
            F.lit(None).cast(_SEGMENT).alias("path"),
        )
    parents = requests.select("tree", F.expr(f"place div {FANOUT}").alias("place")).distinct()
    parents = written_once(parents, "requests")
    asked = parents.select(F.lit(0).alias("tree"), F.col("tree").alias("place")).distinct()
    heights = max(manifest.top_records, default=0)
    digits = _prefixes(asked, heights)
    at = spark.range(1).select(
        F.lit(0).alias("tree"), F.lit(0).cast("bigint").alias("place"),
        F.lit(manifest.root).alias("digest"), F.expr(f"cast(array() as {_SEGMENT})").alias("path"),
    )
    at = written_once(at, "root")  # as a table, so that its join is one on keys
    for height in range(heights, 0, -1):
        at = _step(at, manifest.top_records[height], digits[height])
    subroots = at.select(F.col("place").alias("tree"), F.col("digest").alias("subroot"), "path")
    starts = written_once(subroots.join(manifest.trees.select("tree", "height"), "tree"), "starts")

    def beginning(height: int) -> DataFrame:
        return starts.filter(F.col("height") == height).select(
            "tree", F.lit(0).cast("bigint").alias("place"), F.col("subroot").alias("digest"),
            "path", "subroot",
        )

    heights = max(manifest.records, default=0)
    digits = _prefixes(parents, heights - 1)
    at = beginning(heights)
    for height in range(heights, 1, -1):
        at = _step(at, manifest.records[height], digits[height - 1])
        at = at.unionByName(beginning(height - 1))
    found = beginning(0).withColumns({"children": F.array("digest"), "lone": F.lit(True)})
    if heights:
        last = at.join(manifest.records[1], "digest").withColumn("lone", F.lit(False))
        found = last.unionByName(found)
    found = found.select("tree", F.col("place").alias("up"), "children", "path", "subroot", "lone")
    digit = F.expr(f"cast(place % {FANOUT} as int)")
    rows = requests.withColumn("up", F.expr(f"place div {FANOUT}")).join(found, ["tree", "up"])
    path = F.when(F.col("lone"), F.col("path")).otherwise(
        F.concat("path", F.array(_segment(digit)))
    )
    return rows.select(
        *payload,
        F.get("children", digit).alias("leaf"),
        "subroot",
        F.lit(manifest.root).alias("root"),
        F.reverse(path).alias("path"),
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(
        path, leaf, lambda node, run: F.sha2(F.concat(run["left"], node, run["right"]), 256)
    )


def audit(docs: DataFrame, altered: Column, changed_text: Column) -> DataFrame:
    """Proofs of all rows of ``docs``, checked against the rows as they are now: where
    ``altered`` holds, the row's text is ``changed_text``."""
    fields = [F.col(name) for name in FIELDS]
    now = leaf_digest([*fields[:-1], changed_text])
    leaves = docs.select(
        F.col("source").cast("string").alias("source"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        leaf_digest(fields).alias("leaf"),
        F.when(altered, now).alias("now"),
    )
    manifest = build(leaves)
    proofs = prove(manifest, manifest.leaves.drop("leaf"), ["doc_id", "now"])
    siblings = F.transform("path", lambda run: F.concat(run["left"], run["right"]))
    checked = proofs.select(
        "doc_id", "leaf", "subroot", "root",
        digest(siblings).alias("proof_sha256"),
        folded(F.coalesce("now", "leaf"), F.col("path")).alias("folded_root"),
    )
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_audit(docs: DataFrame) -> DataFrame:
    """The audit after a known change: texts of one in five documents, chosen by their
    doc_id, have their A-Z lower-cased."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return audit(docs, F.coalesce(chosen, F.lit(False)), ascii_lower(F.col("text")))
