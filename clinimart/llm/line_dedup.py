"""Line dedup with levelled sorted runs of line hashes.

Documents come in batches of rising doc_id. A run holds the hashes of the line
keys first seen in one batch, each once, with the document that owns it, bucketed and
sorted by hash; it is a table of the catalog, so Spark knows its buckets. A new batch is
shuffled once, into the same buckets, and merge-anti-joins the runs one after the
other without moving them: what is in no run is new, belongs to its smallest document
of this batch and forms a run of its own on level 0. When a level has ``fan`` runs they
are merged, bucket by bucket, into one of the next level, so a batch reads few runs
and a hash is rewritten once per level. Runs lie in the shared folder; a rerun of a
lost task writes the same run. In the end the lines meet the runs in a join of which
Spark can split a partition that a very common line fills.

There are as many buckets as shuffle partitions, and a batch for every ``batch_rows``
documents, ``batches`` at least; neither changes the result.

A line's key is the line stripped of ASCII white space at both ends with A-Z in
lower case; keys shorter than ``least`` code points are never dropped. Two 64-bit
hashes stand for a key, so two keys are confused with a chance near 2^-128.

Nulls: a null or empty text is one empty line, which stays. Rows with a null
doc_id count as one document that comes after all others. Rows of one doc_id are
one document: none is dropped because of another. A repeated line within the
document that keeps it stays in every place. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import new_folder
from .text import SPACES, ascii_lower

KEY = ["h1", "h2"]
LAST = 2**63 - 1


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def line_rows(docs: DataFrame, least: int) -> DataFrame:
    """A row per line that may be dropped: document, text, place and hash of its key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
        F.xxhash64(text).alias("of_text"),
        F.posexplode(F.transform(lines_of(text), line_key)).alias("at", "key"),
    )
    return lines.filter(F.char_length("key") >= least).select(
        "doc", "of_text", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2")
    )


class Runs:
    """Sorted runs by level; ``add`` compacts levels that are full."""

    def __init__(self, spark: SparkSession, fan: int):
        self.spark, self.fan = spark, fan
        self.folders: dict[str, str] = {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        folder = new_folder(self.spark, "line-run")
        name = "line_run_" + folder.rsplit("-", 1)[-1]
        # rows come in the buckets of the table, one per task
        writer = rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
        writer.option("path", folder).saveAsTable(name)
        self.folders[name] = folder
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs with no hash in common, side by side in their buckets."""
        both = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).withColumnRenamed("owner", "_owner").hint("merge")
            both = both.join(other, KEY, "full_outer")
            both = both.select(*KEY, F.coalesce("owner", "_owner").alias("owner"))
        return both

    def _replace(self, names: list[str]) -> str:
        run = self._write(self._merged(names))
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")  # from the catalog; its files stay
        return run

    def add(self, first: DataFrame, last: bool = False) -> None:
        """A run of what ``first`` (a row per key and its owner) has and no run does.
        After the ``last`` nothing is compacted."""
        run, level = self._write(self.unseen(first)), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if last or len(self.levels[level]) < self.fan:
                return
            full, self.levels[level] = self.levels[level], []
            run, level = self._replace(full), level + 1

    def unseen(self, first: DataFrame) -> DataFrame:
        for name in [run for level in reversed(self.levels) for run in level]:
            first = first.join(self.spark.table(name).hint("merge"), KEY, "left_anti")
        return first

    def all(self) -> DataFrame:
        """The rows of all runs, read as files: the bucket of a very common key would be
        one task, whatever meets it there."""
        folders = [self.folders[run] for level in self.levels for run in level]
        return self.spark.read.schema("h1 long, h2 long, owner long").parquet(*folders)


def batch_bounds(docs: DataFrame, batches: int, batch_rows: int) -> list[int]:
    """Upper doc_id of each batch; they only spread the work, never the result."""
    batches = max(batches, -(-docs.count() // batch_rows))
    steps = [k / batches for k in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), steps, 1000)).first()[0] if steps else []
    return sorted({*(cuts or []), LAST})


def owners(lines: DataFrame, bounds: list[int], fan: int) -> DataFrame:
    """The smallest document of each key, found batch by batch against the runs."""
    runs, below = Runs(lines.sparkSession, fan), -(2**63)
    for k, bound in enumerate(bounds):
        batch = lines.filter((F.col("doc") > below) | F.lit(not k)).filter(F.col("doc") <= bound)
        runs.add(batch.groupBy(*KEY).agg(F.min("doc").alias("owner")), last=bound == bounds[-1])
        below = bound
    return runs.all()


def dropped_lines(
    docs: DataFrame, least: int = 10, batches: int = 4, batch_rows: int = 100_000_000, fan: int = 3
) -> DataFrame:
    """Places of the lines to drop, an array for each document and text that has any."""
    spark = docs.sparkSession
    folder = new_folder(spark, "lines")
    line_rows(docs, least).write.parquet(folder)
    lines = spark.read.parquet(folder)
    first = owners(lines, batch_bounds(docs, batches, batch_rows), fan)
    late = lines.join(first, KEY).filter(F.col("doc") > F.col("owner"))
    return late.groupBy("doc", "of_text").agg(F.collect_set("at").alias("dropped"))


def without_repeated_lines(docs: DataFrame, **settings) -> DataFrame:
    """``_row`` (the document's own columns), ``n_lines``, ``n_dropped`` and
    ``kept_text``."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("of_text"),
    )
    found = rows.join(dropped_lines(docs, **settings), ["doc", "of_text"], "left")
    text, lines = F.col("_row.text"), lines_of(F.col("_row.text"))
    dropped = F.coalesce(F.size("dropped"), F.lit(0))
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
    kept = F.array_join(F.transform(places, lambda at: F.get(lines, at)), "\n")
    return found.select(
        "_row",
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("dropped").isNull(), 0).otherwise(dropped).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.coalesce(text, F.lit(""))).otherwise(kept).alias("kept_text"),
    )


def report(docs: DataFrame, **settings) -> DataFrame:
    done = without_repeated_lines(docs.select("doc_id", "text"), **settings)
    return done.select(
        F.col("_row.doc_id").alias("doc_id"),
        "n_lines",
        "n_dropped",
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"),
    )


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """All documents with their repeated lines gone; a null text stays null."""
    done = without_repeated_lines(docs, **settings)
    changed = F.col("n_dropped") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text")}
    return done.select(
        *[
            F.when(changed, new[c].cast(docs.schema[c].dataType)).otherwise(F.col(f"_row.`{c}`")).alias(c)
            if c in new
            else F.col(f"_row.`{c}`").alias(c)
            for c in docs.columns
        ]
    )
