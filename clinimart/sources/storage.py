"""Reading and writing operational and warehouse tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import OPERATIONAL, WAREHOUSE, operational_schema


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors reach, as the cluster names it. Only a local
    session without the setting gets a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def new_folder(spark: SparkSession, purpose: str) -> str:
    return f"{shared_folder(spark)}/clinimart/{purpose}-{uuid.uuid4().hex}"


def written_once(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` computed now and read back from the shared folder. For a small
    aggregate that a plan reads several times: what it was made from is scanned
    once, and a lost executor loses nothing."""
    folder = new_folder(df.sparkSession, purpose)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def open_partitions(spark: SparkSession, files: int) -> Iterator[None]:
    """Inside, a partitioned write keeps up to ``files`` files of a task open and appends
    each row where it belongs, instead of sorting all rows by partition; Spark sorts what
    comes for further partitions."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, files)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query are removed as soon as it has ended, and not
    when the driver collects its garbage. For a query that is written, or made and collected,
    inside and not run a second time."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def remove_folder(spark: SparkSession, folder: str) -> bool:
    """Remove a folder of any file system that Spark writes to; False if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_operational(
    spark: SparkSession, root: str, table: str, columns: list[str] | None = None
) -> DataFrame:
    """Scan of an operational table with its declared schema; only the named
    columns are read."""
    df = spark.read.schema(OPERATIONAL[table]).parquet(f"{root}/{table}")
    return df.select(*columns) if columns else df


def read_operational_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    split_on: str,
    lower: int,
    upper: int,
    splits: int,
    columns: list[str] | None = None,
    **options: str,
) -> DataFrame:
    """The same scan from a relational database, read in parallel by ranges of
    the integer key ``split_on``. Driver class, user and password come in
    ``options`` or from the Spark configuration."""
    df = (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn=split_on,
            lowerBound=str(lower),
            upperBound=str(upper),
            numPartitions=str(splits),
            **options,
        )
        .load()
    )
    return df.select(*columns) if columns else df


def write_operational(df: DataFrame, root: str, table: str) -> None:
    fields = operational_schema(table).fields
    rows = df.select(*[F.col(f.name).cast(f.dataType) for f in fields])
    with shuffles_removed(df.sparkSession):
        rows.write.mode("overwrite").parquet(f"{root}/{table}")


def read_dimension(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.schema(WAREHOUSE[table]).parquet(f"{root}/{table}")
