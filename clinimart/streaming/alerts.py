"""Long-stay alerts: one rule, for a table at rest and for its change stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.bands import LONG_STAY_DAYS
from ..schemas import OPERATIONAL

ALERT_FIELDS = ["patient_id", "ward_id", "days_stayed", "alert_message"]


def long_stays(df: DataFrame) -> DataFrame:
    """Rows with a stay beyond the limit, with their alert text. A stay of
    unknown length is not long."""
    # Fixed value: wording of the alert.
    message = F.concat(
        F.lit("Patient "), F.col("patient_id").cast("string"),
        F.lit(" has stayed "), F.col("days_stayed").cast("string"),
        F.lit(" days in ward "), F.col("ward_id").cast("string"),
        F.lit(". Review required."),
    )
    return df.filter(F.col("days_stayed") > LONG_STAY_DAYS).withColumn("alert_message", message)


def alerts_at_rest(bed_allocation: DataFrame) -> DataFrame:
    """The rule over the latest state of all allocations."""
    return long_stays(bed_allocation).select("allocation_id", *ALERT_FIELDS)


def alerts_of_changes(changes: DataFrame) -> DataFrame:
    """The rule over changes: only an update raises an alert, and every update
    raises its own, identified by allocation and change number."""
    return long_stays(changes.filter(F.col("operation") == "update")).select(
        "allocation_id", "change_seq", *ALERT_FIELDS, F.current_timestamp().alias("created_at")
    )


def start_alert_stream(
    spark: SparkSession, changes_path: str, log_path: str, checkpoint_path: str,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Append alerts for all changes present and stop; the next start goes on
    where this one ended. The rule keeps no state, the file sink commits each
    batch once, and the checkpoint makes a restart after a failure safe."""
    changes = (
        spark.readStream.schema(OPERATIONAL["allocation_change"])
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(changes_path)
    )
    return (
        alerts_of_changes(changes)
        .writeStream.format("parquet")
        .option("path", log_path)
        .option("checkpointLocation", checkpoint_path)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def read_alert_log(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.schema(OPERATIONAL["alert_log"]).parquet(log_path)
