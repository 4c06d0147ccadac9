"""Operational tables derived from the sample order tables.

Orders become visits, line items diagnoses and treatments, parts diseases and
medicines, suppliers doctors, nations wards. ``SampleTables`` writes each derived
table once and then scans the written copy, so that every job starts from
operational tables as it would in production.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import BUCKET_KEYS, bucket_count, read_bucketed, write_bucketed
from .storage import new_folder, read_operational, write_operational


def _choose(value: Column, labels: list[str]) -> Column:
    """labels[value], the last label for every larger value."""
    chain = F.when(value == 0, labels[0])
    for i, label in enumerate(labels[1:-1], start=1):
        chain = chain.when(value == i, label)
    return chain.otherwise(labels[-1])


class SampleMapping:
    """One method per operational table; nothing is computed until used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _scan(self, name: str, *columns: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").select(*columns)

    def _nations(self) -> DataFrame:
        nation = self._scan("nation", "n_nationkey", "n_name", "n_regionkey")
        region = self._scan("region", "r_regionkey", "r_name")
        return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))

    def patient(self) -> DataFrame:
        key = F.col("c_custkey")
        ages = ["0-17", "18-30", "31-45", "46-60", "61-75", "76+"]
        nation = self._scan("nation", "n_nationkey", "n_name")
        return (
            self._scan("customer", "c_custkey", "c_nationkey")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                key.alias("patient_id"),
                _choose(key % 6, ages).alias("age_group"),
                _choose(key % 3, ["M", "F", "O"]).alias("gender"),
                F.lit(None).cast("string").alias("blood_group"),
                F.col("n_name").alias("city"),
            )
        )

    def doctor(self) -> DataFrame:
        return (
            self._scan("supplier", "s_suppkey", "s_nationkey")
            .join(self._nations(), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("s_suppkey").alias("doctor_id"),
                F.col("n_name").alias("specialization"),
                (F.col("s_suppkey") % 20).cast("int").alias("experience_years"),
                F.col("r_name").alias("department"),
            )
        )

    def disease(self) -> DataFrame:
        number = F.substring("p_brand", 7, 10).cast("int")
        categories = ["Respiratory", "Cardiac", "Renal", "Endocrine", "Infectious"]
        tiers = ["Low", "Moderate", "High", "Critical"]
        return (
            self._scan("part", "p_brand")
            .distinct()
            .select(
                F.col("p_brand").alias("disease_code"),
                F.concat(F.lit("Condition "), "p_brand").alias("disease_name"),
                _choose(number % 5, categories).alias("category"),
                _choose(number % 4, tiers).alias("severity_tier"),
            )
        )

    def medicine(self) -> DataFrame:
        return self._scan("part", "p_partkey", "p_name", "p_type", "p_retailprice").select(
            F.col("p_partkey").alias("medicine_id"),
            F.col("p_name").alias("medicine_name"),
            F.col("p_type").alias("medicine_type"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("unit_cost"),
        )

    def ward(self) -> DataFrame:
        return self._nations().select(
            (F.col("n_nationkey") + 1).cast("int").alias("ward_id"),
            F.col("n_name").alias("ward_name"),
            F.col("r_name").alias("ward_type"),
            (F.col("n_nationkey") * 7 % 23 + 4).cast("int").alias("capacity"),
        )

    def visit(self) -> DataFrame:
        doctors = (
            self._scan("lineitem", "l_orderkey", "l_suppkey")
            .groupBy("l_orderkey")
            .agg(F.min("l_suppkey").alias("doctor_id"))
        )
        priority = F.col("o_orderpriority")
        return (
            self._scan("orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
            .join(doctors, F.col("o_orderkey") == F.col("l_orderkey"))
            .select(
                F.col("o_orderkey").alias("visit_id"),
                F.col("o_custkey").alias("patient_id"),
                "doctor_id",
                F.to_date("o_orderdate").alias("visit_date"),
                F.when(priority == "1-URGENT", "Emergency")
                .when(priority == "2-HIGH", "IPD")
                .otherwise("OPD")
                .alias("visit_type"),
            )
        )

    def diagnosis_lines(self) -> DataFrame:
        """Diagnoses before duplicates of (visit, disease) are merged."""
        part = self._scan("part", "p_partkey", "p_brand")
        return (
            self._scan("lineitem", "l_orderkey", "l_partkey", "l_quantity")
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("l_orderkey").alias("visit_id"),
                F.col("p_brand").alias("disease_code"),
                F.col("l_quantity").alias("quantity"),
            )
        )

    def diagnosis(self, buckets: int | None = None) -> DataFrame:
        """With ``buckets`` lines are put in that many partitions by visit, where their
        duplicates are merged; the rows stay there."""
        lines = self.diagnosis_lines()
        if buckets:
            lines = lines.repartition(buckets, "visit_id")
        return (
            lines.groupBy("visit_id", "disease_code")
            .agg(F.max("quantity").alias("quantity"))
            .select("visit_id", "disease_code", severity_of("quantity").alias("severity"))
        )

    def treatment(self) -> DataFrame:
        return self._scan(
            "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_linenumber"
        ).select(
            F.col("l_orderkey").alias("visit_id"),
            F.col("l_partkey").alias("medicine_id"),
            F.col("l_quantity").cast("decimal(8,2)").alias("dosage_mg"),
            (F.col("l_linenumber") + 3).cast("int").alias("duration_days"),
        )

    def bed_allocation(self) -> DataFrame:
        key = F.col("o_orderkey")
        still_open = (F.col("o_orderstatus") == "P") & (key % 7 == 0)
        stay = F.when(~still_open, (key % 20 + 2).cast("int"))
        allocations = (
            self._scan(
                "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority"
            )
            .filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
            .select(
                key.alias("allocation_id"),
                F.col("o_custkey").alias("patient_id"),
                (key % 25 + 1).cast("int").alias("ward_id"),
                F.to_date("o_orderdate").alias("admit_date"),
                F.date_add(F.to_date("o_orderdate"), stay).alias("discharge_date"),
            )
        )
        return with_days_stayed(allocations)

    def outcome(self) -> DataFrame:
        draw = (F.col("o_orderkey") * 7 + F.col("o_custkey") * 13) % 100
        return (
            self._scan("orders", "o_orderkey", "o_custkey", "o_orderdate")
            .filter(F.col("o_custkey") % 50 != 0)
            .select(
                F.col("o_orderkey").alias("visit_id"),
                F.when(draw < 55, "Recovered")
                .when(draw < 85, "Improved")
                .when(draw < 97, "Readmitted")
                .otherwise("Deceased")
                .alias("status"),
                F.date_add(
                    F.to_date("o_orderdate"), (F.col("o_orderkey") % 30 + 1).cast("int")
                ).alias("outcome_date"),
            )
        )

    def admission_request(self) -> DataFrame:
        key = F.col("o_orderkey")
        return (
            self._scan("orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
            .filter(F.col("o_orderpriority") == "3-MEDIUM")
            .select(
                key.alias("request_id"),
                F.col("o_custkey").alias("patient_id"),
                (key % 10).alias("doctor_id"),
                (key % 26 + 1).cast("int").alias("ward_id"),
                F.lit("IPD").alias("visit_type"),
                F.to_date("o_orderdate").alias("request_date"),
            )
        )

    def allocation_change(self) -> DataFrame:
        """Change feed of allocations: each is inserted without a stay, and
        updated once when its stay is known."""
        allocations = self.bed_allocation()
        shared = ["patient_id", "ward_id"]
        inserted = allocations.select(
            "allocation_id",
            F.lit(0).alias("change_seq"),
            F.lit("insert").alias("operation"),
            *shared,
            F.lit(None).cast("int").alias("days_stayed"),
        )
        updated = allocations.filter(F.col("days_stayed").isNotNull()).select(
            "allocation_id",
            F.lit(1).alias("change_seq"),
            F.lit("update").alias("operation"),
            *shared,
            "days_stayed",
        )
        return inserted.unionByName(updated)


def severity_of(quantity: str) -> Column:
    return (
        F.when(F.col(quantity) <= 25, "Mild")
        .when(F.col(quantity) <= 42, "Moderate")
        .otherwise("Severe")
    )


def with_days_stayed(allocations: DataFrame) -> DataFrame:
    """Generated column: length of the stay in days, NULL while admitted."""
    return allocations.withColumn("days_stayed", F.datediff("discharge_date", "admit_date"))


class SampleTables:
    """Operational tables of one sample folder, each written on first use: in the
    catalog where it has a bucket key, else as a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.mapping = SampleMapping(spark, sf_dir)
        self.root = new_folder(spark, "operational")
        self.database = "clinimart_" + self.root.rsplit("-", 1)[-1]
        self._written: dict[str, str] = {}

    @cached_property
    def buckets(self) -> int:
        return bucket_count(self.mapping.treatment().count())

    def path(self, table: str) -> str:
        """Folder of a table, or its name in the catalog."""
        if table not in self._written:
            if table in BUCKET_KEYS:
                placed = table == "diagnosis"
                rows = getattr(self.mapping, table)(*[self.buckets] * placed)
                self._written[table] = write_bucketed(
                    rows, self.root, self.database, table, self.buckets, placed
                )
            else:
                write_operational(getattr(self.mapping, table)(), self.root, table)
                self._written[table] = f"{self.root}/{table}"
        return self._written[table]

    def table(self, table: str, *columns: str) -> DataFrame:
        place = self.path(table)
        if table in BUCKET_KEYS:
            return read_bucketed(self.spark, place, list(columns) or None)
        return read_operational(self.spark, self.root, table, list(columns) or None)
