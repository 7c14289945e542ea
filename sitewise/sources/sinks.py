"""Writers: wide tables, client assignments with their fingerprint, small result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.operators.quality import fingerprint


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """Parquet, optionally partitioned and sorted inside files so that filters skip row groups.

    Rows are rebalanced by partition value, so a value has few files, and a large one is
    split over several tasks.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_assignment(split: DataFrame, cohort: DataFrame, path: str) -> None:
    """(stay_id, client, split) keyed by id, with the fingerprint of the cohort it was made for."""
    mark = fingerprint(cohort).select("fingerprint").scalar()
    rows = split.select("stay_id", "client", "split").withColumn("cohort", mark)
    rows.write.mode("overwrite").parquet(path)


def read_assignment(spark: SparkSession, path: str, cohort: DataFrame) -> DataFrame:
    """The assignment, refused when it belongs to another cohort."""
    rows = spark.read.parquet(path)
    stored = [r["cohort"] for r in rows.select("cohort").distinct().limit(2).collect()]
    found = fingerprint(cohort).first()["fingerprint"]
    if any(s != found for s in stored):
        raise ValueError(f"assignment was made for cohort {', '.join(map(str, stored))}, this is {found}")
    return rows.drop("cohort")


def write_result_csv(df: DataFrame, path: str) -> None:
    """A summary table as one CSV file. For aggregated results only: one task writes it."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def write_packed(packed: DataFrame, path: str) -> None:
    """Array-per-series export, sorted by stay so that a reader can fetch single stays."""
    packed.sortWithinPartitions("stay_id", "feature").write.mode("overwrite").parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("stay_id", "feature", F.col("series"))
