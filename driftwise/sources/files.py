"""Logs in and results out: JSON lines, CSV and Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEEDBACK = ("feedback_id string, run_id string, kpi_id string, persona string, judgement string,"
            " submitted_by string, submitted_at timestamp, candidate_id string, correction string,"
            " note string, region string, movement_inr double")
APPLIED = ("change_id string, kpi_id string, target string, field_path string, from_value double,"
           " to_value double, applied_by string, applied_at timestamp, supporting int")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only log of JSON lines. The schema is given, never inferred;
    lines that are not JSON are left out, as a half-written last line may be."""
    rows = spark.read.schema(f"{schema}, _corrupt string") \
        .option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.filter("_corrupt is null").drop("_corrupt")


def write_csv(frame: DataFrame, path: str) -> None:
    """The rows behind a figure, for a spreadsheet."""
    frame.write.mode("overwrite").option("header", True).csv(path)


def write_report(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def append_evidence(frame: DataFrame, path: str, run_id: str,
                    partition_by: Sequence[str] = ("run_id",)) -> None:
    """Add one run's evidence to the table; earlier runs are never rewritten."""
    frame.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy(*partition_by).parquet(path)
