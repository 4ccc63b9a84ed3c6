"""Parquet table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tidemark.schemas import METRICS_SCHEMA


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def write_station_metrics(metrics: DataFrame, path: str, mode: str = "append") -> None:
    """Store 1-minute metrics partitioned by ``date`` (UTC day of
    ``window_start``) so a time-bounded read skips whole folders."""
    (metrics.withColumn("date", F.date_format("window_start", "yyyy-MM-dd"))
     .write.mode(mode).partitionBy("date").parquet(path))


def read_station_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Raw 1-minute metrics stored as Parquet, with the fixed schema.

    Column pruning and filter pushdown reach the scan: callers select the
    columns they use and filter on ``window_start`` / ``station_id``.
    """
    return spark.read.schema(METRICS_SCHEMA).parquet(path)
