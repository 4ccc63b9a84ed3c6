"""Append-only, partitioned JSON sinks for serving observability records.

Layout (partition directories instead of one file per minute: Spark writes
part files, never appends to an existing file):

    <base>/artifacts/serving/events/date=YYYY-MM-DD/part-*.json
    <base>/artifacts/serving/metrics/date=YYYY-MM-DD/hour=HH/minute=MM/part-*.json

Records keep NULL fields and ISO-8601 UTC timestamps with a ``Z`` suffix.
An empty batch writes nothing. Appends never rewrite earlier files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import iso_text
from tidemark.sources.commits import CommitLog


def metrics_partitions(windows: DataFrame) -> DataFrame:
    ws = F.col("window_start")
    return (windows.withColumn("date", F.date_format(ws, "yyyy-MM-dd"))
            .withColumn("hour", F.date_format(ws, "HH"))
            .withColumn("minute", F.date_format(ws, "mm")))


def event_partitions(events: DataFrame) -> DataFrame:
    return events.withColumn("date", F.date_format(F.col("event_time"), "yyyy-MM-dd"))


def utc_text(df: DataFrame) -> DataFrame:
    """Timestamps as ISO-8601 UTC text with 'Z' (naive columns hold UTC wall time)."""
    return df.select(*[iso_text(F.col(f.name), "Z").alias(f.name)
                       if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(f.name)
                       for f in df.schema.fields])


METRICS_DIR = "artifacts/serving/metrics"
EVENTS_DIR = "artifacts/serving/events"
METRICS_BY, EVENTS_BY = ("date", "hour", "minute"), ("date",)
NULLS_KEPT = {"ignoreNullFields": "false"}


def clustered(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows of a folder side by side, so a write makes few files in it; a
    folder that holds more than a task should write is split over several
    (AQE rebalances partitions by their measured size)."""
    return df.hint("rebalance", *columns)


def _append_json(df: DataFrame, base_dir: str, folder: str, partition_cols: tuple[str, ...], batch_id: int | str | None) -> bool:
    log = CommitLog(df.sparkSession, base_dir, f"{base_dir.rstrip('/')}/_commits/{folder.rsplit('/', 1)[-1]}")
    batch = log.begin(batch_id if batch_id is not None else uuid.uuid4().hex)
    if batch is None:
        return False
    batch.write(clustered(df, partition_cols), folder, "json", partition_cols, **NULLS_KEPT)
    return batch.commit()


def write_metrics_windows(windows: DataFrame, base_dir: str, batch_id: int | str | None = None) -> bool:
    """Append window records under metrics/date=/hour=/minute=. Nothing for an empty batch.

    The batch is published as a whole by its manifest (``CommitLog``). With a
    ``batch_id``, a batch that was killed and is run again, or sent twice,
    stands in the folder once; False means that this id was there already.
    """
    return _append_json(utc_text(metrics_partitions(windows)), base_dir, METRICS_DIR, METRICS_BY, batch_id)


def write_deployment_events(events: DataFrame, base_dir: str, batch_id: int | str | None = None) -> bool:
    """Append deployment events under events/date=. Nothing for an empty batch. ``batch_id`` as for windows."""
    return _append_json(utc_text(event_partitions(events)), base_dir, EVENTS_DIR, EVENTS_BY, batch_id)
