"""Stored readings with a kept-up table of the last one of each station and day.

Point-in-time features look back without limit: a station silent for ten
days still has a last reading. Reading all history for every micro-batch of
requests finds it; so does a table with one row per station and day, which a
batch of readings extends as it is stored. ``near`` gives the two inputs of
``features.reconstruct``: the readings of the days around the requests, and
that table for everything before.

    readings/date=YYYY-MM-DD/      all readings
    last_of_day/date=YYYY-MM-DD/   per batch, the newest reading of each station in it

A batch's rows in the second table are added, not merged in place: the newest
of several is the newest, so a reader takes ``max`` over them and a repeated
batch changes nothing. ``compact`` makes one row of them again. Both tables
are published by one manifest (``CommitLog``).
"""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import METRICS_SCHEMA
from tidemark.sources.commits import CommitLog
from tidemark.sources.sinks import clustered

READINGS, LAST = "readings", "last_of_day"
NAMED_DAYS = 10_000  # days around the requests that a scan names; beyond, it reads from the first to the last


def newest_of_day(metrics: DataFrame) -> DataFrame:
    """The newest reading of each station and day: by ``window_start``, then ``emitted_at``, then the other values."""
    columns = [c for c in METRICS_SCHEMA.names if c not in ("station_id", "window_start", "emitted_at")]
    newest = F.max(F.struct("window_start", "emitted_at", *columns)).alias("r")
    day = F.to_date("window_start").alias("date")
    return metrics.groupBy("station_id", day).agg(newest).select("station_id", "date", "r.*").select(*METRICS_SCHEMA.names, "date")


class ReadingStore:
    def __init__(self, spark: SparkSession, base_dir: str):
        self.spark, self.base = spark, base_dir.rstrip("/")
        self.log = CommitLog(spark, base_dir)

    def append(self, metrics: DataFrame, batch_id: int | str | None = None) -> bool:
        """Store a batch of readings; False if this ``batch_id`` is stored already. Rows without station or time are left out."""
        batch = self.log.begin(batch_id if batch_id is not None else uuid.uuid4().hex)
        if batch is None:
            return False
        rows = metrics.select(*METRICS_SCHEMA.names).where("station_id IS NOT NULL AND window_start IS NOT NULL")
        path = batch.write(clustered(rows.withColumn("date", F.to_date("window_start")), ("date",)), READINGS, "parquet", ("date",))
        stored = self._read(path)  # what was staged, read again: the batch is evaluated once
        batch.write(clustered(newest_of_day(stored), ("date",)), LAST, "parquet", ("date",))
        return batch.commit()

    def stream(self, metrics: DataFrame, checkpoint: str, *, available_now: bool = False, processing_time: str | None = None):
        """Keep the store up from a stream of readings."""
        writer = metrics.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: self.append(df, n))
        if available_now:
            writer = writer.trigger(availableNow=True)
        elif processing_time:
            writer = writer.trigger(processingTime=processing_time)
        return writer.start()

    def _read(self, path: str) -> DataFrame:
        schema = METRICS_SCHEMA.simpleString()[len("struct<"):-1].replace(":", " ").replace(",", ", ") + ", date date"
        if not self.log.files.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    @property
    def readings(self) -> DataFrame:
        return self._read(f"{self.base}/{READINGS}")

    @property
    def last_of_day(self) -> DataFrame:
        """At least the newest reading of each station and day."""
        return self._read(f"{self.base}/{LAST}")

    def near(self, times: DataFrame, time_col: str = "obs_ts") -> tuple[DataFrame, DataFrame]:
        """(readings of the days of ``times`` and the two before each, the last ones of all days).

        The days are collected, as names of folders to read.
        """
        found = times.select(F.to_date(time_col).alias("d")).where("d IS NOT NULL").distinct().limit(NAMED_DAYS + 1).collect()
        days = sorted({r.d - timedelta(days=n) for r in found for n in range(3) if r.d > date.min + timedelta(days=n)})
        if len(found) > NAMED_DAYS:
            first, last = times.agg(F.min(F.to_date(time_col)), F.max(F.to_date(time_col))).first()
            rows = self.readings.where(F.col("date").between(first - timedelta(days=2), last))
        else:
            rows = self.readings.where(F.col("date").isin(days) if days else F.lit(False))
        return rows.drop("date"), self.last_of_day.drop("date")

    def compact(self, before: date) -> bool:
        """One row per station and day again for the days before ``before``.

        The new rows are published first and the old files removed after:
        a reader meets the old, both or the new, and takes the same maximum.
        """
        old = self.last_of_day.where(F.col("date") < F.lit(before))
        batch = self.log.begin(f"compact-{before.isoformat()}-{uuid.uuid4().hex[:8]}")
        files = [f for f in self.log.files.files_below(f"{self.base}/{LAST}") if f.split("/")[0][len("date="):] < before.isoformat()]
        batch.write(clustered(newest_of_day(old.drop("date")), ("date",)), LAST, "parquet", ("date",))
        done = batch.commit()
        for f in files:  # the new rows are published: the old ones are theirs already
            self.log.files.remove(f"{self.base}/{LAST}/{f}")
        return done
