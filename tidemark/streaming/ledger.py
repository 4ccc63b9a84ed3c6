"""Minute windows of a request log that arrives in batches, each written once.

A batch's rows become additive partial aggregates (``value_counts``: one row
per window and latency, so a hot minute is many small rows in many tasks,
never one state row). The partials are kept in hour folders and are all the
state there is. A window closes when the watermark (the newest completion
time less ``delay_seconds``) passes its end; its record is then made from
its partials of all batches.

Everything that a batch gives is published by one manifest (``CommitLog``)
together with the watermark, so a batch killed in the middle and run again
counts once:

    _partials/span_id=N/                          value counts, by hour (``span_hours``)
    artifacts/serving/metrics/                    every closed window, once
    artifacts/serving/metrics_corrections/        a closed window again, when late rows came: version, record
    artifacts/serving/metrics_withheld/           closed windows of a deployment without lineage
    artifacts/serving/rejects/reason=R/           rows in no window at their time: unknown outcome, no time,
                                                  invalid request, or late (counted in a correction)

``flush`` closes every window that is open, once: the end of a run. Rows that
come for such a window afterwards are late ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import micros
from tidemark.operators.metrics import (
    COUNTERS, WINDOW_KEYS, WINDOW_SECONDS, reject_reason, value_counts, window_records, windows_of, withheld_windows,
)
from tidemark.sources.commits import Batch, CommitLog
from tidemark.sources.files import Files
from tidemark.sources.sinks import METRICS_BY, METRICS_DIR, NULLS_KEPT, clustered, metrics_partitions, utc_text

PARTIALS, CORRECTIONS = "_partials", "artifacts/serving/metrics_corrections"
WITHHELD, REJECTS = "artifacts/serving/metrics_withheld", "artifacts/serving/rejects"
HOUR_US, SECOND_US = 3_600_000_000, 1_000_000

PARTIAL_SCHEMA = T.StructType(
    [T.StructField(c, T.TimestampNTZType()) for c in ("window_start", "window_end")]
    + [T.StructField(c, T.StringType()) for c in ("endpoint_name", "deployment_id")]
    + [T.StructField("latency_ms", T.DoubleType()), T.StructField("n", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in COUNTERS]
    + [T.StructField("newest", T.LongType()), T.StructField("span_id", T.LongType())])


class MetricsLedger:
    """The windows below ``base_dir``; the log of what was written lies in ``log_dir`` (beside the stream's checkpoint).

    ``lineage`` has the valid contexts; of several of one deployment each
    window has the one valid at its start. ``layout`` names the folders of a
    record, of date, hour and minute; partials are kept by ``span_hours``.
    """

    def __init__(self, spark: SparkSession, lineage: DataFrame, base_dir: str, log_dir: str | None = None,
                 delay_seconds: float = 60, time_col: str = "completed_at", layout: tuple[str, ...] = METRICS_BY,
                 span_hours: int = 1):
        self.spark, self.lineage, self.base = spark, lineage, base_dir.rstrip("/")
        self.delay_us, self.time_col = int(delay_seconds * SECOND_US), time_col
        self.layout, self.span_us = layout, span_hours * HOUR_US
        self.log = CommitLog(spark, base_dir, log_dir)

    # ---- reading
    def _read_partials(self, path: str) -> DataFrame:
        if not self.log.files.exists(path):
            return self.spark.createDataFrame([], PARTIAL_SCHEMA)
        return self.spark.read.schema(PARTIAL_SCHEMA).parquet(path)

    def partials(self) -> DataFrame:
        """The value counts of all committed batches; ``span_id`` prunes folders."""
        return self._read_partials(f"{self.base}/{PARTIALS}")

    @property
    def closed_us(self) -> int | None:
        """Windows that end up to here are written; None before the first row."""
        return self.log.state().get("closed")

    # ---- writing
    def ingest(self, rows: DataFrame, batch_id: int) -> bool:
        """Take one batch; False if it was taken before."""
        batch = self.log.begin(batch_id)
        if batch is None:
            return False
        state = self.log.state()
        closed = state.get("closed")
        rows = rows.withColumn(self.time_col, F.col(self.time_col).cast("timestamp_ntz")).persist()
        try:
            staged = self._stage_partials(batch, rows)
            fresh = self._read_partials(staged)
            newest = fresh.agg(F.max("newest")).first()[0]
            self._stage_rejects(batch, rows, closed)
            if newest is not None:
                reached = max(newest - self.delay_us, state.get("closed", newest - self.delay_us))
                known = self.partials().unionByName(fresh)
                counts, changed = self._closing(known, closed, reached), self._changed(known, fresh, closed)
                self._stage_windows(batch, counts if changed is None else counts.unionByName(changed), closed, batch_id)
                state = {"closed": reached}
            return batch.commit(state | {"batch": batch_id})
        finally:
            rows.unpersist()

    def flush(self) -> bool:
        """Close every open window; False if none is open."""
        state = self.log.state()
        closed = state.get("closed")
        if closed is None:
            return False
        still = self.partials().where(F.col("span_id") >= (closed // self.span_us) - 1).where(micros("window_end") > closed)
        last = still.agg(F.max(micros("window_end"))).first()[0]
        batch = self.log.begin(f"{state['batch']:020d}_flush") if last is not None else None
        if batch is None:
            return False
        self._stage_windows(batch, still)
        return batch.commit(state | {"closed": last})

    def _stage_partials(self, batch: Batch, rows: DataFrame) -> str:
        counts = value_counts(rows.where(reject_reason(self.time_col).isNull()), self.time_col)
        out = counts.withColumn("span_id", F.floor(micros("window_start") / self.span_us).cast("bigint"))
        return batch.write(clustered(out.select(*PARTIAL_SCHEMA.names), ("span_id",)), PARTIALS, "parquet", ("span_id",))

    def _late(self, closed: int):
        """A row whose window was closed before its batch came."""
        minute = WINDOW_SECONDS * SECOND_US
        return (F.floor(micros(self.time_col) / minute) + 1) * minute <= closed

    def _stage_rejects(self, batch: Batch, rows: DataFrame, closed: int | None) -> None:
        reason = reject_reason(self.time_col)
        if closed is not None:
            reason = F.coalesce(reason, F.when(self._late(closed), F.lit("late")))
        out = rows.withColumn("reason", reason).where(F.col("reason").isNotNull())
        batch.write(clustered(utc_text(out), ("reason",)), REJECTS, "json", ("reason",), **NULLS_KEPT)

    def _closing(self, known: DataFrame, closed: int | None, reached: int) -> DataFrame:
        end = micros("window_end")
        due = known.where(F.col("span_id") <= reached // self.span_us).where(end <= reached)
        if closed is not None:
            due = due.where(F.col("span_id") >= closed // self.span_us - 1).where(end > closed)
        return due

    def _changed(self, known: DataFrame, fresh: DataFrame, closed: int | None) -> DataFrame | None:
        """All partials of the closed windows that have rows in this batch."""
        if closed is None:
            return None
        changed = fresh.where(micros("window_end") <= closed).select("span_id", *WINDOW_KEYS).distinct()
        first, last = changed.agg(F.min("span_id"), F.max("span_id")).first()
        if first is None:
            return None
        held = known.where(F.col("span_id").between(first, last))
        same = [held["span_id"] == changed["span_id"], *[held[c].eqNullSafe(changed[c]) for c in WINDOW_KEYS]]
        return held.join(changed, same, "left_semi")

    def _stage_windows(self, batch: Batch, counts: DataFrame, closed: int | None = None, batch_id: int = 0) -> None:
        """Records of the windows of some partials: those that close now, and with a version those that ``closed`` had before."""
        windows = windows_of(counts.drop("newest", "span_id")).persist()
        # The contexts of these windows' deployments, read once for the three tables.
        lineage = self.lineage.join(windows.select("deployment_id").distinct(), "deployment_id", "left_semi").persist()
        try:
            before = F.lit(False) if closed is None else micros("window_end") <= closed
            out = window_records(windows.where(~before), lineage)
            self._stage_records(batch, utc_text(metrics_partitions(out)), METRICS_DIR)
            held = withheld_windows(windows.where(~before), lineage)
            self._stage_records(batch, utc_text(metrics_partitions(held)), WITHHELD)
            if closed is not None:
                again = window_records(windows.where(before), lineage)
                again = utc_text(metrics_partitions(again)).withColumn("version", F.lit(batch_id + 1).cast("bigint"))
                self._stage_records(batch, again, CORRECTIONS)
        finally:
            lineage.unpersist()
            windows.unpersist()

    def _stage_records(self, batch: Batch, records: DataFrame, folder: str) -> None:
        unused = [c for c in METRICS_BY if c not in self.layout]
        batch.write(clustered(records.drop(*unused), self.layout), folder, "json", self.layout, **NULLS_KEPT)


def current_windows(spark: SparkSession, base_dir: str) -> DataFrame:
    """The latest version of every window: written records (version 0) overlaid by their corrections."""
    base = base_dir.rstrip("/")
    out = spark.read.json(f"{base}/{METRICS_DIR}").withColumn("version", F.lit(0).cast("bigint"))
    if Files(spark).files_below(f"{base}/{CORRECTIONS}"):
        out = out.unionByName(spark.read.schema(out.schema).json(f"{base}/{CORRECTIONS}"))
    names = [c for c in out.columns if c not in ("window_start", "endpoint_name", "deployment_id")]
    return (out.groupBy("window_start", "endpoint_name", "deployment_id")
            .agg(F.max_by(F.struct(*names), "version").alias("r")).select("window_start", "endpoint_name", "deployment_id", "r.*"))
