"""Serving-metrics windows over a request stream (Structured Streaming).

``start_metrics_stream`` gives each micro-batch to a ``MetricsLedger``: exact
windows, each written once, late rows recorded and counted in corrections,
and a hot minute kept as many small rows. Event time is the request's
completion time.

``stream_window_aggregates`` is the same aggregation with Spark's own state
and watermark, for sinks of one's choice: there rows later than the
watermark are dropped, and the exact ``percentile_disc`` holds the value
counts of an open window in one state row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import (
    WINDOW_KEYS, WINDOW_SECONDS, count_columns, error_columns, handled, prediction_columns,
)
from tidemark.schemas import PERCENTILES
from tidemark.session import checkpoint_dir
from tidemark.streaming.ledger import MetricsLedger


def _pct(p: float, col: str = "latency_ms"):
    return F.expr(f"percentile_disc({p / 100.0}) WITHIN GROUP (ORDER BY {col})")


def stream_window_aggregates(log: DataFrame, watermark: str = "1 minute",
                             time_col: str = "completed_at") -> DataFrame:
    """Window counters and percentiles of a (streaming or batch) request log."""
    et = F.col(time_col).cast("timestamp")  # watermarks need TIMESTAMP; session zone is UTC
    s = handled(log).withColumn("_event_time", et).withWatermark("_event_time", watermark)
    w = F.window("_event_time", f"{WINDOW_SECONDS} seconds")
    agg = s.groupBy(w.alias("_w"), "endpoint_name", "deployment_id").agg(
        *count_columns(), *error_columns(), *prediction_columns(),
        *[F.coalesce(_pct(p), F.lit(0.0)).alias(name) for name, p in PERCENTILES.items()])
    return agg.select(F.col("_w.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("_w.end").cast("timestamp_ntz").alias("window_end"),
                      *[c for c in agg.columns if c not in ("_w",) and c not in WINDOW_KEYS],
                      "endpoint_name", "deployment_id")


class MetricsStream:
    """A running metrics stream: the streaming query, and the ledger that it writes.

    With ``flush_open`` the windows still open when the stream ends (by
    itself or by ``stop``) are written then, once.
    """

    def __init__(self, query, ledger: MetricsLedger, flush_open: bool):
        self.query, self.ledger, self.flush_open = query, ledger, flush_open

    def awaitTermination(self, timeout: int | None = None) -> bool | None:
        done = self.query.awaitTermination(timeout) if timeout is not None else self.query.awaitTermination()
        if self.flush_open and not self.query.isActive:
            self.ledger.flush()
        return done

    def stop(self) -> None:
        self.query.stop()
        if self.flush_open:
            self.ledger.flush()

    def __getattr__(self, name: str):
        return getattr(self.query, name)


def start_metrics_stream(log_stream: DataFrame, lineage: DataFrame, base_dir: str, *,
                         output_mode: str = "append", watermark: str = "1 minute",
                         checkpoint: str | None = None, available_now: bool = False,
                         processing_time: str | None = None, query_name: str | None = None) -> MetricsStream:
    """Start the streaming job that writes window records under ``base_dir``.

    ``append``: a window is written once the watermark passes its end.
    ``update``: so it is, and the windows open at the end of the run are
    written when it ends. Either way a window stands in the output once,
    over any stops and restarts; rows that come for a written window are
    recorded as late and give a corrected version (``MetricsLedger``).

    The checkpoint defaults to a folder under the session's shared
    ``spark.checkpoint.dir``.
    """
    if output_mode not in ("append", "update"):
        raise ValueError(f"unsupported output mode {output_mode!r}")
    spark = log_stream.sparkSession
    ckpt = (checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/metrics-stream").rstrip("/")
    delay = spark.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {watermark})").first()[0]
    ledger = MetricsLedger(spark, lineage, base_dir, f"{ckpt}/_commits", delay_seconds=delay / 1_000_000)
    writer = log_stream.writeStream.option("checkpointLocation", ckpt).foreachBatch(ledger.ingest)
    if query_name:
        writer = writer.queryName(query_name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return MetricsStream(writer.start(), ledger, output_mode == "update")
