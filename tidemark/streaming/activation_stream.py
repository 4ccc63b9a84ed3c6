"""Deployment events from bundles as they appear.

The folder of ``model_metadata.json`` files is a stream source: each new file
is one activation, at the time the file was put there. A bundle written again
within the watermark (same deployment, version and times) is the same
activation. Micro-batches are published by their number (``CommitLog``), and
the source remembers its files in the checkpoint: a restart adds no event.
Bundles that break a lineage rule go to a reject folder with their reasons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lineage import ServiceSettings, bundle_lineage, deployment_events
from tidemark.session import checkpoint_dir
from tidemark.sources.artifacts import METADATA_FIELDS, stream_bundle_metadata
from tidemark.sources.commits import CommitLog
from tidemark.sources.sinks import EVENTS_BY, EVENTS_DIR, NULLS_KEPT, clustered, event_partitions, utc_text

BUNDLE_REJECTS = "artifacts/serving/bundle_rejects"
SAME = ["deployment_id", "model_path", *METADATA_FIELDS]


def start_activation_stream(spark: SparkSession, models_dir: str, base_dir: str, *, settings: ServiceSettings = ServiceSettings(),
                            reason: str = "startup", traffic_status: str = "serving", deployment_id: str | None = None,
                            watermark: str = "1 day", checkpoint: str | None = None, available_now: bool = False,
                            processing_time: str | None = None):
    """Start the stream that writes one deployment event for each new bundle under ``models_dir``."""
    ckpt = (checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/activation-stream").rstrip("/")
    meta = stream_bundle_metadata(spark, models_dir, deployment_id=deployment_id)
    fresh = meta.withWatermark("put_at", watermark).dropDuplicatesWithinWatermark(SAME)
    log = CommitLog(spark, base_dir, f"{ckpt}/_commits")

    def write(batch: DataFrame, batch_id: int) -> None:
        work = log.begin(batch_id)
        if work is None:
            return
        batch = batch.persist()
        try:
            ctx = bundle_lineage(batch, settings, extra=["put_at"])
            events = deployment_events(ctx.select(
                "deployment_id", "bundle_id", F.col("put_at").cast("timestamp_ntz").alias("event_time"),
                F.lit(reason).alias("activation_reason"), F.lit(traffic_status).alias("traffic_status")), ctx, on=["deployment_id", "bundle_id"])
            work.write(clustered(utc_text(event_partitions(events)), EVENTS_BY), EVENTS_DIR, "json", EVENTS_BY, **NULLS_KEPT)
            bad = ctx.where(~F.col("valid")).drop("valid").withColumnRenamed("put_at", "event_time")
            work.write(clustered(utc_text(event_partitions(bad)), EVENTS_BY), BUNDLE_REJECTS, "json", EVENTS_BY, **NULLS_KEPT)
            work.commit()
        finally:
            batch.unpersist()

    writer = fresh.writeStream.option("checkpointLocation", ckpt).foreachBatch(write)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
