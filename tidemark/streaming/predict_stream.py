"""Predictions for a stream of requests: each micro-batch runs the batch
function ``predict_requests`` against the metrics table and appends the
results (Parquet, partitioned by the batch id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.contract import Contract
from tidemark.operators.scoring import broadcast_model
from tidemark.operators.outcomes import normalize_requests
from tidemark.operators.serving import predict_requests
from tidemark.session import checkpoint_dir
from tidemark.sources.readings import ReadingStore


def start_prediction_stream(requests: DataFrame, metrics: DataFrame | ReadingStore, model, contract: Contract,
                            model_version: str, out_dir: str, *, checkpoint: str | None = None,
                            available_now: bool = False,
                            processing_time: str | None = None):
    """Score each micro-batch of requests.

    With a ``ReadingStore`` a batch reads the stored days around its requests
    and the store's one row per station and day; with a metrics table it
    reads the whole history: a station silent for long is stale, which a cut
    history would make unknown. The results are the same.
    A replayed batch id overwrites its own folder, on whatever day it runs."""
    spark = requests.sparkSession
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/prediction-stream"

    shared = None if model is None else broadcast_model(spark, model)  # once for all batches

    def _batch(batch: DataFrame, batch_id: int) -> None:
        if isinstance(metrics, ReadingStore):
            batch = batch.persist()  # read for its days and for its rows
            near, carried = metrics.near(normalize_requests(batch))
        else:
            near, carried = metrics, None
        out = (predict_requests(batch, near, shared, contract, model_version, carried=carried)
               .withColumn("completed_at", F.current_timestamp().cast("timestamp_ntz"))
               .withColumn("batch_id", F.lit(batch_id)))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(out_dir))
        batch.unpersist()

    w = requests.writeStream.option("checkpointLocation", ckpt).foreachBatch(_batch)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()
