"""JSON sinks (append-only, partitioned, nulls kept, UTC 'Z') and the stream."""

import glob
import json
import os
from datetime import datetime

from pyspark.sql import functions as F

from conftest import SMALL
from tidemark.operators import lineage as lin
from tidemark.operators import metrics as met
from tidemark.sources import standins
from tidemark.sources.sinks import write_deployment_events, write_metrics_windows
from tidemark.sources.tables import load_table
from tidemark.streaming import start_metrics_stream


def _records(spark):
    log = standins.request_log(load_table(spark, SMALL, "events")).where(F.col("completed_at") < "2024-01-01 06:00:00")
    ctx = lin.bundle_lineage(standins.bundle_metadata(load_table(spark, SMALL, "orders"))).where("valid")
    return met.window_records(met.metrics_windows(log), ctx, heartbeat=F.lit(datetime(2024, 2, 1)).cast("timestamp_ntz")), ctx


def _lines(path):
    out = []
    for f in glob.glob(os.path.join(path, "**", "*.json"), recursive=True):
        with open(f) as fh:
            out += [json.loads(x) for x in fh if x.strip()]
    return out


def test_metrics_sink_layout_append_and_format(spark, tmp_dir):
    rec, _ = _records(spark)
    n = rec.count()
    write_metrics_windows(rec, tmp_dir)
    base = os.path.join(tmp_dir, "artifacts", "serving", "metrics")
    dirs = glob.glob(os.path.join(base, "date=*", "hour=*", "minute=*"))
    assert dirs and all(os.path.basename(d).startswith("minute=") for d in dirs)
    first = _lines(base)
    assert len(first) == n
    one = first[0]
    assert one["feature_lookup_p95_ms"] is None and "missing_feature_count" in one  # nulls kept
    assert one["window_start"].endswith("Z") and one["heartbeat_emitted_at"] == "2024-02-01T00:00:00Z"
    assert all(len(glob.glob(os.path.join(d, "*.json"))) == 1 for d in dirs)  # one file per folder and write
    write_metrics_windows(rec, tmp_dir)  # second write appends
    assert len(_lines(base)) == 2 * n
    write_metrics_windows(rec.limit(0), tmp_dir)  # empty batch writes nothing
    assert len(_lines(base)) == 2 * n


def test_event_sink(spark, tmp_dir):
    _, ctx = _records(spark)
    acts = standins.activations(load_table(spark, SMALL, "orders")).where(F.col("deployment_id").cast("long") < 20)
    ev = lin.deployment_events(acts, ctx)
    write_deployment_events(ev, tmp_dir)
    lines = _lines(os.path.join(tmp_dir, "artifacts", "serving", "events"))
    assert len(lines) == ev.count() and lines[0]["schema_version"] == "v1"
    assert glob.glob(os.path.join(tmp_dir, "artifacts", "serving", "events", "date=*"))


def test_stream_append_and_update_equal_batch(spark, tmp_dir):
    ev = load_table(spark, SMALL, "events").where(F.col("ts") < "2024-01-02 00:00:00")
    src = os.path.join(tmp_dir, "src")
    ev.write.parquet(src)
    ctx = lin.bundle_lineage(standins.bundle_metadata(load_table(spark, SMALL, "orders"))).where("valid")
    batch = met.window_records(met.metrics_windows(standins.request_log(ev)), ctx).drop("heartbeat_emitted_at")
    n = batch.count()
    counts = {}
    for mode in ("append", "update"):
        stream = spark.readStream.schema(ev.schema).parquet(src)
        q = start_metrics_stream(standins.request_log(stream), ctx, os.path.join(tmp_dir, mode),
                                 output_mode=mode, available_now=True,
                                 checkpoint=os.path.join(tmp_dir, "ckpt-" + mode))
        q.awaitTermination(600)
        got = spark.read.json(os.path.join(tmp_dir, mode, "artifacts", "serving", "metrics"))
        counts[mode] = got.count()
        if mode == "update":
            pairs = {(r["window_start"], r["deployment_id"], r["request_count"], r["latency_p95_ms"])
                     for r in got.collect()}
            want = {(r["window_start"].isoformat() + "Z", r["deployment_id"], r["request_count"], r["latency_p95_ms"])
                    for r in batch.collect()}
            assert pairs == want
    assert counts["update"] == n
    assert counts["append"] == n - 1  # the newest window waits for later rows


def test_stream_drops_rows_later_than_the_watermark(spark, tmp_dir):
    """A row older than the watermark is dropped, not counted in another window."""
    from tidemark.streaming import stream_window_aggregates
    schema = ("completed_at timestamp_ntz, endpoint_name string, deployment_id string, outcome string, "
              "error_type string, latency_ms double, prediction double")
    src = os.path.join(tmp_dir, "log")
    os.makedirs(src)
    t0 = datetime(2024, 1, 1, 0, 0, 30)
    batches = [[(t0, "/predict", "0", "success", None, 5.0, 0.1)],
               [(datetime(2024, 1, 1, 0, 10, 0), "/predict", "0", "success", None, 7.0, 0.1)],
               [(datetime(2024, 1, 1, 0, 0, 40), "/predict", "0", "success", None, 9.0, 0.1),   # late
                (datetime(2024, 1, 1, 0, 10, 20), "/predict", "0", "failure", None, 1.0, None)]]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    agg = stream_window_aggregates(stream, watermark="1 minute")
    q = (agg.writeStream.outputMode("update").format("memory").queryName("late_rows")
         .option("checkpointLocation", os.path.join(tmp_dir, "ckpt")).start())
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT window_start, max(request_count) AS n FROM late_rows GROUP BY window_start").collect()
    counts = {r["window_start"]: r["n"] for r in got}
    assert counts[datetime(2024, 1, 1, 0, 0)] == 1      # the late 00:00:40 row was not added
    assert counts[datetime(2024, 1, 1, 0, 10)] == 2


def test_partitions_follow_the_utc_day(spark):
    """A zoned time is normalised to UTC before its partition is derived."""
    from tidemark.functions.scalars import parse_zoned_utc
    from tidemark.sources.sinks import event_partitions, metrics_partitions
    df = spark.createDataFrame([("2026-04-07T23:30:00-05:00",), ("2026-04-07T14:35:22Z",),
                                ("2026-04-08T01:05:00+02:00",)], "t string")
    utc = df.select(parse_zoned_utc("t").alias("event_time"))
    got = [r["date"] for r in event_partitions(utc).collect()]
    assert got == ["2026-04-08", "2026-04-07", "2026-04-07"]
    m = metrics_partitions(utc.withColumnRenamed("event_time", "window_start")).collect()
    assert [(r["date"], r["hour"], r["minute"]) for r in m] == [
        ("2026-04-08", "04", "30"), ("2026-04-07", "14", "35"), ("2026-04-07", "23", "05")]
