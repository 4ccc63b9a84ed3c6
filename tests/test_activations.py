"""Deployment events from a stream of new bundles."""

import glob
import json
import os

from tidemark.operators import lineage as lin
from tidemark.operators import metrics as met
from tidemark.streaming import start_activation_stream

META = {"model_version": "1.0", "trained_at": "2025-01-01T00:00:00Z", "input_dataset_name": " docks ", "input_dataset_version": "7",
        "started_at": "2025-01-01T01:00:00Z", "completed_at": "2025-01-01T02:00:00+00:00"}


def put(base, bundle, **changes):
    folder = os.path.join(base, "models", *bundle.split("/"))
    os.makedirs(folder)
    draft = os.path.join(base, "draft.json")
    with open(draft, "w") as f:
        json.dump({**META, **changes}, f, indent=1)
    os.rename(draft, os.path.join(folder, "model_metadata.json"))


def stored(base, name):
    out = []
    for f in glob.glob(os.path.join(base, "out", "artifacts", "serving", name, "**", "*.json"), recursive=True):
        with open(f) as fh:
            out += [json.loads(x) for x in fh if x.strip()]
    return out


def names(base):
    return sorted(os.path.basename(r["bundle_id"]) for r in stored(base, "events"))


def start(spark, base, **options):
    return start_activation_stream(spark, os.path.join(base, "models"), os.path.join(base, "out"), deployment_id="dep-1",
                                   checkpoint=os.path.join(base, "ckpt"), **options)


def test_each_new_bundle_is_one_event(spark, tmp_dir):
    put(tmp_dir, "harbour/v1")
    put(tmp_dir, "harbour/v2", started_at="2025-01-01T03:00:00Z")  # ends before it starts
    put(tmp_dir, "harbour/v3", trained_at="2025-01-01T00:00:00")  # no zone
    q = start(spark, tmp_dir)
    try:
        q.processAllAvailable()
        assert names(tmp_dir) == ["v1"]
        put(tmp_dir, "harbour/v4", model_version="2.0")  # while the stream runs
        q.processAllAvailable()
        assert names(tmp_dir) == ["v1", "v4"]
    finally:
        q.stop()
    start(spark, tmp_dir, available_now=True).awaitTermination(300)  # a restart adds none
    assert names(tmp_dir) == ["v1", "v4"]
    put(tmp_dir, "harbour/v5")
    start(spark, tmp_dir, available_now=True).awaitTermination(300)
    events = stored(tmp_dir, "events")
    assert names(tmp_dir) == ["v1", "v4", "v5"]
    assert {r["deployment_id"] for r in events} == {"dep-1"} and {r["input_dataset_name"] for r in events} == {"docks"}
    assert all(r["event_time"].endswith("Z") and r["event_type"] == "serving_deployment_activated" for r in events)
    bad = {os.path.basename(r["bundle_id"]): r["reasons"] for r in stored(tmp_dir, "bundle_rejects")}
    assert bad == {"v2": ["chronology"], "v3": ["bundle_created_at_invalid"]}


def test_activated_contexts_follow_the_events(spark):
    """Events of two bundles on one deployment give windows their own context."""
    meta = spark.createDataFrame([(f"/m/harbour/v{k}/model.pkl", "d", f"{k}", "2025-01-01T00:00:00Z", "n", "7", "2025-01-01T01:00:00Z",
                                   "2025-01-01T02:00:00Z") for k in (1, 2)],
                                 "model_path string, deployment_id string, model_version string, trained_at string, input_dataset_name string, "
                                 "input_dataset_version string, started_at string, completed_at string")
    ctx = lin.bundle_lineage(meta)
    acts = spark.sql("""SELECT 'd' AS deployment_id, bundle_id, event_time, 'startup' AS activation_reason, 'serving' AS traffic_status
                        FROM VALUES ('/m/harbour/v1', TIMESTAMP_NTZ '2025-02-01 00:00:00'), ('/m/harbour/v2', TIMESTAMP_NTZ '2025-02-01 00:05:00')
                        AS t(bundle_id, event_time)""")
    events = lin.deployment_events(acts, ctx, on=["deployment_id", "bundle_id"])
    assert events.count() == 2
    log = spark.sql("""SELECT TIMESTAMP_NTZ '2025-02-01 00:00:10' + make_interval(0, 0, 0, 0, 0, CAST(id AS INT), 0) AS completed_at, '/predict' AS endpoint_name,
                       'd' AS deployment_id, 'success' AS outcome, CAST(NULL AS STRING) AS error_type, 1.0D AS latency_ms, 0.5D AS prediction
                       FROM range(9)""")
    got = met.window_records(met.metrics_windows(log), lin.activated_contexts(events)).orderBy("window_start").collect()
    assert [r["model_version"] for r in got] == ["1"] * 5 + ["2"] * 4
