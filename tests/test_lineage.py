"""Lineage contexts from bundle metadata, deployment events, record validation."""

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import lineage as lin
from tidemark.operators import validate as val
from tidemark.schemas import EVENT_FIELDS

META = ("model_path string, deployment_id string, model_version string, trained_at string, "
        "input_dataset_name string, input_dataset_version string, started_at string, completed_at string")
GOOD = ("/srv/models/harbour/v1/model.pkl", "dep-1", "v1.2.3", "2025-01-01T00:00:00Z", " bikes ",
        "2025-05", "2025-01-01T01:00:00+00:00", "2025-01-01T04:00:00+02:00")


def contexts(spark, rows):
    return {r["deployment_id"]: r for r in lin.bundle_lineage(spark.createDataFrame(rows, META)).collect()}


def test_valid_context_and_path_derivation(spark):
    r = contexts(spark, [GOOD])["dep-1"]
    assert r["valid"] and r["reasons"] == []
    assert r["model_name"] == "harbour"
    assert r["bundle_id"] == "/srv/models/harbour/v1"
    assert r["bundle_uri"] == "file:///srv/models/harbour/v1"
    assert r["input_dataset_name"] == "bikes"
    assert r["bundle_created_at"] == datetime(2025, 1, 1, 0, 0)
    assert r["completed_at"] == datetime(2025, 1, 1, 2, 0)  # +02:00 normalised to UTC
    assert r["started_at"] == datetime(2025, 1, 1, 1, 0)


def test_rejections(spark):
    rows = [GOOD[:1] + ("blank-name",) + GOOD[2:4] + ("   ",) + GOOD[5:],
            GOOD[:1] + ("naive",) + GOOD[2:3] + ("2025-01-01T00:00:00",) + GOOD[4:],
            GOOD[:1] + ("missing-version",) + (None,) + GOOD[3:],
            GOOD[:1] + ("bad-order",) + GOOD[2:6] + ("2025-01-01T03:00:00Z", "2025-01-01T02:00:00Z"),
            GOOD[:1] + ("garbage",) + GOOD[2:6] + ("yesterday", GOOD[7]),
            GOOD[:1] + ("padded",) + GOOD[2:6] + (" 2025-01-01T01:00:00Z", GOOD[7])]
    got = contexts(spark, rows)
    assert got["blank-name"]["reasons"] == ["input_dataset_name_blank"]
    assert got["naive"]["reasons"] == ["bundle_created_at_invalid"]
    assert got["missing-version"]["reasons"] == ["model_version_missing"]
    assert got["bad-order"]["reasons"] == ["chronology"]
    assert got["garbage"]["reasons"] == ["started_at_invalid"]
    assert got["padded"]["reasons"] == ["started_at_invalid"]
    assert not any(r["valid"] for r in got.values())


def test_deployment_events_only_for_valid_lineage(spark):
    ctx = lin.bundle_lineage(spark.createDataFrame([GOOD, GOOD[:1] + ("bad",) + GOOD[2:4] + ("",) + GOOD[5:]], META))
    acts = spark.createDataFrame([("dep-1", datetime(2025, 1, 2), "startup", "serving"),
                                  ("bad", datetime(2025, 1, 2), "startup", "serving"),
                                  ("unknown", datetime(2025, 1, 2), "startup", "serving")],
                                 "deployment_id string, event_time timestamp_ntz, activation_reason string, traffic_status string")
    ev = lin.deployment_events(acts, ctx)
    assert ev.columns == EVENT_FIELDS
    rows = ev.collect()
    assert [r["deployment_id"] for r in rows] == ["dep-1"]
    assert rows[0]["event_type"] == "serving_deployment_activated" and rows[0]["schema_version"] == "v1"
    checked = val.validate_events(ev).collect()[0]
    assert checked["valid"]


def test_event_validation_reasons(spark):
    ctx = lin.bundle_lineage(spark.createDataFrame([GOOD], META))
    acts = spark.createDataFrame([("dep-1", None, " ", "serving")],
                                 "deployment_id string, event_time timestamp_ntz, activation_reason string, traffic_status string")
    ev = lin.event_records(acts, ctx).withColumn("schema_version", F.lit("v2"))
    r = val.validate_events(ev).collect()[0]
    assert r["reasons"] == ["activation_reason_blank", "event_time_invalid", "schema_version"]


def test_window_validation(spark):
    from tidemark.schemas import WINDOW_FIELDS
    base = {c: 0 for c in WINDOW_FIELDS}
    base.update({c: "x" for c in ["service_name", "service_version", "environment", "deployment_id", "model_name",
                                  "model_version", "bundle_id", "input_dataset_name", "input_dataset_version",
                                  "endpoint_name"]})
    base.update(schema_version="v1", window_start=datetime(2025, 1, 1, 12, 0), window_end=datetime(2025, 1, 1, 12, 1),
                heartbeat_emitted_at=datetime(2025, 1, 1, 12, 2), latency_p50_ms=3.25, latency_p95_ms=8.0,
                latency_p99_ms=9.75, feature_lookup_p95_ms=None, model_exec_p95_ms=None,
                missing_feature_count=None, default_imputed_feature_count=None, stale_feature_count=None,
                feature_vector_build_failure_count=None)
    bad = dict(base, window_end=base["window_start"], request_count=-1, endpoint_name="  ", stale_feature_count=-2)
    schema = ", ".join(
        f"{c} {'timestamp_ntz' if c in ('window_start', 'window_end', 'heartbeat_emitted_at') else 'string' if isinstance(base[c], str) else 'double' if c.endswith('_ms') else 'bigint'}"
        for c in WINDOW_FIELDS)
    df = spark.createDataFrame([tuple(base[c] for c in WINDOW_FIELDS), tuple(bad[c] for c in WINDOW_FIELDS)], schema)
    good_r, bad_r = val.validate_windows(df).collect()
    assert good_r["valid"] and good_r["reasons"] == []
    assert not bad_r["valid"]
    assert set(bad_r["reasons"]) == {"endpoint_name_blank", "window_order", "request_count_negative",
                                     "stale_feature_count_negative"}


def test_read_bundle_metadata_files(spark, tmp_dir):
    import json
    import os

    from tidemark.sources.artifacts import read_bundle_metadata
    full = {"model_version": "v3", "trained_at": "2025-01-01T00:00:00Z", "target": "t",
            "input_dataset_name": "bikes", "input_dataset_version": "2025-05",
            "started_at": "2025-01-01T01:00:00Z", "completed_at": "2025-01-01T02:00:00Z"}
    minimal = {"model_version": "test-v1", "trained_at": "2025-01-01T00:00:00Z", "target": "t"}
    for name, meta in [("harbour/v3", full), ("other/v1", minimal)]:
        d = os.path.join(tmp_dir, "models", name)
        os.makedirs(d)
        with open(os.path.join(d, "model_metadata.json"), "w") as fh:
            json.dump(meta, fh, indent=2)  # multi-line JSON, as written by the trainer
    meta = read_bundle_metadata(spark, os.path.join(tmp_dir, "models"))
    got = {r["model_name"]: r for r in lin.bundle_lineage(meta).collect()}
    assert got["harbour"]["valid"] and got["harbour"]["model_version"] == "v3"
    bundle = os.path.join(os.path.realpath(tmp_dir), "models", "harbour", "v3")
    assert got["harbour"]["bundle_id"] == bundle
    assert got["harbour"]["bundle_uri"] == "file://" + bundle
    # the minimal metadata has no dataset lineage: no context, as in the reference
    assert not got["other"]["valid"]
    assert set(got["other"]["reasons"]) == {"input_dataset_name_blank", "input_dataset_version_blank",
                                             "started_at_invalid", "completed_at_invalid"}


def test_bundle_uri_is_percent_encoded_like_as_uri(spark):
    from pathlib import PurePosixPath
    path = "/srv/my models/h*rb~r/v 1+2/model.pkl"
    row = GOOD[1:]
    r = lin.bundle_lineage(spark.createDataFrame([(path,) + row], META)).collect()[0]
    assert r["bundle_uri"] == PurePosixPath(path).parent.as_uri()
    assert r["model_name"] == "h*rb~r" and r["bundle_id"] == "/srv/my models/h*rb~r/v 1+2"
