"""End-to-end request scoring, batch and per micro-batch."""

import os

from pyspark.sql import functions as F

from conftest import MEDIUM
from tidemark.operators import scoring as sco
from tidemark.operators.serving import predict_requests
from tidemark.plans.common import Inputs
from tidemark.plans.queries import DEFAULT_CONTRACT, outcome_map
from tidemark.streaming import start_prediction_stream


def test_predict_requests_agrees_with_outcome_map(spark):
    i = Inputs(spark, MEDIUM)
    got = predict_requests(i.requests, i.metrics, sco.ConstantModel(42.0), DEFAULT_CONTRACT, "v1")
    rows = got.select("request_id", "code", "outcome", "error_type", "http_status", "prediction").collect()
    want = {r["request_id"]: r for r in outcome_map(spark, MEDIUM).collect()}
    assert len(rows) == len(want)
    for r in rows:
        w = want[r["request_id"]]
        assert (r["code"], r["outcome"], r["error_type"], r["http_status"]) == \
               (w["code"], w["outcome"], w["error_type"], w["http_status"])
        assert (r["prediction"] == 42.0) == (r["code"] == "ok")


def test_prediction_stream(spark, tmp_dir):
    i = Inputs(spark, MEDIUM)
    src = os.path.join(tmp_dir, "requests")
    i.requests.write.parquet(src)
    stream = spark.readStream.schema(i.requests.schema).parquet(src)
    out = os.path.join(tmp_dir, "predictions")
    q = start_prediction_stream(stream, i.metrics, sco.ConstantModel(7.0), DEFAULT_CONTRACT, "v1", out,
                                checkpoint=os.path.join(tmp_dir, "ckpt"), available_now=True)
    q.awaitTermination(600)
    res = spark.read.parquet(out)
    assert res.count() == i.requests.count()
    assert res.where(F.col("code") == "ok").where(F.col("prediction") != 7.0).count() == 0


def test_a_model_never_sees_a_rejected_row(spark):
    i = Inputs(spark, MEDIUM)
    req = spark.createDataFrame([(1, "nowhere", "2024-01-20T12:00:00"), (2, "station_2", "1999-01-01T00:00:00")],
                                "request_id long, entity_id string, timestamp string")
    model = "no model at all"  # any row that reached it would fail the job
    got = predict_requests(req, i.metrics, model, DEFAULT_CONTRACT, "v1").collect()
    assert len(got) == 2 and all(r["prediction"] is None and r["code"] != "ok" for r in got)


def test_no_model_fails_every_valid_request_first(spark):
    req = spark.createDataFrame([(1, "station_1", "2025-06-01T12:00:00"), (2, "  ", "2025-06-01T12:00:00"),
                                 (3, "station_1", "not-a-time")],
                                "request_id long, entity_id string, timestamp string")
    i = Inputs(spark, MEDIUM)
    got = {r["request_id"]: r for r in predict_requests(req, i.metrics, None, DEFAULT_CONTRACT, "v1").collect()}
    assert (got[1]["code"], got[1]["outcome"], got[1]["error_type"], got[1]["http_status"]) == \
        ("model_not_ready", "failure", "model_load", 503)
    assert got[2]["code"] == "invalid_request"
    assert got[3]["code"] == "model_not_ready"  # the model check comes before time parsing
