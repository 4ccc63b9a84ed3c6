"""Request normalisation, outcome mapping and bulk scoring."""

import re
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from helpers import OBS_TS, metrics_df, metrics_rows
from tidemark.functions.scalars import iso_time, with_iso
from tidemark.operators import outcomes as outc
from tidemark.operators import scoring as sco
from tidemark.operators.contract import Contract
from tidemark.operators.features import reconstruct
from tidemark.operators.serving import predict_requests
from tidemark.schemas import FEATURE_ORDER


def test_normalize_requests(spark):
    req = spark.createDataFrame([(1, "  station_1 ", "2025-06-01T12:00:00"),
                                 (2, "   ", "2025-06-01T12:00:00"),
                                 (3, "station_1", "2025-06-01T12:00:00Z"),
                                 (4, "station_1", "soon"),
                                 (5, "station_1", ""),
                                 (6, "\tstation_2\n", None),
                                 (7, "station_1", " 2025-06-01T12:00:00")],
                                "request_id long, entity_id string, timestamp string")
    now = F.lit(datetime(2030, 1, 1)).cast("timestamp_ntz")
    got = {r["request_id"]: r for r in outc.normalize_requests(req, now=now).collect()}
    assert got[1]["station_id"] == "station_1" and got[1]["status"] == "ok" and got[1]["obs_ts"] == OBS_TS
    assert got[2]["status"] == "invalid_request"
    assert got[3]["status"] == "ok" and got[3]["zoned"] and got[3]["obs_ts"] == OBS_TS
    assert got[4]["status"] == "internal"
    assert got[5]["status"] == "ok" and got[5]["obs_ts"] == datetime(2030, 1, 1)
    assert got[6]["station_id"] == "station_2" and got[6]["obs_ts"] == datetime(2030, 1, 1)
    assert got[7]["status"] == "internal"  # fromisoformat takes no surrounding whitespace


SHAPES = ["2024", "2024-01", "2024-1-1", "2024-01-01", "20240101", "2024-W01", "2024-W01-1", "2024W011", "2024-W01-8",
          "2020-W53-4", "2021-W53-1", "2024-W00-1", "2024-02-30", "0000-01-01", "2024-01-01T12", "2024-01-01T12:30",
          "2024-01-01 1:2:3", "2024-01-01T12:00:00 UTC", "2024-01-01T12:00:00 Europe/Rome", "20240101T120000",
          "20240101T1200", "2024-01-01T12:00:00,5", "2024-01-01T12:00:00.123456789", "2024-01-01T12:00:00.", "",
          "2024-01-01T25:00", "2024-01-01T12:00:00Z", "2024-01-01T12:00:00+02", "2024-01-01T12:00:00-0530",
          "2024-01-01T12:00:00+05:30:15", "2024-01-01T12Z", "20240101T120000Z", "2024-01-01x12:00", "2024-01-01T",
          "2024-01-01T12:00:00+24:00", " 2024-01-01", "2024-01-01T12:0000", "2024-366", "soon", "2024-W01-1T10+01:00"]


def test_iso_text_is_taken_as_fromisoformat_takes_it(spark):
    df = spark.createDataFrame([(s,) for s in SHAPES], "s string")
    for r in df.select("s", iso_time("s").alias("t")).select("s", "t.*").collect():
        try:
            want = datetime.fromisoformat(r["s"])
        except ValueError:
            want = None
        zone = want.utcoffset() if want is not None else None
        assert r["wall"] == (want and want.replace(tzinfo=None)), r["s"]
        assert r["offset"] == (None if zone is None else zone.total_seconds()), r["s"]
        assert r["utc"] == (None if zone is None else want.replace(tzinfo=None) - zone), r["s"]


def test_the_lookup_comes_before_the_zone(spark):
    m = metrics_df(spark, metrics_rows(minutes=90) + metrics_rows(stations=(("tiny", 1.0),), capacity=3.0, minutes=90))
    contract = Contract("v", "station_id", (("ft_bikes_available", "float64"),), "t")
    req = spark.createDataFrame([(n, e, t, 1.23456) for n, (e, t) in enumerate(
        (e, f"2025-06-0{d}T12:00:00{z}") for e in ("nowhere", "tiny", "station_1") for d in (1, 2) for z in ("", "Z"))],
        "n int, entity_id string, timestamp string, took double")
    got = predict_requests(req, m, sco.ConstantModel(1.0), contract, "v", latency_col="took").orderBy("n").collect()
    assert [r["code"] for r in got] == (["not_found"] * 4 + ["domain_violation"] * 4
                                        + ["ok", "internal", "stale", "internal"])
    assert [r["latency_ms"] for r in got if r["latency_ms"] is not None] == [1.235]


def test_rows_on_which_the_model_fails(spark):
    """Text reaches the model as text: the linear one takes digits and fails on the rest, row by row."""
    df = spark.createDataFrame([(1.0, "3"), (-1.0, "x"), (2.0, "4")], "a double, b string")
    model = sco.LinearModel(["a", "b"], {"a": 2.0, "b": 1.0})
    got = df.select(sco.prediction_struct(df, model, ["a", "b"]).alias("p")).select("p.*").collect()
    assert [(r["v"], r["failed"]) for r in got] == [(5.0, False), (0.0, True), (8.0, False)]


def test_outcome_mapping(spark):
    codes = spark.createDataFrame([(c,) for c in ["ok", "not_found", "domain_violation", "stale",
                                                  "dtype_error", "invalid_request", "internal"]], "code string")
    o, e, h = outc.serving_outcome(F.col("code"))
    got = {r["code"]: (r["o"], r["e"], r["h"]) for r in codes.select("code", o.alias("o"), e.alias("e"), h.alias("h")).collect()}
    assert got["ok"] == ("success", None, 200)
    assert got["not_found"] == ("failure", "feature_lookup", 404)
    assert got["stale"] == ("rejected", None, 422) and got["domain_violation"] == ("rejected", None, 422)
    assert got["internal"] == ("failure", "internal", 500)
    assert got["invalid_request"] == ("invalid", None, 422)


def test_stub_model_scores_every_row(spark):
    m = metrics_df(spark, metrics_rows(minutes=90))
    o = spark.createDataFrame([("station_1", OBS_TS), ("station_2", OBS_TS)], "station_id string, obs_ts timestamp_ntz")
    f = reconstruct(o, m)
    got = sco.score(f, sco.ConstantModel(42.0), FEATURE_ORDER).select("prediction").collect()
    assert [r[0] for r in got] == [42.0, 42.0]


def test_linear_model_and_nan_for_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, None)], "a double, b double")
    lm = sco.LinearModel(["a", "b"], {"a": 2.0, "b": 1.0}, bias=0.5)
    got = [r["prediction"] for r in sco.score(df, lm, ["a", "b"]).collect()]
    assert got[0] == 4.5 and np.isnan(got[1])
    assert lm.predict(np.array([[1.0, 2.0]]))[0] == 4.5


def test_text_is_parsed_once_a_row(spark):
    """The plan form gives what the expression gives, and a filter on a parsed time parses nothing again."""
    df = spark.createDataFrame([(k, s, SHAPES[-1 - k]) for k, s in enumerate(SHAPES)]
                               + [(98, "2024-01-01T12:00:00Z\n", None), (99, "0000-01-01T00:00:00", "")],
                               "k int, s string, t string")
    want = {r["k"]: (r["a"], r["b"]) for r in df.select("k", iso_time("s").alias("a"), iso_time("t").alias("b")).collect()}
    parsed = with_iso(df, {"a": F.col("s"), "b": F.col("t")})
    assert parsed.columns == ["k", "s", "t", "a", "b"]
    assert {r["k"]: (r["a"], r["b"]) for r in parsed.collect()} == want
    late = parsed.where(F.col("a.utc") > F.lit("2020-01-01").cast("timestamp_ntz")).where(F.col("b.wall").isNotNull())
    plan = late.select("k", "a.utc", "a.wall", "b")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?!0000)") == 2 and plan.count("regexp_replace(") == 2, plan
    assert late.count() == sum(a["utc"] is not None and b["wall"] is not None and a["utc"].year >= 2020 for a, b in want.values())


def test_no_cast_meets_empty_text(spark):
    """A cast of empty text, even one that is tried, fails by an exception for every row."""
    df = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-W01",), ("20240101T10+02",), ("2024-01-01",)], "t string")
    parsed = with_iso(df, {"p": F.col("t")})
    assert [r["p"]["utc"] for r in parsed.collect()] == [datetime(2024, 1, 1), None, datetime(2024, 1, 1, 8), None]
    analyzed = parsed._jdf.queryExecution().analyzed().toString()
    tried = re.findall(r"try_cast\((substring\(_iso0_text|\w+)", analyzed)
    assert set(tried) == {"substring(_iso0_text", "concat", "nullif"}, analyzed
