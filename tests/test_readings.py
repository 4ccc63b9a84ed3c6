"""The store of readings with its last one of each day, and features made from it."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from helpers import metrics_df
from tidemark.operators import scoring as sco
from tidemark.operators.contract import Contract
from tidemark.operators.features import reconstruct
from tidemark.operators.serving import predict_requests
from tidemark.schemas import FEATURE_CONTRACT, METRICS_SCHEMA
from tidemark.sources.readings import ReadingStore, newest_of_day
from tidemark.streaming import start_prediction_stream

T0 = datetime(2025, 6, 1)
CONTRACT = Contract("v", "station_id", tuple(FEATURE_CONTRACT), "t")


def reading(station, minutes, bikes, emitted=5):
    at = T0 + timedelta(minutes=minutes)
    return (station, at, at + timedelta(minutes=1), bikes, 20.0 - bikes, 20.0, bikes / 20.0, 0, 1, at + timedelta(seconds=emitted))


def parts():
    """Three batches: a busy station, one silent for ten days, one that starts late, equal times, a null station."""
    first = [reading("busy", m, float(m % 17)) for m in range(0, 2 * 1440, 30)] + [reading("silent", m, 3.0) for m in range(0, 90, 10)]
    second = [reading("busy", m, float(m % 13)) for m in range(2 * 1440, 12 * 1440, 60)]
    second += [reading("busy", 2 * 1440, 9.0, emitted=50), (None, *reading("x", 0, 1.0)[1:])]
    third = [reading("late", m, 7.0) for m in range(11 * 1440, 11 * 1440 + 120, 7)] + [reading("silent", 12 * 1440, 8.0)]
    return first, second, third


def points():
    out = [(s, T0 + timedelta(minutes=m)) for s in ("busy", "silent", "late", "nowhere")
           for m in (-5, 0, 45, 1440, 1441, 2 * 1440, 3 * 1440 + 7, 11 * 1440 + 20, 12 * 1440, 12 * 1440 + 3, 30 * 1440)]
    return out + [(None, T0), ("busy", None)]


def rows(df):
    return sorted(map(str, df.collect()))


def test_store_gives_the_features_of_the_whole_history(spark, tmp_dir):
    store = ReadingStore(spark, tmp_dir)
    assert store.near(spark.createDataFrame(points(), "station_id string, obs_ts timestamp_ntz"))[0].count() == 0
    for n, part in enumerate(parts()):
        assert store.append(metrics_df(spark, part), n)
    assert not store.append(metrics_df(spark, parts()[2]), 2)
    every = metrics_df(spark, [r for p in parts() for r in p])
    assert store.readings.count() == every.where("station_id IS NOT NULL").count()
    obs = spark.createDataFrame(points(), "station_id string, obs_ts timestamp_ntz")
    near, carried = store.near(obs)
    want = rows(reconstruct(obs, every))
    assert rows(reconstruct(obs, near, carried=carried)) == want
    assert store.compact(datetime(2025, 6, 10).date())
    assert rows(store.last_of_day.where("date < '2025-06-10'")) == rows(
        newest_of_day(store.readings.where("date < '2025-06-10'").drop("date")).select(store.last_of_day.columns))
    near, carried = store.near(obs)
    assert rows(reconstruct(obs, near, carried=carried)) == want


def test_a_batch_of_requests_reads_three_days_and_the_last_ones(spark, tmp_dir):
    store = ReadingStore(spark, tmp_dir)
    for n, part in enumerate(parts()):
        store.append(metrics_df(spark, part), n)
    obs = spark.createDataFrame([("silent", T0 + timedelta(days=10, minutes=3))], "station_id string, obs_ts timestamp_ntz")
    near, carried = store.near(obs)
    got = reconstruct(obs, near, carried=carried).first()
    assert got["snapshot_source_ts"] == T0 + timedelta(minutes=80) and got["outcome"] == "stale"
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and near.where("window_start < '2025-06-08'").count() == 0
    dates = {os.path.basename(os.path.dirname(f)) for f in near.inputFiles()}
    assert len(store.readings.select("date").distinct().collect()) == 13 and near.select(F.to_date("window_start")).distinct().count() == 3
    assert dates  # the scan's own list of files is cut by the partition filter


def test_prediction_stream_from_the_store(spark, tmp_dir):
    """The same answers as from the whole history, for a station silent for ten days and one never seen."""
    store = ReadingStore(spark, os.path.join(tmp_dir, "store"))
    src = os.path.join(tmp_dir, "readings")
    for part in parts():
        metrics_df(spark, part).write.mode("append").parquet(src)
    store.stream(spark.readStream.schema(METRICS_SCHEMA).parquet(src), os.path.join(tmp_dir, "c0"), available_now=True).awaitTermination(300)
    every = metrics_df(spark, [r for p in parts() for r in p])
    assert store.readings.count() == every.where("station_id IS NOT NULL").count()

    req = spark.createDataFrame([(n, s, t.isoformat()) for n, (s, t) in enumerate(points()) if s and t] + [(99, " ", "2025-06-02T00:00:00"), (98, "busy", "soon")],
                                "n int, entity_id string, timestamp string")
    req.coalesce(1).write.parquet(os.path.join(tmp_dir, "req"))
    stream = spark.readStream.schema(req.schema).parquet(os.path.join(tmp_dir, "req"))
    model = sco.ConstantModel(0.5)
    start_prediction_stream(stream, store, model, CONTRACT, "v", os.path.join(tmp_dir, "out"), checkpoint=os.path.join(tmp_dir, "c1"),
                            available_now=True).awaitTermination(300)
    got = spark.read.parquet(os.path.join(tmp_dir, "out"))
    want = predict_requests(req, every, model, CONTRACT, "v")
    assert rows(got.select(want.columns)) == rows(want) and got.where("code = 'stale'").count() > 3
