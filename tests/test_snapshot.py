"""Snapshot path: Parquet view, entity look-up keyed by the contract, newest
row for repeated keys, timestamp text, and the booster wrapper."""

import os
from datetime import datetime

import numpy as np
import pandas as pd

from helpers import OBS_TS, metrics_df, metrics_rows
from tidemark.operators import contract as con
from tidemark.operators import scoring as sco
from tidemark.operators import snapshot as snp


def test_open_snapshot_view_and_lookup_by_contract_key(spark, tmp_dir):
    path = os.path.join(tmp_dir, "online_features.parquet")
    pd.DataFrame({
        "station_id": ["station_1", "station_2", "station_2"],
        "snapshot_ts": ["2025-06-01T12:00:00Z", "2025-06-01T11:00:00Z", "2025-06-01T12:00:00Z"],
        "feat_a": [10.0, 1.0, 5.0],
    }).to_parquet(path, index=False)
    snap = snp.open_snapshot(spark, path)
    assert spark.sql("SELECT count(*) FROM online_features").collect()[0][0] == 3
    contract = con.Contract("v1", "station_id", (("feat_a", "float64"),), "t")
    req = spark.createDataFrame([("station_1",), ("station_2",), ("station_9",)], [contract.entity_key])
    got = {r["station_id"]: r for r in snp.lookup(req, snap, key=contract.entity_key).collect()}
    assert got["station_1"]["found"] and got["station_1"]["feat_a"] == 10.0
    assert got["station_2"]["feat_a"] == 5.0  # newest row of a repeated key
    assert got["station_1"]["snapshot_ts_text"] == "2025-06-01T12:00:00Z"  # text kept as is
    assert not got["station_9"]["found"] and got["station_9"]["snapshot_ts_text"] == "unknown"


def test_built_snapshot_is_newest_metrics_row(spark):
    m = metrics_df(spark, metrics_rows(minutes=120))
    snap = snp.build_snapshot(m).collect()
    assert {r["station_id"] for r in snap} == {"station_1", "station_2"}
    assert all(r["snapshot_ts"] == OBS_TS for r in snap)
    req = spark.createDataFrame([("station_1",)], ["station_id"])
    r = snp.lookup(req, snp.build_snapshot(m)).collect()[0]
    assert r["snapshot_ts_text"] == "2025-06-01 12:00:00" and r["ft_bikes_available"] == 10.0


def test_missing_feature_reaches_the_model_as_nan(spark):
    model = sco.LinearModel(["a"], {"a": 1.0}, bias=0.5)
    df = spark.createDataFrame([(0.0,), (None,)], "a double")
    got = [r["prediction"] for r in sco.score(df, model, ["a"]).collect()]
    assert got[0] == 0.5 and np.isnan(got[1])
