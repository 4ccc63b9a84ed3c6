"""The README's usage flow, end to end on the smallest tables."""

import json
import os

from pyspark.sql import functions as F

from conftest import SMALL
from tidemark.operators import contract, features, lineage, metrics, scoring, serving
from tidemark.plans.common import Inputs
from tidemark.plans.queries import DEFAULT_CONTRACT
from tidemark.sources.artifacts import read_bundle_metadata
from tidemark.sources.sinks import write_deployment_events, write_metrics_windows
from tidemark.sources.tables import read_station_metrics, write_station_metrics


def test_readme_flow(spark, tmp_dir):
    i = Inputs(spark, SMALL)
    write_station_metrics(i.metrics, os.path.join(tmp_dir, "m"))
    m = read_station_metrics(spark, os.path.join(tmp_dir, "m"))
    assert "date" in m.columns and m.count() == i.metrics.count()
    with open(os.path.join(tmp_dir, "feature_schema.json"), "w") as fh:
        json.dump({"version": "v1", "entity_key": "station_id", "target": "t",
                   "features": [{"name": n, "dtype": t} for n, t in DEFAULT_CONTRACT.features]}, fh)
    c = contract.collect_contract(contract.read_contracts(spark, os.path.join(tmp_dir, "feature_schema.json")))
    assert c.names == DEFAULT_CONTRACT.names
    assert features.reconstruct(i.obs, m).count() == i.obs.count()
    preds = serving.predict_requests(i.requests, m, scoring.ConstantModel(1.0), c, model_version="v1")
    assert preds.count() == i.requests.count()
    bundle = os.path.join(tmp_dir, "models", "harbour", "v1")
    os.makedirs(bundle)
    with open(os.path.join(bundle, "model_metadata.json"), "w") as fh:
        json.dump({"model_version": "v1", "trained_at": "2024-01-01T00:00:00Z", "input_dataset_name": "x",
                   "input_dataset_version": "1", "started_at": "2024-01-01T00:00:00Z",
                   "completed_at": "2024-01-01T01:00:00Z"}, fh)
    ctx = lineage.bundle_lineage(read_bundle_metadata(spark, os.path.join(tmp_dir, "models"), deployment_id="0"))
    assert ctx.where("valid").count() == 1
    acts = i.activations.where(F.col("deployment_id") == "0")
    out = os.path.join(tmp_dir, "out")
    write_deployment_events(lineage.deployment_events(acts, ctx), out)
    windows = metrics.window_records(metrics.metrics_windows(i.request_log), ctx.where("valid"))
    n = windows.count()
    assert n > 0
    write_metrics_windows(windows, out)
    assert spark.read.json(os.path.join(out, "artifacts", "serving", "metrics")).count() == n
