"""End-to-end prediction for a table of requests (the reference's
``POST /predict`` for many requests at once).

requests(entity_id, timestamp text, ...) -> normalise -> reconstruct the
features at each observation time -> ordered checks -> contract coercion ->
score the rows that pass -> one row per request with its outcome code,
serving outcome, error type, HTTP status and prediction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import iso_text
from tidemark.operators import contract as con
from tidemark.operators.features import reconstruct
from tidemark.operators.outcomes import normalize_requests, serving_outcome, zone_checked
from tidemark.operators.scoring import prediction_of, prediction_struct
from tidemark.schemas import (
    OUTCOME_DTYPE, OUTCOME_INTERNAL, OUTCOME_INVALID_REQUEST, OUTCOME_MODEL_NOT_READY, OUTCOME_OK,
)


def predict_requests(requests: DataFrame, metrics: DataFrame, model, contract: con.Contract,
                     model_version: str, *, id_col: str = "entity_id", ts_col: str = "timestamp",
                     include_features_used: bool = False, latency_col: str | None = None,
                     carried: DataFrame | None = None) -> DataFrame:
    """``carried``: as for ``features.reconstruct``. ``latency_col`` names the measured milliseconds of a request; the
    records of passed requests then carry them as ``latency_ms``, to 3 places.
    A row on which the model fails is ``internal``, the others keep theirs."""
    key = contract.entity_key
    req = normalize_requests(requests, id_col=id_col, ts_col=ts_col, key=key)
    payload = [c for c in req.columns if c not in (key, "obs_ts", "zoned", "status")]
    if model is None:
        # No model loaded: every request past validation fails before any
        # time parsing or feature work (model_load, 503), as in the reference.
        code = F.when(F.col("status") == OUTCOME_INVALID_REQUEST, F.col("status")) \
            .otherwise(F.lit(OUTCOME_MODEL_NOT_READY))
        out = req.select(*payload, key, "obs_ts", code.alias("code"),
                         F.lit(None).cast("double").alias("prediction"))
        return _records(out, payload, key, contract, model_version, include_features_used, latency_col)
    valid = req.where(F.col("status") == OUTCOME_OK).drop("status")
    feats = reconstruct(valid, metrics, key=key, carried=carried)
    con.check_present(feats, contract)
    feats = feats.withColumn("outcome", zone_checked(F.col("outcome"), F.col("zoned")))
    typed = con.coerce(feats, contract, strict=False, keep=[*payload, key, "obs_ts", "outcome"])
    code = F.when((F.col("outcome") == OUTCOME_OK) & (F.col("dtype_status") != "ok"),
                  F.lit(OUTCOME_DTYPE)).otherwise(F.col("outcome"))
    typed = typed.withColumn("code", code)
    # Only rows that passed reach the model; a conditional around the UDF would not keep the others from it.
    passed = typed.where(F.col("code") == OUTCOME_OK)
    scored = passed.select(*payload, key, "obs_ts", prediction_struct(passed, model, contract.names).alias("_scored"))
    failed = F.col("_scored.failed")
    checked = scored.select(*payload, key, "obs_ts",
                            F.when(failed, F.lit(OUTCOME_INTERNAL)).otherwise(F.lit(OUTCOME_OK)).alias("code"),
                            F.when(~failed, prediction_of(F.col("_scored"))).alias("prediction"))
    checked = checked.unionByName(typed.where(F.col("code") != OUTCOME_OK).select(
        *payload, key, "obs_ts", "code", F.lit(None).cast("double").alias("prediction")))
    rejected = req.where(F.col("status") != OUTCOME_OK).select(
        *payload, key, "obs_ts", F.col("status").alias("code"), F.lit(None).cast("double").alias("prediction"))
    out = checked.unionByName(rejected)
    return _records(out, payload, key, contract, model_version, include_features_used, latency_col)


def _records(out: DataFrame, payload: list[str], key: str, contract: con.Contract,
             model_version: str, include_features_used: bool, latency_col: str | None) -> DataFrame:
    outcome, error_type, http = serving_outcome(F.col("code"))
    cols = [*[c for c in payload if c != latency_col], F.col(key).alias("entity_id"), iso_text("obs_ts").alias("timestamp"), "code",
            outcome.alias("outcome"), error_type.alias("error_type"), http.alias("http_status"),
            "prediction", F.lit(model_version).alias("model_version")]
    if latency_col:
        cols.append(F.when(F.col("code") == OUTCOME_OK, F.round(F.col(latency_col), 3)).alias("latency_ms"))
    if include_features_used:
        cols.append(F.when(F.col("code") == OUTCOME_OK,
                           F.array(*[F.lit(n) for n in contract.names])).alias("features_used"))
    return out.select(*cols)
