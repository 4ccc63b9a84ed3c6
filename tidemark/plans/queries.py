"""Registered queries: one per operator group of the survey inventory.

Each takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
tables of that directory. ``tidemark.plans.oracle.ORACLES`` holds the DuckDB
statement of the same result for every key that has one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import iso_text, py_strip, with_iso
from tidemark.operators import contract as con
from tidemark.operators import features as feat
from tidemark.operators import lineage as lin
from tidemark.operators import metrics as met
from tidemark.operators import outcomes as outc
from tidemark.operators import scoring as sco
from tidemark.operators import serving as srv
from tidemark.operators import snapshot as snp
from tidemark.operators import validate as val
from tidemark.plans.common import Inputs, round6, round_doubles, scratch
from tidemark.schemas import (
    CONTRACT_VERSION, ENTITY_KEY, EVENT_NON_BLANK, EVENT_TIME_FIELDS, FEATURE_CONTRACT, FEATURE_ORDER, TARGET,
    WINDOW_COUNT_FIELDS, WINDOW_ERROR_FIELDS, WINDOW_INPUT_FIELDS, WINDOW_NON_BLANK, WINDOW_OPTIONAL_DOUBLE,
    WINDOW_OPTIONAL_LONG, WINDOW_PREDICTION_FIELDS,
)
from tidemark.sources import standins
from tidemark.sources.readings import ReadingStore
from tidemark.sources.sinks import EVENTS_DIR, event_partitions, metrics_partitions, write_deployment_events
from tidemark.sources.standins import zoned_text
from tidemark.streaming.ledger import MetricsLedger, current_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- features
@register("obs_points")
def obs_points(spark, sf_dir):
    return Inputs(spark, sf_dir).obs


@register("asof_snapshot")
def asof_snapshot(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    parts = feat.point_in_time_parts(i.obs, i.metrics, lags=False, rolling=False)
    out = parts.select("station_id", "obs_ts", *feat.snapshot_columns(parts))
    return round_doubles(out.where(F.col("snapshot_source_ts").isNotNull()))


@register("asof_lags")
def asof_lags(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    parts = feat.point_in_time_parts(i.obs, i.metrics, snapshot=False, rolling=False)
    return round_doubles(parts.select("station_id", "obs_ts", *feat.lag_columns()))


def _rolling(spark, sf_dir, names):
    i = Inputs(spark, sf_dir)
    parts = feat.point_in_time_parts(i.obs, i.metrics, snapshot=False, lags=False)
    out = parts.select("station_id", "obs_ts", *feat.rolling_columns())
    return round_doubles(out.select("station_id", "obs_ts", *names))


@register("rolling_60m")
def rolling_60m(spark, sf_dir):
    return _rolling(spark, sf_dir, ["ft_avg_bikes_60m", "ft_min_bikes_60m",
                                    "ft_max_bikes_60m", "ft_avg_ratio_60m"])


@register("rolling_24h")
def rolling_24h(spark, sf_dir):
    return _rolling(spark, sf_dir, ["ft_avg_bikes_24h", "ft_min_bikes_24h", "ft_max_bikes_24h"])


@register("low_avail_freq_24h")
def low_avail_freq_24h(spark, sf_dir):
    return _rolling(spark, sf_dir, ["ft_low_avail_freq_24h"])


@register("temporal_features")
def temporal_features(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return i.obs.select("station_id", "obs_ts", *feat.temporal_columns())


@register("derived_ratios")
def derived_ratios(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    full = feat.reconstruct(i.obs, i.metrics).where(F.col("outcome") != "not_found")
    return round_doubles(full.select("station_id", "obs_ts", "ft_pct_bikes_of_capacity",
                                     "ft_pct_docks_of_capacity", "ft_bikes_delta_60m"))


@register("pit_features")
def pit_features(spark, sf_dir):
    """Flagship: all 22 features for every observation point with a snapshot."""
    i = Inputs(spark, sf_dir)
    full = feat.reconstruct(i.obs, i.metrics).where(F.col("outcome") != "not_found")
    return round_doubles(full.select("station_id", "obs_ts", "snapshot_source_ts", *FEATURE_ORDER))


@register("obs_outcome")
def obs_outcome(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return feat.reconstruct(i.obs, i.metrics).select("station_id", "obs_ts", "outcome")


# ---------------------------------------------------------------- contracts

DEFAULT_CONTRACT = con.Contract(CONTRACT_VERSION, ENTITY_KEY, tuple(FEATURE_CONTRACT), TARGET)

# A contract declared in a different order than the frame's columns.
REORDERED_CONTRACT = con.Contract("reordered-v1", ENTITY_KEY, (
    ("ft_capacity", "float64"), ("ft_hour_of_day", "int32"), ("ft_bikes_available", "float64"),
    ("ft_avg_bikes_24h", "float64"), ("ft_is_weekend", "int32"), ("ft_bikes_available_lag_15m", "float64"),
), TARGET)

# A contract that coerces: truncation to int, int from a nullable double,
# text, truthiness, a text column that does not always parse as an int.
COERCION_CONTRACT = con.Contract("coercion-v1", ENTITY_KEY, (
    ("ft_bikes_available", "float64"), ("ft_capacity", "int64"),
    ("ft_bikes_available_lag_24h", "int32"), ("ft_hour_of_day", "str"),
    ("ft_is_weekend", "bool"), ("ft_availability_ratio", "float64"), ("hour_text", "int64"),
), TARGET)


def _found_features(i: Inputs):
    return feat.reconstruct(i.obs, i.metrics).where(F.col("outcome") != "not_found")


@register("vector_in_order")
def vector_in_order(spark, sf_dir):
    v = con.vector(_found_features(Inputs(spark, sf_dir)), REORDERED_CONTRACT, keep=["station_id", "obs_ts"])
    named = [F.col(n).alias(f"f{p + 1:02d}_{n}") for p, n in enumerate(REORDERED_CONTRACT.names)]
    return round_doubles(v.select("station_id", "obs_ts", *named))


def _coercion_input(spark, sf_dir):
    f = _found_features(Inputs(spark, sf_dir))
    h = F.col("ft_hour_of_day")
    return f.withColumn("hour_text", F.when(h % 5 == 0, F.concat(h.cast("string"), F.lit(".5")))
                        .otherwise(h.cast("string")))


@register("coerce_strict")
def coerce_strict(spark, sf_dir):
    c = con.coerce(_coercion_input(spark, sf_dir), COERCION_CONTRACT, strict=True, keep=["station_id", "obs_ts"])
    return round_doubles(c)


@register("coerce_nullable")
def coerce_nullable(spark, sf_dir):
    c = con.coerce(_coercion_input(spark, sf_dir), COERCION_CONTRACT, strict=False, keep=["station_id", "obs_ts"])
    return round_doubles(c)


@register("snapshot_lookup")
def snapshot_lookup(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    snap = snp.build_snapshot(i.metrics)
    j = snp.lookup(i.obs, snap)
    return round_doubles(j.select("station_id", "obs_ts", "found", "snapshot_ts_text", "ft_bikes_available"))


# ---------------------------------------------------------------- requests
@register("request_normalize")
def request_normalize(spark, sf_dir):
    return outc.normalize_requests(Inputs(spark, sf_dir).requests).drop("elapsed_ms")


def request_codes(i: Inputs):
    """Every request with its check outcome code (reconstruction for the valid ones)."""
    req = outc.normalize_requests(i.requests)
    valid = req.where(F.col("status") == "ok").drop("status")
    checked = feat.reconstruct(valid, i.metrics).select("request_id", "station_id", "obs_ts",
                                                         outc.zone_checked(F.col("outcome"), F.col("zoned")).alias("code"))
    rest = req.where(F.col("status") != "ok").select("request_id", "station_id", "obs_ts",
                                                      F.col("status").alias("code"))
    return checked.unionByName(rest)


@register("outcome_map")
def outcome_map(spark, sf_dir):
    codes = request_codes(Inputs(spark, sf_dir))
    outcome, error_type, http = outc.serving_outcome(F.col("code"))
    return codes.select("request_id", "code", outcome.alias("outcome"), error_type.alias("error_type"),
                        http.alias("http_status"))


# ---------------------------------------------------------------- scoring
LINEAR = sco.LinearModel(
    [n for n, _ in FEATURE_CONTRACT],
    {"ft_bikes_available": 0.5, "ft_docks_available": -0.25, "ft_avg_bikes_60m": 0.1,
     "ft_hour_of_day": 0.05, "ft_is_weekend": 1.0},
    bias=2.0)


def _ok_vectors(i: Inputs):
    f = feat.reconstruct(i.obs, i.metrics).where(F.col("outcome") == "ok")
    return con.coerce(f, DEFAULT_CONTRACT, strict=False, keep=["station_id", "obs_ts"]) \
        .where(F.col("dtype_status") == "ok")


@register("score_batch")
def score_batch(spark, sf_dir):
    """Prediction records for every observation that passes the checks."""
    v = _ok_vectors(Inputs(spark, sf_dir))
    scored = sco.score(v, sco.ConstantModel(42.0), DEFAULT_CONTRACT.names)
    return scored.select(F.col("station_id").alias("entity_id"), iso_text("obs_ts").alias("timestamp"),
                         "prediction", F.lit("v1").alias("model_version"),
                         F.array(*[F.lit(n) for n in DEFAULT_CONTRACT.names]).alias("features_used"))


@register("score_linear")
def score_linear(spark, sf_dir):
    v = _ok_vectors(Inputs(spark, sf_dir))
    scored = sco.score(v, LINEAR, DEFAULT_CONTRACT.names)
    return round_doubles(scored.select("station_id", "obs_ts", "prediction"))


@register("predict_requests")
def predict_requests(spark, sf_dir):
    """The serving path for every request: text to checked features to records."""
    i = Inputs(spark, sf_dir)
    out = srv.predict_requests(i.requests, i.metrics, LINEAR, DEFAULT_CONTRACT, "v1", latency_col="elapsed_ms")
    return out.withColumn("prediction", round6("prediction"))


# ---------------------------------------------------------------- metrics windows
@register("metrics_window_counts")
def metrics_window_counts(spark, sf_dir):
    w = met.window_aggregates(Inputs(spark, sf_dir).request_log)
    return w.select(*met.WINDOW_KEYS, "request_count", "success_count", "failure_count", "rejected_count")


@register("metrics_window_errors")
def metrics_window_errors(spark, sf_dir):
    w = met.window_aggregates(Inputs(spark, sf_dir).request_log)
    return w.select(*met.WINDOW_KEYS, "validation_error_count", "feature_lookup_error_count",
                    "model_load_error_count", "inference_runtime_error_count", "internal_error_count")


@register("prediction_quality")
def prediction_quality(spark, sf_dir):
    w = met.window_aggregates(Inputs(spark, sf_dir).request_log)
    return w.select(*met.WINDOW_KEYS, "prediction_count", "prediction_null_count",
                    "prediction_non_finite_count")


@register("latency_percentiles")
def latency_percentiles(spark, sf_dir):
    return met.latency_percentiles(Inputs(spark, sf_dir).request_log)


def valid_lineage(i: Inputs):
    return lin.bundle_lineage(i.bundle_metadata).where(F.col("valid"))


def window_records(i: Inputs):
    return met.window_records(met.metrics_windows(i.request_log), valid_lineage(i))


@register("metrics_window")
def metrics_window(spark, sf_dir):
    """Full window records (heartbeat left out: it is the emission time)."""
    return window_records(Inputs(spark, sf_dir)).drop("heartbeat_emitted_at")


@register("metrics_window_lineage")
def metrics_window_lineage(spark, sf_dir):
    r = window_records(Inputs(spark, sf_dir))
    return r.select("window_start", "endpoint_name", "deployment_id", "service_name", "model_name",
                    "model_version", "bundle_id", "input_dataset_name", "input_dataset_version")


@register("sink_metrics_layout")
def sink_metrics_layout(spark, sf_dir):
    r = metrics_partitions(window_records(Inputs(spark, sf_dir)))
    return r.select("window_start", "deployment_id", "date", "hour", "minute")


def broken(df, number, faults):
    """Row with ``number`` modulo the list = n gets the n-th (field, bad value); 0 keeps its row whole."""
    out = {}
    for n, (field, bad) in enumerate(faults, 1):
        out[field] = F.when(number % (len(faults) + 1) == n, bad.cast(df.schema[field].dataType)) \
            .otherwise(out.get(field, F.col(field)))
    return df.withColumns(out)


@register("validate_windows")
def validate_windows(spark, sf_dir):
    """Every rule meets windows that break it."""
    numbers = (WINDOW_COUNT_FIELDS + WINDOW_ERROR_FIELDS + WINDOW_INPUT_FIELDS + WINDOW_PREDICTION_FIELDS
               + ["latency_p50_ms", "latency_p95_ms", "latency_p99_ms"] + WINDOW_OPTIONAL_DOUBLE + WINDOW_OPTIONAL_LONG)
    none = F.lit(None)
    faults = ([(c, F.lit("  ")) for c in WINDOW_NON_BLANK] + [("window_end", F.col("window_start"))]
              + [(c, F.lit(-1)) for c in numbers]
              + [("schema_version", F.lit("v0")), ("heartbeat_emitted_at", none), ("window_end", none)])
    r = window_records(Inputs(spark, sf_dir)).withColumns(
        {"deployment": F.col("deployment_id"), "endpoint": F.col("endpoint_name"),
         "minute_no": F.timestamp_diff("MINUTE", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("window_start"))})
    v = val.validate_windows(broken(r, F.col("minute_no"), faults))
    return v.select("window_start", "endpoint", "deployment", "valid", F.array_join("reasons", ",").alias("reasons"))


# ---------------------------------------------------------------- lineage and events
@register("bundle_lineage")
def bundle_lineage(spark, sf_dir):
    ctx = lin.bundle_lineage(Inputs(spark, sf_dir).bundle_metadata)
    return ctx.withColumn("reasons", F.array_join("reasons", ","))


@register("deployment_events")
def deployment_events(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return lin.deployment_events(i.activations, lin.bundle_lineage(i.bundle_metadata))


@register("validate_events")
def validate_events(spark, sf_dir):
    """Every rule meets events that break it."""
    i = Inputs(spark, sf_dir)
    faults = ([(c, F.lit(" ")) for c in EVENT_NON_BLANK] + [(c, F.lit(None)) for c in EVENT_TIME_FIELDS]
              + [("event_type", F.lit("other")), ("schema_version", F.lit("v0"))])
    ev = lin.event_records(i.activations, lin.bundle_lineage(i.bundle_metadata)) \
        .withColumn("order_no", F.col("deployment_id").cast("long"))
    v = val.validate_events(broken(ev, F.col("order_no"), faults))
    return v.select("order_no", "valid", F.array_join("reasons", ",").alias("reasons"))


@register("sink_events_layout")
def sink_events_layout(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    ev = event_partitions(lin.deployment_events(i.activations, lin.bundle_lineage(i.bundle_metadata)))
    return ev.select("deployment_id", "event_time", "date")


@register("normalize_utc")
def normalize_utc(spark, sf_dir):
    z = with_iso(zoned_text(Inputs(spark, sf_dir).orders), {"t": py_strip("ts_text")})
    return z.select("o_orderkey", "ts_text", F.col("t.utc").alias("utc_ts"), F.col("t.utc").isNotNull().alias("valid"))


# ---------------------------------------------------------------- rejects, contexts, stored inputs, the ledger
@register("log_rejects")
def log_rejects(spark, sf_dir):
    """Every log row that is in no window, with its reason."""
    return met.rejected_log(standins.noisy_log(Inputs(spark, sf_dir).events)).select("request_id", "reason")


@register("metrics_window_contexts")
def metrics_window_contexts(spark, sf_dir):
    """Windows of deployments that get bundle after bundle: each has the context in force at its start."""
    i = Inputs(spark, sf_dir)
    rollout = standins.redeployments(i.orders)
    events = lin.deployment_events(rollout, lin.bundle_lineage(i.bundle_metadata))
    moved = events.join(rollout.select("deployment_id", "onto"), "deployment_id").drop("deployment_id")
    contexts = lin.activated_contexts(moved.withColumnRenamed("onto", "deployment_id"))
    return met.window_records(met.metrics_windows(i.request_log), contexts).select(
        "window_start", "endpoint_name", "deployment_id", "model_version", "bundle_id", "request_count", "latency_p95_ms")


def stored_readings(spark, i: Inputs) -> ReadingStore:
    """The station metrics, stored in two batches of alternate minutes, the second sent twice."""
    store = ReadingStore(spark, scratch(spark, "readings"))
    for n in (0, 1, 1):
        store.append(i.metrics.where(F.minute("window_start") % 2 == n), n)
    return store


@register("raw_metrics_stored")
def raw_metrics_stored(spark, sf_dir):
    """Raw one-minute metrics read back from their store."""
    return round_doubles(stored_readings(spark, Inputs(spark, sf_dir)).readings.drop("date"))


@register("pit_from_store")
def pit_from_store(spark, sf_dir):
    """Features from the days around the observations and the last reading of each station and day."""
    i = Inputs(spark, sf_dir)
    near, carried = stored_readings(spark, i).near(i.obs)
    f = feat.reconstruct(i.obs, near, carried=carried)
    return round_doubles(f.where(F.col("snapshot_source_ts").isNotNull()).select("station_id", "obs_ts", "snapshot_source_ts", *FEATURE_ORDER))


@register("snapshot_stored")
def snapshot_stored(spark, sf_dir):
    """Look-ups in a Parquet snapshot opened as a view, by the key that the contract names."""
    i = Inputs(spark, sf_dir)
    path = scratch(spark, "snapshot")
    snp.build_snapshot(i.metrics).write.parquet(path)
    snp.open_snapshot(spark, path)
    j = snp.lookup(i.obs, spark.table("online_features"), key=DEFAULT_CONTRACT.entity_key)
    return round_doubles(j.select("station_id", "obs_ts", "found", "snapshot_ts_text", "ft_bikes_available"))


@register("sink_events_records")
def sink_events_records(spark, sf_dir):
    """Event records as they stand in the sink: one batch sent twice, then an empty one; nulls kept, times as UTC text."""
    i = Inputs(spark, sf_dir)
    events, base = lin.deployment_events(standins.redeployments(i.orders), lin.bundle_lineage(i.bundle_metadata)), scratch(spark, "events")
    for rows, batch_id in ((events, 1), (events, 1), (events.limit(0), 2)):
        write_deployment_events(rows, base, batch_id)
    line = spark.read.text(f"{base}/{EVENTS_DIR}")
    at = {c: F.get_json_object("value", f"$.{c}").alias(c) for c in
          ("event_time", "deployment_id", "instance_id", "bundle_uri", "bundle_created_at", "started_at", "completed_at", "schema_version")}
    return line.select(*at.values(), F.size(F.json_object_keys("value")).alias("n_fields"), F.col("date").cast("string").alias("date"))


@register("metrics_ledger")
def metrics_ledger(spark, sf_dir):
    """The windows of a log that comes in two batches, the second nearly all late: latest versions after the flush."""
    i = Inputs(spark, sf_dir)
    base, contexts = scratch(spark, "ledger"), scratch(spark, "contexts")
    valid_lineage(i).write.parquet(contexts)  # read in every batch
    ledger = MetricsLedger(spark, spark.read.parquet(contexts), base, layout=("date",), span_hours=24)
    for n in (0, 1):
        ledger.ingest(i.request_log.where(F.pmod("request_id", F.lit(2)) == n), n)
    ledger.flush()
    return current_windows(spark, base).select("window_start", "deployment_id", "model_version", *met.COUNTERS, "latency_p50_ms",
                                               "latency_p95_ms", "latency_p99_ms")
