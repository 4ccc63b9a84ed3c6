"""Fixed names, types and constants shared by every plan."""

from __future__ import annotations

from pyspark.sql import types as T

MINUTE_US = 60 * 1_000_000
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for parity (feature order,
# dtypes, thresholds, error types, record layouts).
# ---------------------------------------------------------------------------

# Feature contract: name and dtype, in the declared order.
FEATURE_CONTRACT = [
    ("ft_bikes_available", "float64"),
    ("ft_docks_available", "float64"),
    ("ft_availability_ratio", "float64"),
    ("ft_bikes_available_lag_15m", "float64"),
    ("ft_bikes_available_lag_30m", "float64"),
    ("ft_bikes_available_lag_60m", "float64"),
    ("ft_bikes_available_lag_24h", "float64"),
    ("ft_avg_bikes_60m", "float64"),
    ("ft_min_bikes_60m", "float64"),
    ("ft_max_bikes_60m", "float64"),
    ("ft_avg_ratio_60m", "float64"),
    ("ft_avg_bikes_24h", "float64"),
    ("ft_min_bikes_24h", "float64"),
    ("ft_max_bikes_24h", "float64"),
    ("ft_low_avail_freq_24h", "float64"),
    ("ft_hour_of_day", "int32"),
    ("ft_day_of_week", "int32"),
    ("ft_is_weekend", "int32"),
    ("ft_capacity", "float64"),
    ("ft_pct_bikes_of_capacity", "float64"),
    ("ft_pct_docks_of_capacity", "float64"),
    ("ft_bikes_delta_60m", "float64"),
]
FEATURE_ORDER = [name for name, _ in FEATURE_CONTRACT]

CONTRACT_VERSION = "v1"
ENTITY_KEY = "station_id"
TARGET = "target_empty_next_hour"

# Contract dtypes and the Spark type each one is coerced to.
ALLOWED_DTYPES = ["float32", "float64", "int32", "int64", "bool", "object", "str"]
DTYPE_TO_SPARK = {
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "bool": T.BooleanType(),
    "object": T.StringType(),
    "str": T.StringType(),
}

MIN_CAPACITY = 5.0                 # capacity below this is out of domain
MAX_SNAPSHOT_STALENESS_MIN = 15    # snapshot older than this is stale

# Look-backs of the point-in-time features.
LAGS = {"15m": 15 * MINUTE_US, "30m": 30 * MINUTE_US, "60m": 60 * MINUTE_US, "24h": DAY_US}
ROLLING_60M_US = 60 * MINUTE_US
ROLLING_24H_US = DAY_US

# Per-request outcome codes, in the order the checks run.
OUTCOME_OK = "ok"
OUTCOME_NOT_FOUND = "not_found"
OUTCOME_DOMAIN = "domain_violation"
OUTCOME_STALE = "stale"
OUTCOME_MISSING = "missing_feature"
OUTCOME_DTYPE = "dtype_error"
OUTCOME_INVALID_REQUEST = "invalid_request"
OUTCOME_INTERNAL = "internal"
OUTCOME_MODEL_NOT_READY = "model_not_ready"

ENDPOINT = "/predict"
SCHEMA_VERSION = "v1"
EVENT_TYPE = "serving_deployment_activated"
PERCENTILES = {"latency_p50_ms": 50, "latency_p95_ms": 95, "latency_p99_ms": 99}

# Raw 1-minute station metrics.
METRICS_SCHEMA = T.StructType([
    T.StructField("station_id", T.StringType()),
    T.StructField("window_start", T.TimestampNTZType()),
    T.StructField("window_end", T.TimestampNTZType()),
    T.StructField("avg_bikes_available", T.DoubleType()),
    T.StructField("avg_docks_available", T.DoubleType()),
    T.StructField("avg_capacity", T.DoubleType()),
    T.StructField("avg_availability_ratio", T.DoubleType()),
    T.StructField("low_availability_events", T.LongType()),
    T.StructField("event_count", T.LongType()),
    T.StructField("emitted_at", T.TimestampNTZType()),
])

# Lineage context fields.
LINEAGE_STRING_FIELDS = [
    "service_name", "service_version", "environment", "deployment_id",
    "model_name", "model_version", "bundle_id", "bundle_uri",
    "input_dataset_name", "input_dataset_version",
]

# Deployment event record, in contract order.
EVENT_FIELDS = [
    "event_type", "event_time", "service_name", "service_version", "environment",
    "deployment_id", "instance_id", "model_name", "model_version", "bundle_id",
    "bundle_uri", "bundle_created_at", "input_dataset_name", "input_dataset_version",
    "started_at", "completed_at", "activation_reason", "traffic_status", "schema_version",
]
EVENT_NON_BLANK = LINEAGE_STRING_FIELDS + ["activation_reason", "traffic_status"]
EVENT_TIME_FIELDS = ["event_time", "bundle_created_at", "started_at", "completed_at"]

# Metrics window record, in contract order.
WINDOW_COUNT_FIELDS = [
    "request_count", "success_count", "failure_count", "rejected_count", "timeout_count",
]
WINDOW_ERROR_FIELDS = [
    "validation_error_count", "feature_lookup_error_count", "model_load_error_count",
    "inference_runtime_error_count", "dependency_error_count", "internal_error_count",
]
WINDOW_INPUT_FIELDS = [
    "input_schema_failure_count", "missing_required_field_count", "invalid_type_count",
    "domain_violation_count",
]
WINDOW_PREDICTION_FIELDS = [
    "prediction_count", "prediction_null_count", "prediction_non_finite_count",
    "prediction_out_of_range_count", "fallback_prediction_count",
]
WINDOW_OPTIONAL_DOUBLE = ["feature_lookup_p95_ms", "model_exec_p95_ms"]
WINDOW_OPTIONAL_LONG = [
    "missing_feature_count", "default_imputed_feature_count", "stale_feature_count",
    "feature_vector_build_failure_count",
]
WINDOW_FIELDS = (
    ["schema_version", "window_start", "window_end", "service_name", "service_version",
     "environment", "deployment_id", "model_name", "model_version", "bundle_id",
     "input_dataset_name", "input_dataset_version", "endpoint_name"]
    + WINDOW_COUNT_FIELDS
    + ["latency_p50_ms", "latency_p95_ms", "latency_p99_ms"] + WINDOW_OPTIONAL_DOUBLE
    + WINDOW_ERROR_FIELDS + WINDOW_INPUT_FIELDS + WINDOW_PREDICTION_FIELDS
    + WINDOW_OPTIONAL_LONG + ["heartbeat_emitted_at"]
)
WINDOW_NON_BLANK = [
    "service_name", "service_version", "environment", "deployment_id", "model_name",
    "model_version", "bundle_id", "input_dataset_name", "input_dataset_version",
    "endpoint_name",
]
# Counters the serving path never increments; emitted as 0.
WINDOW_ALWAYS_ZERO = [
    "timeout_count", "dependency_error_count", "input_schema_failure_count",
    "missing_required_field_count", "invalid_type_count", "domain_violation_count",
    "prediction_out_of_range_count", "fallback_prediction_count",
]
