"""Serving-metrics windows: 60-second UTC tumbling windows over a request log.

Input columns: ``completed_at`` (event time), ``endpoint_name``,
``deployment_id``, ``outcome`` (success / failure / rejected),
``error_type``, ``latency_ms``, ``prediction``. Zero-traffic windows do not
exist by construction (groups come from rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import micros
from tidemark.operators.percentile import nearest_rank
from tidemark.schemas import (
    DAY_US, PERCENTILES, SCHEMA_VERSION, WINDOW_ALWAYS_ZERO, WINDOW_FIELDS,
    WINDOW_OPTIONAL_DOUBLE, WINDOW_OPTIONAL_LONG,
)

WINDOW_KEYS = ["window_start", "window_end", "endpoint_name", "deployment_id"]
WINDOW_SECONDS = 60
FROM_EVER = -(1 << 62)  # microseconds before any time

HANDLED = ["success", "failure", "rejected"]


def handled(log: DataFrame) -> DataFrame:
    """Requests the handler saw, at a known time. A request rejected before
    it (a blank entity id fails request validation; outcome 'invalid') is in
    no window, nor is one whose outcome is none of these: see ``rejected_log``."""
    return log.where(F.col("outcome").isin(*HANDLED))


def reject_reason(time_col: str = "completed_at") -> Column:
    """Why a log row is in no window; NULL for a row that is in one."""
    outcome = F.col("outcome")
    return (F.when(outcome == "invalid", F.lit("invalid_request"))
            .when(~F.coalesce(outcome.isin(*HANDLED), F.lit(False)), F.lit("unknown_outcome"))
            .when(F.col(time_col).isNull(), F.lit("no_time")))


def rejected_log(log: DataFrame, time_col: str = "completed_at") -> DataFrame:
    """The log rows that no window counts, each with its ``reason``: every row
    of a log is either here or in the ``request_count`` of one window."""
    return log.withColumn("reason", reject_reason(time_col)).where(F.col("reason").isNotNull())


def with_window(log: DataFrame, time_col: str = "completed_at") -> DataFrame:
    """Attach the minute-aligned window of each handled request (kept as columns)."""
    w = F.window(time_col, f"{WINDOW_SECONDS} seconds")
    return handled(log).withColumn("window_start", w.start).withColumn("window_end", w.end)


def _is(outcome: str) -> Column:
    return F.col("outcome") == outcome


def indicators() -> dict[str, Column]:
    """Every counter of a window as a per-row 0/1 indicator (defined once;
    summed by the batch and the streaming aggregations)."""
    et, p = F.col("error_type"), F.col("prediction")
    ok, failed = _is("success"), _is("failure")
    known = F.coalesce(et.isin("feature_lookup", "model_load", "inference_runtime"), F.lit(False))
    flags = {
        "request_count": F.lit(True),
        "success_count": ok,
        "failure_count": failed,
        "rejected_count": _is("rejected"),
        "validation_error_count": _is("rejected"),
        "feature_lookup_error_count": failed & (et == "feature_lookup"),
        "model_load_error_count": failed & (et == "model_load"),
        "inference_runtime_error_count": failed & (et == "inference_runtime"),
        "internal_error_count": failed & ~known,
        "prediction_count": ok,
        "prediction_null_count": ok & (p.isNull() | F.isnan(p)),
        "prediction_non_finite_count": ok & (F.isnan(p) | (F.abs(p) == F.lit(float("inf")))),
    }
    return {n: F.coalesce(c, F.lit(False)).cast("long") for n, c in flags.items()}


COUNT_FIELDS = ["request_count", "success_count", "failure_count", "rejected_count"]
ERROR_FIELDS = ["validation_error_count", "feature_lookup_error_count", "model_load_error_count",
                "inference_runtime_error_count", "internal_error_count"]
PREDICTION_FIELDS = ["prediction_count", "prediction_null_count", "prediction_non_finite_count"]
COUNTERS = COUNT_FIELDS + ERROR_FIELDS + PREDICTION_FIELDS


def _sums(names: list[str]) -> list[Column]:
    ind = indicators()
    return [F.sum(ind[n]).alias(n) for n in names]


def count_columns() -> list[Column]:
    return _sums(COUNT_FIELDS)


def error_columns() -> list[Column]:
    return _sums(ERROR_FIELDS)


def prediction_columns() -> list[Column]:
    return _sums(PREDICTION_FIELDS)


def window_aggregates(log: DataFrame, time_col: str = "completed_at") -> DataFrame:
    """Counters per window, endpoint and deployment (partial aggregation before the shuffle)."""
    return (with_window(log, time_col).groupBy(*WINDOW_KEYS)
            .agg(*count_columns(), *error_columns(), *prediction_columns()))


def _zero_if_empty(names) -> list[Column]:
    return [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in names]


def latency_percentiles(log: DataFrame, time_col: str = "completed_at") -> DataFrame:
    """Exact nearest-rank p50/p95/p99 over all outcomes; 0.0 for an empty window."""
    p = nearest_rank(with_window(log, time_col), WINDOW_KEYS, "latency_ms", PERCENTILES)
    return p.select(*WINDOW_KEYS, *_zero_if_empty(PERCENTILES))


def metrics_windows(log: DataFrame, time_col: str = "completed_at") -> DataFrame:
    """Counters and latency percentiles of every non-empty window, in one
    pass over the log: the counters are summed alongside the value counts
    of the percentile operator instead of in a second aggregation + join."""
    ind = indicators()
    res = nearest_rank(with_window(log, time_col), WINDOW_KEYS, "latency_ms", PERCENTILES,
                       sums={n: ind[n] for n in COUNTERS})
    return res.select(*WINDOW_KEYS, *COUNTERS, *_zero_if_empty(PERCENTILES))


def value_counts(log: DataFrame, time_col: str = "completed_at") -> DataFrame:
    """Partial aggregates that merge by being unioned: per window and latency
    its number of requests ``n``, the counters and the microseconds of its
    newest request. A hot window is as many rows as it has latencies, spread
    over tasks."""
    ind = indicators()
    return (with_window(log, time_col).groupBy(*WINDOW_KEYS, "latency_ms")
            .agg(F.count("latency_ms").alias("n"), *[F.sum(ind[c]).alias(c) for c in COUNTERS],
                 F.max(micros(time_col)).alias("newest")))


def windows_of(counts: DataFrame) -> DataFrame:
    """The windows of ``value_counts``: counters and percentiles, as ``metrics_windows`` has them."""
    res = nearest_rank(counts, WINDOW_KEYS, "latency_ms", PERCENTILES, sums={c: F.col(c) for c in COUNTERS}, weight_col="n")
    return res.select(*WINDOW_KEYS, *COUNTERS, *_zero_if_empty(PERCENTILES))


CONTEXT_FIELDS = ["service_name", "service_version", "environment", "model_name", "model_version", "bundle_id",
                  "input_dataset_name", "input_dataset_version"]


def with_context(windows: DataFrame, lineage: DataFrame) -> DataFrame:
    """Windows with the lineage context that is valid at their start; NULL fields where there is none at all.

    A context is valid from its time (``activated_at``; without that column
    from ``bundle_created_at``; NULL: from ever) until the next one of its
    deployment; a window that starts before the first has the first. Contexts
    of equal time: the greatest by its fields. The last context comes by an
    equi-join on the deployment, one row each; the closed intervals before it
    are cut into days, so a window meets the contexts of its own day alone
    and a busy deployment is spread over its days. With one context a
    deployment the second join has nothing to read.
    """
    since = next((c for c in ("activated_at", "bundle_created_at") if c in lineage.columns), None)
    at = F.coalesce(micros(since), F.lit(FROM_EVER)) if since else F.lit(FROM_EVER)
    marks = lineage.groupBy("deployment_id", at.alias("at")).agg(F.max(F.struct(*CONTEXT_FIELDS)).alias("c"))
    ends = marks.groupBy("deployment_id").agg(F.min_by("c", "at").alias("_first"), F.max_by("c", "at").alias("_last"),
                                              F.max("at").alias("_last_at"))
    until = F.lead("at").over(Window.partitionBy("deployment_id").orderBy("at"))
    day = F.floor(F.col("at") / DAY_US).cast("bigint")
    closed = (marks.withColumn("until", until).where("until IS NOT NULL AND at > " + str(FROM_EVER))
              .select("deployment_id", F.col("at").alias("_at"), F.col("until").alias("_until"), F.col("c").alias("_then"),
                      F.explode(F.sequence(day, F.floor((F.col("until") - 1) / DAY_US).cast("bigint"))).alias("_day")))
    start = micros("window_start")
    w = windows.withColumns({"_start": start, "_day": F.floor(start / DAY_US).cast("bigint")})
    j = w.join(ends, "deployment_id", "left")
    c = closed.select(F.col("deployment_id").alias("_dep"), F.col("_day").alias("_cday"), "_at", "_until", "_then")
    j = j.join(c, (F.col("deployment_id") == F.col("_dep")) & (F.col("_day") == F.col("_cday"))
               & (F.col("_start") >= F.col("_at")) & (F.col("_start") < F.col("_until")), "left")
    j = j.withColumn("_c", F.when(F.col("_start") >= F.col("_last_at"), F.col("_last")).otherwise(F.coalesce("_then", "_first")))
    return j.select(*windows.columns, *[F.col("_c")[f].alias(f) for f in CONTEXT_FIELDS], F.col("_last_at").isNotNull().alias("has_context"))


def withheld_windows(windows: DataFrame, lineage: DataFrame) -> DataFrame:
    """Windows whose deployment has no valid lineage context at all: no record is written for them."""
    return windows.join(lineage.select("deployment_id"), "deployment_id", "left_anti").select(*windows.columns)


def window_records(windows: DataFrame, lineage: DataFrame,
                   heartbeat: Column | None = None) -> DataFrame:
    """Full 43-field window records in contract order.

    ``lineage`` holds the valid contexts of each ``deployment_id``; of
    several, a window has the one valid at its start (``with_context``). A
    window whose deployment has none is not emitted, as the reference writes
    no window without a context: ``withheld_windows`` names those.
    """
    j = with_context(windows, lineage).where("has_context")
    extra = {"schema_version": F.lit(SCHEMA_VERSION)}
    for c in WINDOW_ALWAYS_ZERO:
        extra[c] = F.lit(0).cast(T.LongType())
    for c in WINDOW_OPTIONAL_DOUBLE:
        extra[c] = F.lit(None).cast(T.DoubleType())
    for c in WINDOW_OPTIONAL_LONG:
        extra[c] = F.lit(None).cast(T.LongType())
    extra["heartbeat_emitted_at"] = (heartbeat if heartbeat is not None
                                     else F.current_timestamp().cast("timestamp_ntz"))
    return j.select(*[extra[c].alias(c) if c in extra else F.col(c) for c in WINDOW_FIELDS])
