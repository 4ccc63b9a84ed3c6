"""Derivations of the reference's inputs from the shared test tables.

Each function is a plain DataFrame transformation of a given table, so its
work grows with the table. The formulas are fixed: the DuckDB oracle in
``tidemark.plans.oracle`` states the same ones in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import iso_text
from tidemark.schemas import ENDPOINT


def _station(expr: Column) -> Column:
    return F.concat(F.lit("station_"), expr.cast("string"))


def station_metrics(events: DataFrame, n_stations: int = 8) -> DataFrame:
    """1-minute station metrics: events grouped by (user_id % n, minute of ts)."""
    k = F.pmod(F.col("user_id"), F.lit(n_stations))
    g = (events
         .where(F.col("ts").isNotNull() & F.col("user_id").isNotNull())
         .groupBy(k.alias("_k"), F.window("ts", "1 minute").start.alias("window_start"))
         .agg(F.avg("value").alias("avg_bikes_available"),
              F.count_if(F.col("value") < 20).alias("low_availability_events"),
              F.count(F.lit(1)).alias("event_count"),
              F.max("ts").alias("emitted_at")))
    capacity = (F.when(F.col("_k") == 0, F.lit(4.0))
                .when(F.col("_k") == 1, F.lit(0.0))
                .otherwise((F.lit(60) + F.lit(10) * F.col("_k")).cast("double")))
    return (g.withColumn("avg_capacity", capacity)
            .select(_station(F.col("_k")).alias("station_id"),
                    "window_start",
                    (F.col("window_start") + F.expr("INTERVAL 1 MINUTE")).alias("window_end"),
                    "avg_bikes_available",
                    (F.col("avg_capacity") - F.col("avg_bikes_available")).alias("avg_docks_available"),
                    "avg_capacity",
                    (F.col("avg_bikes_available") / F.nullif(F.col("avg_capacity"), F.lit(0.0)))
                    .alias("avg_availability_ratio"),
                    "low_availability_events", "event_count", "emitted_at"))


def observation_points(events: DataFrame, n_stations: int = 8) -> DataFrame:
    """Distinct (station_id, obs_ts) of all events; one more station than the
    metrics have, so the last station is never found."""
    n_obs = n_stations + 1
    return (events
            .select(_station(F.pmod(F.col("user_id") + F.col("event_id"), F.lit(n_obs))).alias("station_id"),
                    (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("obs_ts"))
            .distinct())


def request_text(events: DataFrame, n_stations: int = 8) -> DataFrame:
    """Raw prediction requests as text: padded or blank ids, times in many
    shapes (basic and extended, week dates, zones, and text that is no time),
    and the milliseconds each took."""
    n_obs = n_stations + 1
    eid = F.col("event_id")
    obs_ts = F.col("ts") + F.expr("INTERVAL 10 MINUTES")
    station = F.concat(F.lit("station_"), F.pmod(F.col("user_id") + eid, F.lit(n_obs)).cast("string"))
    entity = (F.when(F.pmod(eid, F.lit(10)) == 0, F.lit("   "))
              .otherwise(F.concat(F.when(F.pmod(eid, F.lit(3)) == 0, F.lit(" ")).otherwise(F.lit("")),
                                  station,
                                  F.when(F.pmod(eid, F.lit(4)) == 0, F.lit("\t")).otherwise(F.lit("")))))

    def text(pattern: str) -> Column:
        return F.date_format(obs_ts, pattern)

    second = text("yyyy-MM-dd'T'HH:mm:ss")
    jan4_year = F.extract(F.lit("YEAROFWEEK"), obs_ts).cast("string")
    week = F.concat(jan4_year, F.lit("-W"), F.lpad(F.weekofyear(obs_ts).cast("string"), 2, "0"),
                    F.lit("-"), (F.weekday(obs_ts) + 1).cast("string"), text("'T'HH"))
    shapes = [text("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), text("yyyy-MM-dd HH:mm:ss"), F.concat(second, F.lit("Z")),
              F.concat(second, F.lit("+00:00")), F.lit("not-a-time"), text("yyyy-MM-dd'T'HH:mm"),
              text("yyyyMMdd'T'HHmmss"), week, text("yyyy-MM"), text("yyyy-MM-dd'T'HH:mm:ss,SSSSSS"),
              F.concat(second, F.lit(" UTC")), F.concat(second, F.lit("-0530")), F.concat(second, F.lit("+02")),
              text("yyyy-MM-dd"), F.lit("2024-1-1T1:2:3"), F.concat(F.lit(" "), second), text("yyyy")]
    ts_text = F.lit(None).cast("string")
    for n, shape in enumerate(shapes):
        ts_text = F.when(F.pmod(eid, F.lit(len(shapes))) == n, shape).otherwise(ts_text)
    return events.select(eid.alias("request_id"), entity.alias("entity_id"), ts_text.alias("timestamp"),
                         (F.col("value") / 7).alias("elapsed_ms"))


def request_log(events: DataFrame, n_deployments: int = 30) -> DataFrame:
    """Request outcomes: completion time, latency, outcome, error type, prediction."""
    eid = F.col("event_id")
    outcome = (F.when(F.col("event_type") == "error", F.lit("failure"))
               .when(F.col("event_type") == "signup", F.lit("rejected"))
               .otherwise(F.lit("success")))
    err = F.pmod(eid, F.lit(5))
    error_type = F.when(outcome == "failure",
                        F.when(err == 0, F.lit("feature_lookup"))
                        .when(err == 1, F.lit("model_load"))
                        .when(err == 2, F.lit("inference_runtime"))
                        .when(err == 3, F.lit("internal")))
    prediction = (F.when(F.pmod(eid, F.lit(17)) == 0, F.lit(None).cast("double"))
                  .when(F.pmod(eid, F.lit(19)) == 0, F.lit(float("nan")))
                  .when(F.pmod(eid, F.lit(23)) == 0, F.lit(float("inf")))
                  .otherwise(F.col("value") / 500.0))
    return events.select(
        eid.alias("request_id"),
        F.col("ts").alias("completed_at"),
        F.lit(ENDPOINT).alias("endpoint_name"),
        F.pmod(F.col("user_id"), F.lit(n_deployments)).cast("string").alias("deployment_id"),
        outcome.alias("outcome"),
        error_type.alias("error_type"),
        F.col("value").alias("latency_ms"),
        prediction.alias("prediction"),
    )


def noisy_log(events: DataFrame) -> DataFrame:
    """The request log with rows that belong in no window: outcomes unknown, absent or refused beforehand, and no time."""
    eid = F.col("request_id")
    outcome = (F.when(F.pmod(eid, F.lit(31)) == 0, F.lit("timeout")).when(F.pmod(eid, F.lit(37)) == 0, F.lit(None).cast("string"))
               .when(F.pmod(eid, F.lit(41)) == 0, F.lit("invalid")).otherwise(F.col("outcome")))
    return request_log(events).withColumns({"outcome": outcome, "completed_at": F.when(F.pmod(eid, F.lit(43)) != 0, F.col("completed_at"))})


def redeployments(orders: DataFrame, n_deployments: int = 30) -> DataFrame:
    """Activations that put bundle after bundle on the deployments of the request log, in its week: one per order."""
    key = F.col("o_orderkey")
    minutes = F.pmod(key, F.lit(10_007)).cast("int")
    return orders.select(key.cast("string").alias("deployment_id"), F.pmod(key, F.lit(n_deployments)).cast("string").alias("onto"),
                         (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)).alias("event_time"),
                         F.lit("rollout").alias("activation_reason"), F.lit("serving").alias("traffic_status"))


def bundle_metadata(orders: DataFrame, n_valid_keys: int = 5) -> DataFrame:
    """One model_metadata record per order, as the JSON reader would give it
    (all text), plus the path of the bundle's model file.

    Broken on purpose: start after completion when o_orderkey % 13 = 0,
    blank dataset name when o_orderkey % 29 = 0 -- except for the first
    ``n_valid_keys`` keys, which the request log joins to.
    """
    key = F.col("o_orderkey")
    protected = key < n_valid_keys
    done = F.col("o_orderdate")
    suffix = F.when(F.pmod(key, F.lit(2)) == 0, F.lit("Z")).otherwise(F.lit("+00:00"))
    bad_chrono = (F.pmod(key, F.lit(13)) == 0) & ~protected
    blank_name = (F.pmod(key, F.lit(29)) == 0) & ~protected
    started = F.when(bad_chrono, done + F.expr("INTERVAL 1 HOUR")).otherwise(done - F.expr("INTERVAL 1 HOUR"))
    trained = done - F.expr("INTERVAL 2 HOURS")
    model = F.concat(F.lit("model_"), F.pmod(F.col("o_custkey"), F.lit(5)).cast("string"))
    return orders.select(
        F.concat(F.lit("/srv/bundles/models/"), model, F.lit("/v"), key.cast("string"),
                 F.lit("/model.pkl")).alias("model_path"),
        key.cast("string").alias("deployment_id"),
        F.concat(F.lit("v"), key.cast("string")).alias("model_version"),
        F.concat(iso_text(trained), suffix).alias("trained_at"),
        F.lit("target_empty_next_hour").alias("target"),
        F.when(blank_name, F.lit("   "))
         .otherwise(F.concat(F.lit(" orders_"), F.col("o_orderstatus"), F.lit(" "))).alias("input_dataset_name"),
        F.concat(F.lit("ds-"), F.year(done).cast("string")).alias("input_dataset_version"),
        F.concat(iso_text(started), suffix).alias("started_at"),
        F.concat(iso_text(done), suffix).alias("completed_at"),
    )


def activations(orders: DataFrame) -> DataFrame:
    """Deployment activations: when, why and with which traffic state."""
    return orders.select(
        F.col("o_orderkey").cast("string").alias("deployment_id"),
        F.col("o_orderdate").alias("event_time"),
        F.col("o_orderpriority").alias("activation_reason"),
        F.col("o_orderstatus").alias("traffic_status"),
    )


def zoned_text(orders: DataFrame) -> DataFrame:
    """Timestamps as text with mixed zone notations, for UTC normalisation."""
    key = F.col("o_orderkey")
    base = F.date_format(F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.pmod(key, F.lit(24)).cast("int")),
                         "yyyy-MM-dd'T'HH:mm:ss")
    shape = F.pmod(key, F.lit(5))
    text = (F.when(shape == 0, F.concat(base, F.lit("Z")))
            .when(shape == 1, F.concat(base, F.lit("+00:00")))
            .when(shape == 2, F.concat(base, F.lit("+02:00")))
            .when(shape == 3, F.concat(base, F.lit("-05:30")))
            .otherwise(base))
    return orders.select(key.alias("o_orderkey"), text.alias("ts_text"))
