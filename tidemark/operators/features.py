"""Point-in-time feature reconstruction for a table of observation points.

``reconstruct(obs, metrics)`` gives, for every ``(station_id, obs_ts)``:
the as-of snapshot (newest metrics row with ``window_start <= obs_ts``),
four as-of lags, 60-minute and 24-hour trailing aggregates, calendar
features and ratios -- the 22 contract features -- plus the ordered
outcome code of the serving checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import day_of_week_sun0, micros
from tidemark.operators.pit import AsOf, Rolling, point_in_time
from tidemark.schemas import (
    FEATURE_ORDER, LAGS, MAX_SNAPSHOT_STALENESS_MIN, MIN_CAPACITY, MINUTE_US,
    OUTCOME_DOMAIN, OUTCOME_NOT_FOUND, OUTCOME_OK, OUTCOME_STALE,
    ROLLING_24H_US, ROLLING_60M_US,
)

SNAPSHOT_COLUMNS = ("window_start", "avg_bikes_available", "avg_docks_available",
                    "avg_availability_ratio", "avg_capacity")

_ROLLING = [
    Rolling("ft_avg_bikes_60m", "avg", "avg_bikes_available", ROLLING_60M_US),
    Rolling("ft_min_bikes_60m", "min", "avg_bikes_available", ROLLING_60M_US),
    Rolling("ft_max_bikes_60m", "max", "avg_bikes_available", ROLLING_60M_US),
    Rolling("ft_avg_ratio_60m", "avg", "avg_availability_ratio", ROLLING_60M_US),
    Rolling("ft_avg_bikes_24h", "avg", "avg_bikes_available", ROLLING_24H_US),
    Rolling("ft_min_bikes_24h", "min", "avg_bikes_available", ROLLING_24H_US),
    Rolling("ft_max_bikes_24h", "max", "avg_bikes_available", ROLLING_24H_US),
    Rolling("_low_24h", "sum", "low_availability_events", ROLLING_24H_US),
    Rolling("_events_24h", "sum", "event_count", ROLLING_24H_US),
]


def point_in_time_parts(obs: DataFrame, metrics: DataFrame, *, key: str = "station_id",
                        obs_time: str = "obs_ts", as_of_column: str = "window_start",
                        snapshot: bool = True, lags: bool = True, rolling: bool = True,
                        rows_per_slice: int = 1_000_000, carried: DataFrame | None = None) -> DataFrame:
    """The raw look-ups behind the features; each group can be switched off."""
    asof = []
    if snapshot:
        asof.append(AsOf("_snap", SNAPSHOT_COLUMNS, 0))
    if lags:
        asof += [AsOf(f"_lag_{name}", ("avg_bikes_available",), us) for name, us in LAGS.items()]
    need = [key, as_of_column, "emitted_at", *SNAPSHOT_COLUMNS,
            "low_availability_events", "event_count"]
    m = metrics.select(*dict.fromkeys(need))
    return point_in_time(obs, m, key=key, left_time=obs_time, right_time=as_of_column,
                         asof=asof, rolling=_ROLLING if rolling else [],
                         tiebreak=("emitted_at",), rows_per_slice=rows_per_slice,
                         carried=None if carried is None else carried.select(*dict.fromkeys(need)))


def snapshot_columns(parts: DataFrame) -> list:
    s = F.col("_snap")
    return [
        s["window_start"].alias("snapshot_source_ts"),
        s["avg_bikes_available"].alias("ft_bikes_available"),
        s["avg_docks_available"].alias("ft_docks_available"),
        s["avg_availability_ratio"].alias("ft_availability_ratio"),
        s["avg_capacity"].alias("ft_capacity"),
    ]


def lag_columns() -> list:
    return [F.col(f"_lag_{name}")["avg_bikes_available"].alias(f"ft_bikes_available_lag_{name}")
            for name in LAGS]


def rolling_columns() -> list:
    return [F.col(r.name) for r in _ROLLING if not r.name.startswith("_")] + [
        (F.col("_low_24h").cast("double") / F.nullif(F.col("_events_24h"), F.lit(0)))
        .alias("ft_low_avail_freq_24h")]


def temporal_columns(obs_time: str = "obs_ts") -> list:
    dow = day_of_week_sun0(obs_time)
    return [F.hour(obs_time).cast("int").alias("ft_hour_of_day"),
            dow.alias("ft_day_of_week"),
            F.when(dow.isin(0, 6), 1).otherwise(0).cast("int").alias("ft_is_weekend")]


def derived_columns() -> list:
    cap = F.nullif(F.col("ft_capacity"), F.lit(0.0))
    return [(F.col("ft_bikes_available") / cap).alias("ft_pct_bikes_of_capacity"),
            (F.col("ft_docks_available") / cap).alias("ft_pct_docks_of_capacity"),
            (F.col("ft_bikes_available") - F.col("ft_avg_bikes_60m")).alias("ft_bikes_delta_60m")]


def outcome_column(obs_time: str = "obs_ts") -> F.Column:
    """Ordered checks: not found -> domain -> stale -> ok (one code per row)."""
    stale_us = MAX_SNAPSHOT_STALENESS_MIN * MINUTE_US
    return (F.when(F.col("snapshot_source_ts").isNull(), F.lit(OUTCOME_NOT_FOUND))
            .when(F.col("ft_capacity") < F.lit(MIN_CAPACITY), F.lit(OUTCOME_DOMAIN))
            .when(micros(obs_time) - micros("snapshot_source_ts") > F.lit(stale_us), F.lit(OUTCOME_STALE))
            .otherwise(F.lit(OUTCOME_OK)))


def reconstruct(obs: DataFrame, metrics: DataFrame, *, key: str = "station_id",
                obs_time: str = "obs_ts", as_of_column: str = "window_start",
                rows_per_slice: int = 1_000_000, carried: DataFrame | None = None) -> DataFrame:
    """All obs rows: obs columns, ``snapshot_source_ts``, the 22 features in
    contract order and ``outcome``. A station with no metrics row at or
    before ``obs_ts`` has NULL features and outcome ``not_found``.
    ``carried``: the newest row of each station and day, when ``metrics``
    holds only the days around the observations (``sources.readings``)."""
    parts = point_in_time_parts(obs, metrics, key=key, obs_time=obs_time,
                                as_of_column=as_of_column, rows_per_slice=rows_per_slice, carried=carried)
    base = parts.select(*[F.col(c) for c in obs.columns], *snapshot_columns(parts),
                        *lag_columns(), *rolling_columns(), *temporal_columns(obs_time))
    full = base.select("*", *derived_columns())
    full = full.select(*obs.columns, "snapshot_source_ts", *FEATURE_ORDER)
    return full.withColumn("outcome", outcome_column(obs_time))
