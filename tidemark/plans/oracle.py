"""DuckDB SQL that states each registered query independently.

The stand-in formulas (see FIXTURES.md) are written once here as CTEs; the
feature SQL joins each point to all its readings once and groups them, so
it shares no plan with the Spark side. Averages and sums are rounded to 6
places on both sides; percentiles are compared as they are.
"""

from __future__ import annotations

from tidemark.schemas import (
    EVENT_NON_BLANK, EVENT_TIME_FIELDS, FEATURE_ORDER, WINDOW_COUNT_FIELDS, WINDOW_ERROR_FIELDS, WINDOW_FIELDS,
    WINDOW_INPUT_FIELDS, WINDOW_NON_BLANK, WINDOW_OPTIONAL_DOUBLE, WINDOW_OPTIONAL_LONG, WINDOW_PREDICTION_FIELDS,
)

R = 6  # decimal places compared for doubles


def metrics_cte(n_stations: int = 8) -> str:
    return f"""
metrics AS (
  SELECT 'station_' || CAST(k AS VARCHAR) AS station_id,
         window_start,
         window_start + INTERVAL 1 MINUTE AS window_end,
         bikes AS avg_bikes_available,
         cap - bikes AS avg_docks_available,
         cap AS avg_capacity,
         bikes / NULLIF(cap, 0.0) AS avg_availability_ratio,
         low AS low_availability_events,
         n AS event_count,
         emitted_at
  FROM (
    SELECT user_id % {n_stations} AS k,
           date_trunc('minute', ts) AS window_start,
           AVG(value) AS bikes,
           CAST(COUNT(*) FILTER (WHERE value < 20) AS BIGINT) AS low,
           CAST(COUNT(*) AS BIGINT) AS n,
           MAX(ts) AS emitted_at,
           CASE WHEN user_id % {n_stations} = 0 THEN 4.0
                WHEN user_id % {n_stations} = 1 THEN 0.0
                ELSE CAST(60 + 10 * (user_id % {n_stations}) AS DOUBLE) END AS cap
    FROM events
    WHERE ts IS NOT NULL AND user_id IS NOT NULL
    GROUP BY 1, 2, 7
  )
)"""


def obs_cte(n_stations: int = 8) -> str:
    return f"""
obs AS (
  SELECT DISTINCT 'station_' || CAST((user_id + event_id) % {n_stations + 1} AS VARCHAR) AS station_id,
         ts + INTERVAL 10 MINUTE AS obs_ts
  FROM events
)"""


LAG_MINUTES = {"15m": 15, "30m": 30, "60m": 60, "24h": 1440}
HOUR_US = 3_600_000_000


def _within(hours: int) -> str:
    return f"FILTER (WHERE age <= {hours * HOUR_US})"


# Every reading at or before a point, in one range join; all look-ups are
# aggregates over a point's readings: the newest by arg_max, the rest by age.
WIDE_CTE = f"""
readings AS (
  SELECT o.station_id, o.obs_ts, m.window_start AS seen_at,
         date_diff('microsecond', m.window_start, o.obs_ts) AS age,
         m.avg_bikes_available AS bikes, m.avg_availability_ratio AS ratio,
         m.low_availability_events AS low, m.event_count AS n,
         struct_pack(bikes := m.avg_bikes_available, docks := m.avg_docks_available,
                     ratio := m.avg_availability_ratio, cap := m.avg_capacity) AS reading
  FROM obs o JOIN metrics m ON m.station_id = o.station_id AND m.window_start <= o.obs_ts
),
per_point AS (
  SELECT station_id, obs_ts, max(seen_at) AS snapshot_source_ts, arg_max(reading, seen_at) AS newest,
    {", ".join(f"arg_max(reading, seen_at) FILTER (WHERE age >= {m * 60_000_000}) AS at_{k}"
               for k, m in LAG_MINUTES.items())},
    {", ".join(f"{fn}(bikes) {_within(h)} AS ft_{fn}_bikes_{k}"
               for k, h in (("60m", 1), ("24h", 24)) for fn in ("avg", "min", "max"))},
    avg(ratio) {_within(1)} AS ft_avg_ratio_60m,
    sum(low) {_within(24)} AS low_sum, sum(n) {_within(24)} AS n_sum
  FROM readings GROUP BY ALL
),
wide AS (
  SELECT obs.station_id, obs.obs_ts, snapshot_source_ts,
    newest.bikes AS ft_bikes_available, newest.docks AS ft_docks_available,
    newest.ratio AS ft_availability_ratio, newest.cap AS ft_capacity,
    {", ".join(f"at_{k}.bikes AS ft_bikes_available_lag_{k}" for k in LAG_MINUTES)},
    ft_avg_bikes_60m, ft_min_bikes_60m, ft_max_bikes_60m, ft_avg_ratio_60m,
    ft_avg_bikes_24h, ft_min_bikes_24h, ft_max_bikes_24h,
    CAST(low_sum AS DOUBLE) / NULLIF(n_sum, 0) AS ft_low_avail_freq_24h,
    CAST(hour(obs.obs_ts) AS INTEGER) AS ft_hour_of_day,
    CAST(isodow(obs.obs_ts) % 7 AS INTEGER) AS ft_day_of_week,
    CAST(isodow(obs.obs_ts) >= 6 AS INTEGER) AS ft_is_weekend,
    newest.bikes / NULLIF(newest.cap, 0) AS ft_pct_bikes_of_capacity,
    newest.docks / NULLIF(newest.cap, 0) AS ft_pct_docks_of_capacity,
    newest.bikes - ft_avg_bikes_60m AS ft_bikes_delta_60m,
    CASE WHEN snapshot_source_ts IS NULL THEN 'not_found'
         WHEN newest.cap < 5.0 THEN 'domain_violation'
         WHEN date_diff('microsecond', snapshot_source_ts, obs.obs_ts) > 900000000 THEN 'stale'
         ELSE 'ok' END AS outcome
  FROM obs LEFT JOIN per_point p ON p.station_id = obs.station_id AND p.obs_ts = obs.obs_ts
)"""


def with_ctes(*ctes: str, n_stations: int = 8) -> str:
    return "WITH " + ",".join([metrics_cte(n_stations), obs_cte(n_stations), *ctes])


def r6(expr: str) -> str:
    """Half-up rounding to 6 places in two steps (see plans.common.round6)."""
    return (f"(CASE WHEN isnan({expr}) OR isinf({expr}) THEN {expr} ELSE "
            f"floor(floor(({expr}) * CAST(1e9 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1000 AS DOUBLE)"
            f" + CAST(0.5 AS DOUBLE)) / CAST(1e6 AS DOUBLE) END)")


def rounded(cols: list[str], doubles: set[str]) -> str:
    return ", ".join(f"{r6(c)} AS {c}" if c in doubles else c for c in cols)


DOUBLE_FEATURES = {n for n in FEATURE_ORDER if n not in ("ft_hour_of_day", "ft_day_of_week", "ft_is_weekend")}


# ------------------------------------------------------------------ oracles
def _feature_query(select: str, where: str = "WHERE snapshot_source_ts IS NOT NULL") -> str:
    return with_ctes(WIDE_CTE) + f" SELECT {select} FROM wide {where}"


def _point_query(features: list[str], where: str = "") -> str:
    return _feature_query("station_id, obs_ts, " + rounded(features, DOUBLE_FEATURES), where)


ORACLES: dict[str, str] = {}

ORACLES["obs_points"] = with_ctes() + " SELECT station_id, obs_ts FROM obs"

ORACLES["asof_snapshot"] = _feature_query("station_id, obs_ts, snapshot_source_ts, " + rounded(
    ["ft_bikes_available", "ft_docks_available", "ft_availability_ratio", "ft_capacity"], DOUBLE_FEATURES))
ORACLES["asof_lags"] = _point_query([f"ft_bikes_available_lag_{k}" for k in LAG_MINUTES])
ORACLES["rolling_60m"] = _point_query(["ft_avg_bikes_60m", "ft_min_bikes_60m", "ft_max_bikes_60m", "ft_avg_ratio_60m"])
ORACLES["rolling_24h"] = _point_query(["ft_avg_bikes_24h", "ft_min_bikes_24h", "ft_max_bikes_24h"])
ORACLES["low_avail_freq_24h"] = _point_query(["ft_low_avail_freq_24h"])
ORACLES["temporal_features"] = _point_query(["ft_hour_of_day", "ft_day_of_week", "ft_is_weekend"])

ORACLES["derived_ratios"] = _feature_query(
    "station_id, obs_ts, " + rounded(["ft_pct_bikes_of_capacity", "ft_pct_docks_of_capacity",
                                      "ft_bikes_delta_60m"], DOUBLE_FEATURES))

ORACLES["pit_features"] = _feature_query(
    "station_id, obs_ts, snapshot_source_ts, " + rounded(FEATURE_ORDER, DOUBLE_FEATURES))

ORACLES["obs_outcome"] = _feature_query("station_id, obs_ts, outcome", "")


# ---------------------------------------------------------------- contracts
ORACLES["vector_in_order"] = _feature_query(
    "station_id, obs_ts, " + ", ".join(
        f"{r6(n) if n not in ('ft_hour_of_day', 'ft_is_weekend') else n} AS f{p + 1:02d}_{n}"
        for p, n in enumerate(["ft_capacity", "ft_hour_of_day", "ft_bikes_available", "ft_avg_bikes_24h",
                               "ft_is_weekend", "ft_bikes_available_lag_15m"])))

_HOUR_TEXT = ("CASE WHEN ft_hour_of_day % 5 = 0 THEN CAST(ft_hour_of_day AS VARCHAR) || '.5' "
              "ELSE CAST(ft_hour_of_day AS VARCHAR) END")
def _int_text(e: str) -> str:
    """Text -> integer as Python's int(): integer text only (DuckDB would round '20.5')."""
    return f"(CASE WHEN regexp_matches(trim({e}), '^[+-]?[0-9]+$') THEN TRY_CAST(trim({e}) AS BIGINT) END)"


_COERCE_COMMON = f"""
  {r6('ft_bikes_available')} AS ft_bikes_available,
  TRY_CAST(trunc(ft_capacity) AS BIGINT) AS ft_capacity,
  TRY_CAST(trunc(ft_bikes_available_lag_24h) AS INTEGER) AS ft_bikes_available_lag_24h,
  {{hour_str}} AS ft_hour_of_day,
  ft_is_weekend <> 0 AS ft_is_weekend,
  {r6('ft_availability_ratio')} AS ft_availability_ratio,
  {_int_text(_HOUR_TEXT)} AS hour_text"""


def _coerce_sql(strict: bool) -> str:
    lag_fail = "ft_bikes_available_lag_24h IS NULL" if strict else "FALSE"
    first = (f"CASE WHEN {lag_fail} THEN 'ft_bikes_available_lag_24h' "
             f"WHEN {_int_text(_HOUR_TEXT)} IS NULL THEN 'hour_text' END")
    body = _COERCE_COMMON.format(hour_str="CAST(ft_hour_of_day AS VARCHAR)")
    return _feature_query(f"station_id, obs_ts, {body}, {first} AS error_feature, "
                          f"CASE WHEN ({first}) IS NULL THEN 'ok' ELSE 'dtype_error' END AS dtype_status")


ORACLES["coerce_strict"] = _coerce_sql(True)
ORACLES["coerce_nullable"] = _coerce_sql(False)

ORACLES["snapshot_lookup"] = with_ctes() + f""",
newest AS (SELECT station_id, MAX(window_start) AS snapshot_ts FROM metrics GROUP BY station_id),
snapshot AS (SELECT n.station_id, n.snapshot_ts, m.avg_bikes_available AS ft_bikes_available
             FROM newest n JOIN metrics m ON m.station_id = n.station_id AND m.window_start = n.snapshot_ts)
SELECT o.station_id, o.obs_ts, s.station_id IS NOT NULL AS found,
       COALESCE(strftime(s.snapshot_ts, '%Y-%m-%d %H:%M:%S'), 'unknown') AS snapshot_ts_text,
       {r6('s.ft_bikes_available')} AS ft_bikes_available
FROM obs o LEFT JOIN snapshot s USING (station_id)"""


# ---------------------------------------------------------------- requests
def _strip(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, '^\\s+', ''), '\\s+$', '')"


ZONE_RE = r"\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?([zZ]|[+-]\d{2}(:?\d{2})?)$"

# The shapes of naive ISO text that the data holds, each with its format; other text is no time.
ISO_SHAPES = [
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[.,]\d{6}", "%Y-%m-%dT%H:%M:%S.%f"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", "%Y-%m-%dT%H:%M:%S"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}", "%Y-%m-%dT%H:%M"),
    (r"\d{8}T\d{6}", "%Y%m%dT%H%M%S"),
    (r"\d{4}-W\d{2}-\d[T ]\d{2}", "%G-W%V-%uT%H"),
    (r"\d{4}-\d{2}-\d{2}", "%Y-%m-%d"),
]
OFFSET_RE = r"(Z|[+-]\d{2}:?\d{2}|[+-]\d{2})$"


def iso_naive(e: str) -> str:
    t = f"replace(replace({e}, ' ', 'T'), ',', '.')"
    arms = " ".join(f"WHEN regexp_full_match({e}, '{shape}') THEN try_strptime({t}, '{fmt}')" for shape, fmt in ISO_SHAPES)
    return f"(CASE {arms} END)"


def requests_cte(n_stations: int = 8) -> str:
    n = n_stations + 1
    o = "(ts + INTERVAL 10 MINUTE)"
    zone = f"(CASE WHEN regexp_matches(ts_text, 'T\\d.*{OFFSET_RE}') THEN regexp_extract(ts_text, '{OFFSET_RE}') ELSE '' END)"
    return f"""
req_raw AS (
  SELECT event_id AS request_id, value / 7 AS elapsed_ms,
    CASE WHEN event_id % 10 = 0 THEN '   '
         ELSE (CASE WHEN event_id % 3 = 0 THEN ' ' ELSE '' END) || 'station_' || CAST((user_id + event_id) % {n} AS VARCHAR)
              || (CASE WHEN event_id % 4 = 0 THEN chr(9) ELSE '' END) END AS entity_id,
    CASE event_id % 17
      WHEN 0 THEN strftime({o}, '%Y-%m-%dT%H:%M:%S.%f')
      WHEN 1 THEN strftime({o}, '%Y-%m-%d %H:%M:%S')
      WHEN 2 THEN strftime({o}, '%Y-%m-%dT%H:%M:%S') || 'Z'
      WHEN 3 THEN strftime({o}, '%Y-%m-%dT%H:%M:%S') || '+00:00'
      WHEN 4 THEN 'not-a-time'
      WHEN 5 THEN strftime({o}, '%Y-%m-%dT%H:%M')
      WHEN 6 THEN strftime({o}, '%Y%m%dT%H%M%S')
      WHEN 7 THEN strftime({o}, '%G-W%V-%uT%H')
      WHEN 8 THEN strftime({o}, '%Y-%m')
      WHEN 9 THEN strftime({o}, '%Y-%m-%dT%H:%M:%S,%f')
      WHEN 10 THEN strftime({o}, '%Y-%m-%dT%H:%M:%S') || ' UTC'
      WHEN 11 THEN strftime({o}, '%Y-%m-%dT%H:%M:%S') || '-0530'
      WHEN 12 THEN strftime({o}, '%Y-%m-%dT%H:%M:%S') || '+02'
      WHEN 13 THEN strftime({o}, '%Y-%m-%d')
      WHEN 14 THEN '2024-1-1T1:2:3'
      WHEN 15 THEN ' ' || strftime({o}, '%Y-%m-%dT%H:%M:%S')
      ELSE strftime({o}, '%Y') END AS ts_text
  FROM events
),
req_parts AS (
  SELECT request_id, elapsed_ms, {_strip('entity_id')} AS station_id, ts_text, {zone} AS zone,
         {iso_naive(f"left(ts_text, length(ts_text) - length({zone}))")} AS wall
  FROM req_raw
),
req AS (
  SELECT request_id, elapsed_ms, station_id, zone <> '' AND wall IS NOT NULL AS zoned,
    wall - COALESCE(TRY_CAST(left(zone, 1) || '1' AS INTEGER), 0)
           * (TRY_CAST(substr(zone, 2, 2) AS INTEGER) * 60
              + COALESCE(TRY_CAST(right(replace(zone, ':', ''), length(replace(zone, ':', '')) - 3) AS INTEGER), 0))
           * INTERVAL 1 MINUTE AS shifted, wall, zone,
    CASE WHEN station_id = '' THEN 'invalid_request' WHEN wall IS NULL THEN 'internal' ELSE 'ok' END AS status
  FROM req_parts
),
req_utc AS (
  SELECT request_id, elapsed_ms, station_id, zoned, status,
         CASE WHEN zone IN ('', 'Z') THEN wall ELSE shifted END AS obs_ts
  FROM req
)"""


ORACLES["request_normalize"] = ("WITH " + requests_cte().strip()
                                + " SELECT request_id, station_id, obs_ts, zoned, status FROM req_utc")

# The look-up and the capacity check come first; only then does a zoned time meet the naive snapshot time and fail.
CODES_CTE = """
obs AS (SELECT DISTINCT station_id, obs_ts FROM req_utc WHERE status = 'ok')""" + "," + WIDE_CTE + """,
codes AS (
  SELECT r.request_id, r.elapsed_ms, r.obs_ts, r.station_id AS entity_id, w.* EXCLUDE (station_id, obs_ts, outcome),
    CASE WHEN r.status <> 'ok' THEN r.status
         WHEN r.zoned AND w.outcome IN ('ok', 'stale') THEN 'internal'
         ELSE w.outcome END AS code
  FROM req_utc r LEFT JOIN wide w ON r.status = 'ok' AND w.station_id = r.station_id AND w.obs_ts = r.obs_ts
),
served AS (
  SELECT *,
  CASE WHEN code = 'ok' THEN 'success'
       WHEN code IN ('domain_violation', 'stale', 'missing_feature', 'dtype_error') THEN 'rejected'
       WHEN code = 'invalid_request' THEN 'invalid' ELSE 'failure' END AS outcome,
  CASE WHEN code = 'not_found' THEN 'feature_lookup'
       WHEN code IN ('ok', 'invalid_request', 'domain_violation', 'stale', 'missing_feature', 'dtype_error') THEN NULL
       ELSE 'internal' END AS error_type,
  CAST(CASE WHEN code = 'ok' THEN 200
       WHEN code IN ('invalid_request', 'domain_violation', 'stale', 'missing_feature', 'dtype_error') THEN 422
       WHEN code = 'not_found' THEN 404 ELSE 500 END AS INTEGER) AS http_status
  FROM codes
)"""

ORACLES["outcome_map"] = "WITH " + ",".join([metrics_cte(), requests_cte(), CODES_CTE]) + """
SELECT request_id, code, outcome, error_type, http_status FROM served"""


# ---------------------------------------------------------------- scoring
def _score_linear() -> str:
    from tidemark.plans.queries import LINEAR
    return _feature_query(f"station_id, obs_ts, {r6(LINEAR.sql())} AS prediction", "WHERE outcome = 'ok'")


# ---------------------------------------------------------------- metrics windows
LOG_CTE = """
log AS (
  SELECT event_id AS request_id, ts AS completed_at, '/predict' AS endpoint_name,
    CAST(user_id % 30 AS VARCHAR) AS deployment_id,
    CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'signup' THEN 'rejected' ELSE 'success' END AS outcome,
    CASE WHEN event_type = 'error' THEN
      CASE event_id % 5 WHEN 0 THEN 'feature_lookup' WHEN 1 THEN 'model_load'
                        WHEN 2 THEN 'inference_runtime' WHEN 3 THEN 'internal' END END AS error_type,
    value AS latency_ms,
    CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN CAST('NaN' AS DOUBLE)
         WHEN event_id % 23 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value / 500.0 END AS prediction,
    date_trunc('minute', ts) AS window_start,
    date_trunc('minute', ts) + INTERVAL 1 MINUTE AS window_end
  FROM events
),
win AS (
  SELECT window_start, window_end, endpoint_name, deployment_id,
    COUNT(*) AS request_count,
    COUNT(*) FILTER (WHERE outcome = 'success') AS success_count,
    COUNT(*) FILTER (WHERE outcome = 'failure') AS failure_count,
    COUNT(*) FILTER (WHERE outcome = 'rejected') AS rejected_count,
    COUNT(*) FILTER (WHERE outcome = 'rejected') AS validation_error_count,
    COUNT(*) FILTER (WHERE outcome = 'failure' AND error_type = 'feature_lookup') AS feature_lookup_error_count,
    COUNT(*) FILTER (WHERE outcome = 'failure' AND error_type = 'model_load') AS model_load_error_count,
    COUNT(*) FILTER (WHERE outcome = 'failure' AND error_type = 'inference_runtime') AS inference_runtime_error_count,
    COUNT(*) FILTER (WHERE outcome = 'failure' AND (error_type IS NULL
                     OR error_type NOT IN ('feature_lookup', 'model_load', 'inference_runtime'))) AS internal_error_count,
    COUNT(*) FILTER (WHERE outcome = 'success') AS prediction_count,
    COUNT(*) FILTER (WHERE outcome = 'success' AND (prediction IS NULL OR isnan(prediction))) AS prediction_null_count,
    COUNT(*) FILTER (WHERE outcome = 'success' AND (isnan(prediction) OR isinf(prediction))) AS prediction_non_finite_count
  FROM log GROUP BY window_start, window_end, endpoint_name, deployment_id
),
ranked AS (
  SELECT window_start, window_end, endpoint_name, deployment_id, latency_ms,
    row_number() OVER (PARTITION BY window_start, endpoint_name, deployment_id ORDER BY latency_ms) AS rn,
    COUNT(*) OVER (PARTITION BY window_start, endpoint_name, deployment_id) AS n
  FROM log WHERE latency_ms IS NOT NULL
),
pct AS (
  SELECT window_start, window_end, endpoint_name, deployment_id,
    MAX(latency_ms) FILTER (WHERE rn = greatest(1, least(n, CAST(ceil(CAST(0.5 AS DOUBLE) * n) AS BIGINT)))) AS latency_p50_ms,
    MAX(latency_ms) FILTER (WHERE rn = greatest(1, least(n, CAST(ceil(CAST(0.95 AS DOUBLE) * n) AS BIGINT)))) AS latency_p95_ms,
    MAX(latency_ms) FILTER (WHERE rn = greatest(1, least(n, CAST(ceil(CAST(0.99 AS DOUBLE) * n) AS BIGINT)))) AS latency_p99_ms
  FROM ranked GROUP BY window_start, window_end, endpoint_name, deployment_id
)"""

_WK = "window_start, window_end, endpoint_name, deployment_id"


def _iso(e: str, suffix_expr: str = "''") -> str:
    return (f"(CASE WHEN strftime({e}, '%f') = '000000' THEN strftime({e}, '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime({e}, '%Y-%m-%dT%H:%M:%S.%f') END || {suffix_expr})")


_USED = ", ".join(f"'{n}'" for n in FEATURE_ORDER)
ORACLES["score_batch"] = with_ctes(WIDE_CTE) + f"""
SELECT station_id AS entity_id, {_iso('obs_ts')} AS "timestamp", 42.0::DOUBLE AS prediction, 'v1' AS model_version,
       [{_USED}] AS features_used
FROM wide WHERE outcome = 'ok'"""



def parse_zoned(e: str, strip: bool = True) -> str:
    """Zoned ISO text -> naive UTC timestamp; NULL when naive or unparsable."""
    t = _strip(e) if strip else e
    off = (f"CASE WHEN upper(right({t}, 1)) = 'Z' THEN 0 ELSE "
           f"(CASE WHEN regexp_extract({t}, '([+-])(\\d{{2}}):?(\\d{{2}})?$', 1) = '-' THEN -1 ELSE 1 END) * "
           f"(CAST(regexp_extract({t}, '([+-])(\\d{{2}}):?(\\d{{2}})?$', 2) AS INTEGER) * 60 + "
           f"COALESCE(TRY_CAST(NULLIF(regexp_extract({t}, '([+-])(\\d{{2}}):?(\\d{{2}})?$', 3), '') AS INTEGER), 0)) END")
    naive = f"TRY_CAST(regexp_replace({t}, '([zZ]|[+-]\\d{{2}}(:?\\d{{2}})?)$', '') AS TIMESTAMP)"
    trimmed = "" if strip else f" AND {e} = {_strip(e)}"  # no whitespace around unstripped text
    return (f"(CASE WHEN regexp_matches({t}, '{ZONE_RE}'){trimmed} THEN {naive} - ({off}) * INTERVAL 1 MINUTE END)")


def _nb(e: str) -> str:
    return f"COALESCE(length({_strip(e)}) > 0, FALSE)"


META_CTE = f"""
meta AS (
  SELECT '/srv/bundles/models/model_' || CAST(o_custkey % 5 AS VARCHAR) || '/v' || CAST(o_orderkey AS VARCHAR) || '/model.pkl' AS model_path,
    CAST(o_orderkey AS VARCHAR) AS deployment_id,
    'v' || CAST(o_orderkey AS VARCHAR) AS model_version,
    {_iso('o_orderdate - INTERVAL 2 HOUR', "CASE WHEN o_orderkey % 2 = 0 THEN 'Z' ELSE '+00:00' END")} AS trained_at,
    CASE WHEN o_orderkey % 29 = 0 AND o_orderkey >= 5 THEN '   ' ELSE ' orders_' || o_orderstatus || ' ' END AS input_dataset_name,
    'ds-' || CAST(year(o_orderdate) AS VARCHAR) AS input_dataset_version,
    {_iso("CASE WHEN o_orderkey % 13 = 0 AND o_orderkey >= 5 THEN o_orderdate + INTERVAL 1 HOUR ELSE o_orderdate - INTERVAL 1 HOUR END",
          "CASE WHEN o_orderkey % 2 = 0 THEN 'Z' ELSE '+00:00' END")} AS started_at,
    {_iso('o_orderdate', "CASE WHEN o_orderkey % 2 = 0 THEN 'Z' ELSE '+00:00' END")} AS completed_at
  FROM orders
),
ctx0 AS (
  SELECT 'station-serving' AS service_name, '0.1.0' AS service_version, 'production' AS environment,
    deployment_id, CAST(NULL AS VARCHAR) AS instance_id,
    split_part(regexp_replace(model_path, '/[^/]*$', ''), '/', -2) AS model_name,
    model_version,
    regexp_replace(model_path, '/[^/]*$', '') AS bundle_id,
    'file://' || regexp_replace(model_path, '/[^/]*$', '') AS bundle_uri,
    {parse_zoned('trained_at', strip=False)} AS bundle_created_at,
    CASE WHEN {_nb('input_dataset_name')} THEN {_strip('input_dataset_name')} END AS input_dataset_name,
    CASE WHEN {_nb('input_dataset_version')} THEN {_strip('input_dataset_version')} END AS input_dataset_version,
    {parse_zoned('started_at', strip=False)} AS started_at,
    {parse_zoned('completed_at', strip=False)} AS completed_at
  FROM meta
),
ctx AS (
  SELECT *, reasons = '' AS valid FROM (
    SELECT *, concat_ws(',',
      CASE WHEN NOT {_nb('model_version')} THEN 'model_version_missing' END,
      CASE WHEN bundle_created_at IS NULL THEN 'bundle_created_at_invalid' END,
      CASE WHEN started_at IS NULL THEN 'started_at_invalid' END,
      CASE WHEN completed_at IS NULL THEN 'completed_at_invalid' END,
      CASE WHEN NOT {_nb('input_dataset_name')} THEN 'input_dataset_name_blank' END,
      CASE WHEN NOT {_nb('input_dataset_version')} THEN 'input_dataset_version_blank' END,
      CASE WHEN NOT {_nb('service_name')} THEN 'service_name_blank' END,
      CASE WHEN NOT {_nb('service_version')} THEN 'service_version_blank' END,
      CASE WHEN NOT {_nb('environment')} THEN 'environment_blank' END,
      CASE WHEN NOT {_nb('deployment_id')} THEN 'deployment_id_blank' END,
      CASE WHEN NOT {_nb('model_name')} THEN 'model_name_blank' END,
      CASE WHEN NOT {_nb('bundle_id')} THEN 'bundle_id_blank' END,
      CASE WHEN NOT {_nb('bundle_uri')} THEN 'bundle_uri_blank' END,
      CASE WHEN completed_at < started_at THEN 'chronology' END) AS reasons
    FROM ctx0)
),
act AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS deployment_id, o_orderdate AS event_time,
         o_orderpriority AS activation_reason, o_orderstatus AS traffic_status FROM orders
),
events_all AS (
  SELECT 'serving_deployment_activated' AS event_type, a.event_time, c.service_name, c.service_version,
    c.environment, a.deployment_id, c.instance_id, c.model_name, c.model_version, c.bundle_id, c.bundle_uri,
    c.bundle_created_at, c.input_dataset_name, c.input_dataset_version, c.started_at, c.completed_at,
    a.activation_reason, a.traffic_status, 'v1' AS schema_version, c.valid
  FROM act a JOIN ctx c USING (deployment_id)
)"""

_REC_LINEAGE = ("c.service_name, c.service_version, c.environment, c.model_name, c.model_version, "
                "c.bundle_id, c.input_dataset_name, c.input_dataset_version")
RECORDS_CTE = f"""
records AS (
  SELECT 'v1' AS schema_version, w.window_start, w.window_end, {_REC_LINEAGE}, w.deployment_id, w.endpoint_name,
    w.request_count, w.success_count, w.failure_count, w.rejected_count, CAST(0 AS BIGINT) AS timeout_count,
    COALESCE(p.latency_p50_ms, 0.0) AS latency_p50_ms, COALESCE(p.latency_p95_ms, 0.0) AS latency_p95_ms,
    COALESCE(p.latency_p99_ms, 0.0) AS latency_p99_ms,
    CAST(NULL AS DOUBLE) AS feature_lookup_p95_ms, CAST(NULL AS DOUBLE) AS model_exec_p95_ms,
    w.validation_error_count, w.feature_lookup_error_count, w.model_load_error_count,
    w.inference_runtime_error_count, CAST(0 AS BIGINT) AS dependency_error_count, w.internal_error_count,
    CAST(0 AS BIGINT) AS input_schema_failure_count, CAST(0 AS BIGINT) AS missing_required_field_count,
    CAST(0 AS BIGINT) AS invalid_type_count, CAST(0 AS BIGINT) AS domain_violation_count,
    w.prediction_count, w.prediction_null_count, w.prediction_non_finite_count,
    CAST(0 AS BIGINT) AS prediction_out_of_range_count, CAST(0 AS BIGINT) AS fallback_prediction_count,
    CAST(NULL AS BIGINT) AS missing_feature_count, CAST(NULL AS BIGINT) AS default_imputed_feature_count,
    CAST(NULL AS BIGINT) AS stale_feature_count, CAST(NULL AS BIGINT) AS feature_vector_build_failure_count
  FROM win w LEFT JOIN pct p USING ({_WK}) JOIN ctx c ON c.deployment_id = w.deployment_id AND c.valid
)"""

_OBS_WITH = "WITH " + ",".join([LOG_CTE.strip(), META_CTE])

ORACLES["metrics_window_counts"] = _OBS_WITH + f" SELECT {_WK}, request_count, success_count, failure_count, rejected_count FROM win"
ORACLES["metrics_window_errors"] = _OBS_WITH + f""" SELECT {_WK}, validation_error_count, feature_lookup_error_count,
  model_load_error_count, inference_runtime_error_count, internal_error_count FROM win"""
ORACLES["prediction_quality"] = _OBS_WITH + f""" SELECT {_WK}, prediction_count, prediction_null_count,
  prediction_non_finite_count FROM win"""
ORACLES["latency_percentiles"] = _OBS_WITH + f""" SELECT {_WK},
  COALESCE(latency_p50_ms, 0.0) AS latency_p50_ms, COALESCE(latency_p95_ms, 0.0) AS latency_p95_ms,
  COALESCE(latency_p99_ms, 0.0) AS latency_p99_ms FROM win LEFT JOIN pct USING ({_WK})"""

def _window_fields() -> list[str]:
    return [c for c in WINDOW_FIELDS if c != "heartbeat_emitted_at"]


ORACLES["metrics_window"] = _OBS_WITH + "," + RECORDS_CTE + f" SELECT {', '.join(_window_fields())} FROM records"
ORACLES["metrics_window_lineage"] = _OBS_WITH + "," + RECORDS_CTE + """ SELECT window_start, endpoint_name, deployment_id,
  service_name, model_name, model_version, bundle_id, input_dataset_name, input_dataset_version FROM records"""
ORACLES["sink_metrics_layout"] = _OBS_WITH + "," + RECORDS_CTE + """ SELECT window_start, deployment_id,
  strftime(window_start, '%Y-%m-%d') AS date, strftime(window_start, '%H') AS hour, strftime(window_start, '%M') AS minute
  FROM records"""


_REQUIRED = WINDOW_COUNT_FIELDS + WINDOW_ERROR_FIELDS + WINDOW_INPUT_FIELDS + WINDOW_PREDICTION_FIELDS
_LATENCIES = ["latency_p50_ms", "latency_p95_ms", "latency_p99_ms"]
_OPTIONAL = WINDOW_OPTIONAL_DOUBLE + WINDOW_OPTIONAL_LONG
_BAD_WINDOW = ([(c, "'  '") for c in WINDOW_NON_BLANK] + [("window_end", "window_start")]
               + [(c, "-1") for c in _REQUIRED + _LATENCIES + _OPTIONAL]
               + [("schema_version", "'v0'"), ("heartbeat_emitted_at", "NULL"), ("window_end", "NULL")])
_RULES_WINDOW = ([f"CASE WHEN trim({c}) = '' OR {c} IS NULL THEN '{c}_blank' END" for c in WINDOW_NON_BLANK]
                 + [f"CASE WHEN {c} IS NULL THEN '{c}_invalid' END" for c in ("window_start", "window_end", "heartbeat_emitted_at")]
                 + ["CASE WHEN NOT window_start < window_end THEN 'window_order' END"]
                 + [f"CASE WHEN {c} IS NULL OR {c} < 0 THEN '{c}_negative' END" for c in _REQUIRED + _LATENCIES]
                 + [f"CASE WHEN {c} < 0 THEN '{c}_negative' END" for c in _OPTIONAL]
                 + ["CASE WHEN schema_version <> 'v1' THEN 'schema_version' END"])


def _validate_windows() -> str:
    # window_end is broken in two ways, so its arms are put together first
    size, arms = len(_BAD_WINDOW) + 1, {}
    for n, (c, bad) in enumerate(_BAD_WINDOW, 1):
        arms[c] = arms.get(c, "") + f" WHEN minute_no % {size} = {n} THEN {bad}"
    changed = ", ".join(f"CASE{a} ELSE {c} END AS {c}" for c, a in arms.items())
    return _OBS_WITH + "," + RECORDS_CTE + f""",
numbered AS (SELECT *, epoch_us(window_start) // 60000000 AS minute_no, window_start AS heartbeat_emitted_at,
                    deployment_id AS deployment, endpoint_name AS endpoint FROM records),
broken AS (SELECT * REPLACE ({changed}) FROM numbered),
checked AS (SELECT window_start, deployment, endpoint, concat_ws(',', {", ".join(_RULES_WINDOW)}) AS reasons FROM broken)
SELECT window_start, endpoint, deployment, reasons = '' AS valid, reasons FROM checked"""


ORACLES["validate_windows"] = _validate_windows()

_CTX_COLS = ("service_name, service_version, environment, deployment_id, instance_id, model_name, model_version, "
             "bundle_id, bundle_uri, bundle_created_at, input_dataset_name, input_dataset_version, started_at, "
             "completed_at, valid, reasons")
ORACLES["bundle_lineage"] = _OBS_WITH + f" SELECT {_CTX_COLS} FROM ctx"
ORACLES["deployment_events"] = _OBS_WITH + """ SELECT event_type, event_time, service_name, service_version, environment,
  deployment_id, instance_id, model_name, model_version, bundle_id, bundle_uri, bundle_created_at, input_dataset_name,
  input_dataset_version, started_at, completed_at, activation_reason, traffic_status, schema_version
  FROM events_all WHERE valid"""
_BAD_EVENT = ([(c, "' '") for c in EVENT_NON_BLANK] + [(c, "NULL") for c in EVENT_TIME_FIELDS]
              + [("event_type", "'other'"), ("schema_version", "'v0'")])


def _validate_events() -> str:
    size = len(_BAD_EVENT) + 1
    changed = ", ".join(f"CASE WHEN order_no % {size} = {n} THEN {bad} ELSE {c} END AS {c}"
                        for n, (c, bad) in enumerate(_BAD_EVENT, 1))
    rules = ([f"CASE WHEN trim({c}) = '' OR {c} IS NULL THEN '{c}_blank' END" for c in EVENT_NON_BLANK]
             + [f"CASE WHEN {c} IS NULL THEN '{c}_invalid' END" for c in EVENT_TIME_FIELDS]
             + ["CASE WHEN completed_at < started_at THEN 'chronology' END",
                "CASE WHEN event_type <> 'serving_deployment_activated' THEN 'event_type' END",
                "CASE WHEN schema_version <> 'v1' THEN 'schema_version' END"])
    return _OBS_WITH + f""",
numbered AS (SELECT *, CAST(deployment_id AS BIGINT) AS order_no FROM events_all),
broken AS (SELECT * REPLACE ({changed}) FROM numbered),
checked AS (SELECT order_no, concat_ws(',', {", ".join(rules)}) AS reasons FROM broken)
SELECT order_no, reasons = '' AS valid, reasons FROM checked"""


ORACLES["validate_events"] = _validate_events()
ORACLES["sink_events_layout"] = _OBS_WITH + """ SELECT deployment_id, event_time, strftime(event_time, '%Y-%m-%d') AS date
  FROM events_all WHERE valid"""

ORACLES["normalize_utc"] = f"""
WITH z AS (
  SELECT o_orderkey, strftime(o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') AS base,
         o_orderkey % 5 AS shape FROM orders
), t AS (
  SELECT o_orderkey, CASE shape WHEN 0 THEN base || 'Z' WHEN 1 THEN base || '+00:00' WHEN 2 THEN base || '+02:00'
                                WHEN 3 THEN base || '-05:30' ELSE base END AS ts_text FROM z
)
SELECT o_orderkey, ts_text, {parse_zoned('ts_text')} AS utc_ts, {parse_zoned('ts_text')} IS NOT NULL AS valid FROM t"""


ORACLES["score_linear"] = _score_linear()


def _predict_requests() -> str:
    from tidemark.plans.queries import LINEAR
    ok = "code = 'ok'"
    return "WITH " + ",".join([metrics_cte(), requests_cte(), CODES_CTE]) + f"""
SELECT request_id, entity_id, {_iso('obs_ts')} AS "timestamp", code, outcome, error_type, http_status,
  CASE WHEN {ok} THEN {r6(LINEAR.sql())} END AS prediction, 'v1' AS model_version,
  CASE WHEN {ok} THEN floor(elapsed_ms * 1000 + 0.5) / 1000 END AS latency_ms
FROM served"""


ORACLES["predict_requests"] = _predict_requests()

ORACLES["log_rejects"] = """
SELECT * FROM (
  SELECT event_id AS request_id,
         CASE WHEN event_id % 31 <> 0 AND event_id % 37 <> 0 AND event_id % 41 = 0 THEN 'invalid_request'
              WHEN event_id % 31 = 0 OR event_id % 37 = 0 THEN 'unknown_outcome'
              WHEN event_id % 43 = 0 OR ts IS NULL THEN 'no_time' END AS reason
  FROM events)
WHERE reason IS NOT NULL"""

ORACLES["metrics_window_contexts"] = _OBS_WITH + f""",
marks AS (
  SELECT CAST(o.o_orderkey % 30 AS VARCHAR) AS deployment_id, TIMESTAMP '2024-01-01' + to_minutes(o.o_orderkey % 10007) AS since,
         c.model_version, c.bundle_id
  FROM orders o JOIN ctx c ON c.deployment_id = CAST(o.o_orderkey AS VARCHAR) WHERE c.valid),
firsts AS (SELECT deployment_id, min(since) AS since FROM marks GROUP BY 1),
placed AS (
  SELECT w.*, greatest(w.window_start, f.since) AS seen FROM win w JOIN firsts f USING (deployment_id))
SELECT p.window_start, p.endpoint_name, p.deployment_id, m.model_version, m.bundle_id, p.request_count,
       COALESCE(q.latency_p95_ms, 0.0) AS latency_p95_ms
FROM placed p ASOF JOIN marks m ON m.deployment_id = p.deployment_id AND m.since <= p.seen
LEFT JOIN pct q ON q.window_start = p.window_start AND q.endpoint_name = p.endpoint_name AND q.deployment_id = p.deployment_id"""

ORACLES["raw_metrics_stored"] = "WITH " + metrics_cte().strip() + """ SELECT station_id, window_start, window_end, """ + ", ".join(
    f"{r6(c)} AS {c}" for c in ("avg_bikes_available", "avg_docks_available", "avg_capacity", "avg_availability_ratio")) + """,
  low_availability_events, event_count, emitted_at FROM metrics"""
ORACLES["pit_from_store"] = ORACLES["pit_features"]
ORACLES["snapshot_stored"] = ORACLES["snapshot_lookup"]

_ROLLOUT = "(TIMESTAMP '2024-01-01' + to_minutes(CAST(deployment_id AS BIGINT) % 10007))"
ORACLES["sink_events_records"] = _OBS_WITH + f""" SELECT {_iso(_ROLLOUT, "'Z'")} AS event_time, deployment_id, CAST(NULL AS VARCHAR) AS instance_id,
  bundle_uri, {_iso('bundle_created_at', "'Z'")} AS bundle_created_at, {_iso('started_at', "'Z'")} AS started_at,
  {_iso('completed_at', "'Z'")} AS completed_at, schema_version, CAST(19 AS INTEGER) AS n_fields, strftime({_ROLLOUT}, '%Y-%m-%d') AS date
  FROM events_all WHERE valid"""

ORACLES["metrics_ledger"] = _OBS_WITH + "," + RECORDS_CTE + f""" SELECT {_iso('window_start', "'Z'")} AS window_start, deployment_id, model_version,
  request_count, success_count, failure_count, rejected_count, validation_error_count, feature_lookup_error_count, model_load_error_count,
  inference_runtime_error_count, internal_error_count, prediction_count, prediction_null_count, prediction_non_finite_count,
  latency_p50_ms, latency_p95_ms, latency_p99_ms FROM records"""
