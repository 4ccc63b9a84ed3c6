"""Rule-based validation of records as columns: each rule is a boolean
"violated" expression; a row's reasons are the names of its violated rules
in rule order. Valid and rejected rows are split with a filter, never by
collecting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import non_blank
from tidemark.schemas import (
    EVENT_NON_BLANK, EVENT_TIME_FIELDS, EVENT_TYPE, SCHEMA_VERSION, WINDOW_COUNT_FIELDS,
    WINDOW_ERROR_FIELDS, WINDOW_INPUT_FIELDS, WINDOW_NON_BLANK, WINDOW_OPTIONAL_DOUBLE,
    WINDOW_OPTIONAL_LONG, WINDOW_PREDICTION_FIELDS,
)


def reasons(rules: list[tuple[str, Column]]) -> Column:
    """Array of the names of violated rules (empty when the row is valid)."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name))
                                     for name, bad in rules]))


def apply_rules(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    r = reasons(rules)
    return (df.withColumn("reasons", r)
            .withColumn("valid", F.size("reasons") == 0))


def blank_rules(fields: list[str]) -> list[tuple[str, Column]]:
    return [(f"{f}_blank", ~non_blank(f)) for f in fields]


def time_rules(fields: list[str]) -> list[tuple[str, Column]]:
    """A time column is NULL when its text was missing, unparsable or naive."""
    return [(f"{f}_invalid", F.col(f).isNull()) for f in fields]


def event_rules() -> list[tuple[str, Column]]:
    return (blank_rules(EVENT_NON_BLANK) + time_rules(EVENT_TIME_FIELDS) + [
        ("chronology", F.coalesce(F.col("completed_at") < F.col("started_at"), F.lit(False))),
        ("event_type", F.col("event_type") != F.lit(EVENT_TYPE)),
        ("schema_version", F.col("schema_version") != F.lit(SCHEMA_VERSION)),
    ])


def window_rules() -> list[tuple[str, Column]]:
    required = (WINDOW_COUNT_FIELDS + WINDOW_ERROR_FIELDS + WINDOW_INPUT_FIELDS
                + WINDOW_PREDICTION_FIELDS)
    latencies = ["latency_p50_ms", "latency_p95_ms", "latency_p99_ms"]
    rules = blank_rules(WINDOW_NON_BLANK) + time_rules(["window_start", "window_end", "heartbeat_emitted_at"])
    rules.append(("window_order", F.coalesce(F.col("window_end") <= F.col("window_start"), F.lit(False))))
    rules += [(f"{c}_negative", F.col(c).isNull() | (F.col(c) < 0)) for c in required + latencies]
    rules += [(f"{c}_negative", F.col(c).isNotNull() & (F.col(c) < 0))
              for c in WINDOW_OPTIONAL_DOUBLE + WINDOW_OPTIONAL_LONG]
    rules.append(("schema_version", F.col("schema_version") != F.lit(SCHEMA_VERSION)))
    return rules


def validate_events(events: DataFrame) -> DataFrame:
    return apply_rules(events, event_rules())


def validate_windows(windows: DataFrame) -> DataFrame:
    return apply_rules(windows, window_rules())
