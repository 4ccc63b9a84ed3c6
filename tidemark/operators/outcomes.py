"""Request normalisation and the mapping of check outcomes to serving
outcomes (what the metrics windows count)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import non_blank, py_strip, with_iso
from tidemark.schemas import (
    OUTCOME_DOMAIN, OUTCOME_DTYPE, OUTCOME_INTERNAL, OUTCOME_INVALID_REQUEST, OUTCOME_MISSING,
    OUTCOME_MODEL_NOT_READY, OUTCOME_NOT_FOUND, OUTCOME_OK, OUTCOME_STALE,
)

PARITY_CODES = [OUTCOME_DOMAIN, OUTCOME_STALE, OUTCOME_MISSING, OUTCOME_DTYPE]


def utc_now_ntz() -> Column:
    return F.current_timestamp().cast("timestamp_ntz")  # session zone is UTC


def normalize_requests(req: DataFrame, id_col: str = "entity_id", ts_col: str = "timestamp",
                       key: str = "station_id", now: Column | None = None) -> DataFrame:
    """Strip the entity id (blank or absent -> invalid_request); parse the
    observation time (absent or empty -> now in UTC; no ISO text -> internal).
    A time with a zone is taken at its UTC instant and marked ``zoned``: it
    goes through the look-up and fails later (``zone_checked``)."""
    ent = py_strip(F.col(id_col))
    text = F.col(ts_col)
    absent = text.isNull() | (text == "")
    t = F.col("_iso")
    zoned = ~absent & t["utc"].isNotNull()
    obs_ts = (F.when(absent, now if now is not None else utc_now_ntz())
              .otherwise(F.coalesce(t["utc"], t["wall"])))
    status = (F.when(~non_blank(id_col), F.lit(OUTCOME_INVALID_REQUEST))
              .when(~absent & t["wall"].isNull(), F.lit(OUTCOME_INTERNAL))
              .otherwise(F.lit(OUTCOME_OK)))
    others = [c for c in req.columns if c not in (id_col, ts_col)]
    return with_iso(req, {"_iso": text}).select(*others, ent.alias(key), obs_ts.alias("obs_ts"), zoned.alias("zoned"), status.alias("status"))


def zone_checked(outcome: Column, zoned: Column) -> Column:
    """The outcome of a request whose time had a zone: an unknown station and
    a small capacity are found first; the age of the snapshot, a zoned time
    less a naive one, cannot be taken."""
    return F.when(zoned & outcome.isin(OUTCOME_OK, OUTCOME_STALE), F.lit(OUTCOME_INTERNAL)).otherwise(outcome)


def serving_outcome(code: Column) -> tuple[Column, Column, Column]:
    """(outcome, error_type, http_status) of a check outcome code."""
    outcome = (F.when(code == OUTCOME_OK, F.lit("success"))
               .when(code.isin(*PARITY_CODES), F.lit("rejected"))
               .when(code == OUTCOME_INVALID_REQUEST, F.lit("invalid"))
               .otherwise(F.lit("failure")))
    error_type = (F.when(code == OUTCOME_NOT_FOUND, F.lit("feature_lookup"))
                  .when(code == OUTCOME_MODEL_NOT_READY, F.lit("model_load"))
                  .when(code.isin(OUTCOME_OK, OUTCOME_INVALID_REQUEST, *PARITY_CODES), F.lit(None).cast("string"))
                  .otherwise(F.lit("internal")))
    http = (F.when(code == OUTCOME_OK, F.lit(200))
            .when(code.isin(OUTCOME_INVALID_REQUEST, *PARITY_CODES), F.lit(422))
            .when(code == OUTCOME_NOT_FOUND, F.lit(404))
            .when(code == OUTCOME_MODEL_NOT_READY, F.lit(503))
            .otherwise(F.lit(500)))
    return outcome, error_type, http
