"""Bundle lineage contexts and deployment events.

``bundle_lineage`` turns model-metadata records (as read from
``model_metadata.json`` files, all text) into lineage contexts: required
fields checked, timestamps zone-checked and normalised to UTC, model name /
bundle id / bundle URI derived from the bundle path. Rows that break a rule
keep their reasons instead of failing the job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import non_blank, py_strip, with_iso
from tidemark.operators.validate import apply_rules, blank_rules
from tidemark.schemas import EVENT_FIELDS, EVENT_TYPE, SCHEMA_VERSION


@dataclass(frozen=True)
class ServiceSettings:
    service_name: str = "station-serving"
    service_version: str = "0.1.0"
    environment: str = "production"
    instance_id: str | None = None


def _parent(path):
    """Path without its last segment (no regex); NULL when there is no '/'."""
    last = F.substring_index(path, "/", -1)
    return F.when(F.contains(path, F.lit("/")),
                  F.substring(path, F.lit(1), F.length(path) - F.length(last) - 1))


def _uri_path(path):
    """Percent-encode a path like Python's ``quote(path, safe="/")`` (what
    ``Path.as_uri()`` does): form-encode, then undo its differences."""
    enc = F.url_encode(path)
    for old, new in (("%2F", "/"), ("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        enc = F.replace(enc, F.lit(old), F.lit(new))
    return enc


def bundle_lineage(meta: DataFrame, settings: ServiceSettings = ServiceSettings(),
                   path_col: str = "model_path", extra: list[str] | None = None) -> DataFrame:
    """One lineage context per metadata row, with ``valid`` and ``reasons``.

    ``meta`` needs ``model_path``, ``deployment_id`` and the metadata keys
    ``model_version, trained_at, input_dataset_name, input_dataset_version,
    started_at, completed_at`` (missing keys read as NULL). Columns named in
    ``extra`` are kept.
    """
    raw = F.col(path_col)
    path = (F.when(F.startswith(raw, F.lit("file://")), F.substring(raw, 8, 1 << 30))
            .when(F.startswith(raw, F.lit("file:")), F.substring(raw, 6, 1 << 30))
            .otherwise(raw))
    bundle_dir = _parent(path)  # the version folder holding the model file
    times = with_iso(meta, {f"_{c}": F.col(c) for c in ("trained_at", "started_at", "completed_at")})
    ctx = times.select(
        F.lit(settings.service_name).alias("service_name"),
        F.lit(settings.service_version).alias("service_version"),
        F.lit(settings.environment).alias("environment"),
        F.col("deployment_id"),
        F.lit(settings.instance_id).cast("string").alias("instance_id"),
        F.substring_index(F.substring_index(bundle_dir, "/", -2), "/", 1).alias("model_name"),
        F.col("model_version"),
        bundle_dir.alias("bundle_id"),
        F.concat(F.lit("file://"), _uri_path(bundle_dir)).alias("bundle_uri"),
        F.col("_trained_at.utc").alias("bundle_created_at"),
        F.when(non_blank("input_dataset_name"), py_strip("input_dataset_name")).alias("input_dataset_name"),
        F.when(non_blank("input_dataset_version"), py_strip("input_dataset_version")).alias("input_dataset_version"),
        F.col("_started_at.utc").alias("started_at"),
        F.col("_completed_at.utc").alias("completed_at"),
        *(extra or []),
    )
    rules = (
        [("model_version_missing", ~non_blank("model_version"))]
        + [(f"{c}_invalid", F.col(c).isNull()) for c in ("bundle_created_at", "started_at", "completed_at")]
        + blank_rules(["input_dataset_name", "input_dataset_version", "service_name", "service_version",
                       "environment", "deployment_id", "model_name", "bundle_id", "bundle_uri"])
        + [("chronology", F.coalesce(F.col("completed_at") < F.col("started_at"), F.lit(False)))]
    )
    return apply_rules(ctx, rules)


def event_records(activations: DataFrame, lineage: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Deployment event records: activations joined to their lineage context.

    Both sides are keyed by ``deployment_id``; a shuffle join (or a runtime
    broadcast chosen by AQE from measured sizes) -- no side is assumed small.
    ``on`` adds columns that name one of several bundles of a deployment.
    """
    ctx = lineage.drop("valid", "reasons")
    j = activations.join(ctx, on or ["deployment_id"])
    fixed = {"event_type": F.lit(EVENT_TYPE), "schema_version": F.lit(SCHEMA_VERSION)}
    return j.select(*[fixed[c].alias(c) if c in fixed else F.col(c) for c in EVENT_FIELDS])


def deployment_events(activations: DataFrame, lineage: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Events for activations whose lineage context is valid."""
    return event_records(activations, lineage.where(F.col("valid")), on)


def activated_contexts(events: DataFrame) -> DataFrame:
    """The contexts that deployment events put in force, each from its ``activated_at`` on (``metrics.with_context``)."""
    return events.withColumn("activated_at", F.col("event_time")).drop("event_type", "event_time", "activation_reason",
                                                                       "traffic_status", "schema_version")
