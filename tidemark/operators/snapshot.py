"""Online feature snapshot: build it from metrics, and look entities up in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import iso_text
from tidemark.operators.features import reconstruct


def open_snapshot(spark: SparkSession, path: str, view: str = "online_features") -> DataFrame:
    """Scan a Parquet snapshot and expose it as a temp view."""
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(view)
    return df


def build_snapshot(metrics: DataFrame, key: str = "station_id") -> DataFrame:
    """One row per entity: the 22 features at its newest metrics row, with
    ``snapshot_ts`` = that row's ``window_start``."""
    newest = metrics.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("window_start").alias("obs_ts"))
    feats = reconstruct(newest, metrics)
    return feats.withColumnRenamed("obs_ts", "snapshot_ts").drop("outcome", "snapshot_source_ts")


def newest_per_key(snapshot: DataFrame, key: str, ts_col: str = "snapshot_ts") -> DataFrame:
    """Deterministic stand-in for an arbitrary ``LIMIT 1``: newest row per key
    (aggregation with map-side combine, so a repeated key stays cheap)."""
    cols = [c for c in snapshot.columns if c != key]
    best = F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(ts_col))
    return snapshot.groupBy(key).agg(best.alias("_row")).select(key, "_row.*")


def lookup(requests: DataFrame, snapshot: DataFrame, key: str = "station_id",
           ts_col: str = "snapshot_ts") -> DataFrame:
    """Every request with its snapshot row (NULLs when not found), ``found``
    and ``snapshot_ts_text`` ('unknown' when the snapshot has no time).

    No side is assumed small: the snapshot has one row per entity, which
    grows with the data, so the join strategy is left to AQE's measured sizes.
    """
    snap = newest_per_key(snapshot, key, ts_col).withColumn("_found", F.lit(True))
    j = requests.join(snap, key, "left")
    ts = F.col(ts_col)
    text = iso_text(ts, sep=" ") if dict(snap.dtypes)[ts_col].startswith("timestamp") else ts
    return (j.withColumn("found", F.coalesce(F.col("_found"), F.lit(False)))
            .withColumn("snapshot_ts_text", F.coalesce(text, F.lit("unknown")))
            .drop("_found"))
