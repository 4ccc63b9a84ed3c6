"""Shared helpers for the registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import checkpoint_dir, ensure_utc
from tidemark.sources import standins
from tidemark.sources.tables import load_table

ROUND = 6


def round6(c) -> F.Column:
    """Round half up to 6 places in two steps, written the same way in the
    DuckDB oracle: first to 9 places, which absorbs the last-bit noise of
    sums added in a different order, then to 6. A one-step round splits
    values that sit exactly half-way (averages over 2^k rows do)."""
    c = F.col(c) if isinstance(c, str) else c
    r = F.floor(F.floor(c * F.lit(1e9) + F.lit(0.5)) / F.lit(1000.0) + F.lit(0.5)) / F.lit(1e6)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), c).otherwise(r)


def round_doubles(df: DataFrame, places: int = ROUND) -> DataFrame:
    """Round every double column with ``round6`` (the oracle does the same)."""
    assert places == ROUND
    return df.select(*[round6(f.name).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Inputs:
    """Lazily built inputs of one sf directory (plans only; nothing runs here)."""

    def __init__(self, spark: SparkSession, sf_dir: str, n_stations: int = 8):
        ensure_utc(spark)
        self.spark, self.sf_dir, self.n_stations = spark, sf_dir, n_stations

    def table(self, name: str) -> DataFrame:
        return load_table(self.spark, self.sf_dir, name)

    @property
    def events(self) -> DataFrame:
        return self.table("events")

    @property
    def orders(self) -> DataFrame:
        return self.table("orders")

    @property
    def metrics(self) -> DataFrame:
        return standins.station_metrics(self.events, self.n_stations)

    @property
    def obs(self) -> DataFrame:
        return standins.observation_points(self.events, self.n_stations)

    @property
    def request_log(self) -> DataFrame:
        return standins.request_log(self.events)

    @property
    def requests(self) -> DataFrame:
        return standins.request_text(self.events, self.n_stations)

    @property
    def bundle_metadata(self) -> DataFrame:
        return standins.bundle_metadata(self.orders)

    @property
    def activations(self) -> DataFrame:
        return standins.activations(self.orders)
