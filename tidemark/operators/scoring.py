"""Bulk scoring with any model object exposing ``predict(X) -> array``.

The model is broadcast once and used inside an iterator Pandas UDF, so it
is deserialised once per Python worker and called on whole Arrow batches.
Missing feature values reach the model as NaN (as the reference's vector).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConstantModel:
    """Predicts the same value for every row (the reference tests' stub)."""

    def __init__(self, value: float = 42.0):
        self.value = float(value)

    def predict(self, X) -> np.ndarray:
        return np.full(len(X), self.value)


class LinearModel:
    """bias + sum(weight * feature) over the named features of the vector."""

    def __init__(self, feature_names: list[str], weights: dict[str, float], bias: float = 0.0):
        self.idx = [feature_names.index(n) for n in weights]
        self.w = np.array(list(weights.values()), dtype=float)
        self.bias = float(bias)
        self.weights = dict(weights)

    def predict(self, X) -> np.ndarray:
        X = np.asarray(X, dtype=float)
        return X[:, self.idx] @ self.w + self.bias

    def sql(self) -> str:
        terms = " + ".join(f"CAST({w!r} AS DOUBLE) * {n}" for n, w in self.weights.items())
        return f"(CAST({self.bias!r} AS DOUBLE) + {terms})"


MODEL_BYTES_MAX = 1 << 30  # a larger model is not broadcast


def broadcast_model(spark: SparkSession, model) -> Broadcast:
    """The model on every executor, once; its pickled size is checked first."""
    size = len(cloudpickle.dumps(model))
    if size > MODEL_BYTES_MAX:
        raise ValueError(f"model of {size} bytes is over the broadcast bound of {MODEL_BYTES_MAX}")
    return spark.sparkContext.broadcast(model)


def _matrix(cols: tuple[pd.Series, ...]) -> np.ndarray:
    """Features side by side: doubles, or objects as soon as one is text."""
    if any(c.dtype == object for c in cols):
        X = np.empty((len(cols[0]), len(cols)), dtype=object)
        for n, c in enumerate(cols):
            X[:, n] = c.to_numpy(dtype=object)
        return X
    return np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in cols])


def prediction_struct(df: DataFrame, model, feature_cols: list[str]) -> Column:
    """A Pandas-UDF column ``(v, nan, failed)`` for each row.

    Numbers reach the model as doubles, text as it is. A batch on which the
    model raises is scored again row by row, and the rows that raise are
    marked ``failed``. ``model`` may be a Broadcast made before.
    """
    bc = model if isinstance(model, Broadcast) else broadcast_model(df.sparkSession, model)

    def rows(m, X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y, failed = np.zeros(len(X)), np.zeros(len(X), dtype=bool)
        for n in range(len(X)):
            try:
                y[n] = np.asarray(m.predict(X[n:n + 1]), dtype=float).reshape(-1)[0]
            except Exception:
                failed[n] = True
        return y, failed

    # Arrow turns NaN into NULL on the way back, so NaN travels as a flag
    # and is restored JVM-side: a NaN prediction must stay NaN (it counts
    # as non-finite in the metrics windows, NULL does not).
    @F.pandas_udf("v double, nan boolean, failed boolean")
    def _predict(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        m = bc.value
        for cols in batches:
            if isinstance(cols, pd.Series):  # one feature: batches are bare Series
                cols = (cols,)
            X = _matrix(cols)
            try:
                y, failed = np.asarray(m.predict(X), dtype=float).reshape(-1), np.zeros(len(X), dtype=bool)
            except Exception:
                y, failed = rows(m, X)
            nan = np.isnan(y)
            yield pd.DataFrame({"v": np.where(nan, 0.0, y), "nan": nan, "failed": failed})

    types = {f.name: f.dataType for f in df.schema.fields}
    return _predict(*[F.col(c) if isinstance(types[c], T.StringType) else F.col(c).cast("double")
                      for c in feature_cols])


def prediction_of(scored: Column) -> Column:
    return F.when(scored["nan"], F.lit(float("nan"))).otherwise(scored["v"])


def predict_column(df: DataFrame, model, feature_cols: list[str]) -> Column:
    """The prediction for each row; a row on which the model fails ends the job."""
    scored = prediction_struct(df, model, feature_cols)
    return F.when(scored["failed"], F.raise_error(F.lit("the model failed on a row")).cast("double")) \
        .otherwise(prediction_of(scored))


def score(df: DataFrame, model, feature_cols: list[str], out_col: str = "prediction") -> DataFrame:
    return df.withColumn(out_col, predict_column(df, model, feature_cols))
