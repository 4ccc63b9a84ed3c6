"""Feature contracts: read, lint, project in declared order, coerce dtypes.

A contract is configuration (one entry per feature), so it is read once on
the driver to build column expressions; the data it is applied to never
leaves the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import non_blank, truthy
from tidemark.schemas import ALLOWED_DTYPES, DTYPE_TO_SPARK

CONTRACT_SCHEMA = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("entity_key", T.StringType()),
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("dtype", T.StringType()),
    ]))),
    T.StructField("target", T.StringType()),
])


class FeatureParityError(ValueError):
    """A contract and the data it is applied to disagree (analysis time)."""


@dataclass(frozen=True)
class Contract:
    version: str
    entity_key: str
    features: tuple[tuple[str, str], ...]
    target: str

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.features]


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """Contract JSON file(s) -> one row per feature with its declared position."""
    raw = (spark.read.schema(CONTRACT_SCHEMA).option("multiLine", True).json(path)
           .withColumn("source_file", F.col("_metadata.file_path")))
    return exploded(raw)


def exploded(raw: DataFrame) -> DataFrame:
    return raw.select("source_file", "version", "entity_key", "target", F.col("features").isNotNull().alias("declared"),
                      F.posexplode_outer("features").alias("pos", "feature")) \
        .select("source_file", "version", "entity_key", "target", "declared", "pos",
                F.col("feature.name").alias("name"), F.col("feature.dtype").alias("dtype"))


def lint_contracts(entries: DataFrame) -> DataFrame:
    """Violations of exploded contracts: missing envelope keys, blank names,
    unknown dtypes and duplicate names (within one contract file)."""
    envelope = (entries.select("source_file", "version", "entity_key", "target", "declared", "pos").where(F.col("pos").isNull() | (F.col("pos") == 0))
                .select("source_file", F.explode(F.array_compact(F.array(
                    *[F.when(F.col(k).isNull(), F.lit(f"missing_{k}")) for k in ("version", "entity_key", "target")],
                    F.when(~F.col("declared"), F.lit("missing_features"))))).alias("rule"))
                .select("source_file", F.lit(None).cast("string").alias("name"), "rule"))
    per_entry = (entries.where(F.col("pos").isNotNull())
                 .select("source_file", "name", F.explode(F.array_compact(F.array(
                     F.when(~non_blank("name"), F.lit("blank_name")),
                     F.when(~F.coalesce(F.col("dtype").isin(*ALLOWED_DTYPES), F.lit(False)), F.lit("unknown_dtype"))
                 ))).alias("rule")))
    dups = (entries.where(F.col("pos").isNotNull()).groupBy("source_file", "name").count()
            .where(F.col("count") > 1).select("source_file", "name", F.lit("duplicate_name").alias("rule")))
    return envelope.unionByName(per_entry).unionByName(dups)


def collect_contract(entries: DataFrame) -> Contract:
    """Bring one (small) contract to the driver, raising on any lint finding."""
    bad = lint_contracts(entries).collect()
    if bad:
        raise FeatureParityError(f"invalid contract: {[(r['name'], r['rule']) for r in bad]}")
    rows = entries.orderBy("pos").collect()
    files = {r["source_file"] for r in rows}
    if len(files) != 1:
        raise FeatureParityError(f"one contract file expected, found {sorted(files)}")
    return Contract(rows[0]["version"], rows[0]["entity_key"],
                    tuple((r["name"], r["dtype"]) for r in rows if r["pos"] is not None), rows[0]["target"])


def check_present(df: DataFrame, contract: Contract) -> None:
    missing = [n for n in contract.names if n not in df.columns]
    if missing:
        raise FeatureParityError(f"features in contract but missing from data: {missing}")


def vector(df: DataFrame, contract: Contract, keep: list[str] = ()) -> DataFrame:
    """Contract features in declared order (extra columns dropped)."""
    check_present(df, contract)
    return df.select(*keep, *contract.names)


def _coerce(c: Column, src: T.DataType, dtype: str, strict: bool) -> tuple[Column, Column]:
    """(coerced value, failed) for one value; NULL input handled per mode."""
    target = DTYPE_TO_SPARK[dtype]
    numeric_src = isinstance(src, (T.DoubleType, T.FloatType))
    if dtype in ("str", "object"):
        value = c.cast("string")
        if strict:  # str() of a missing value: NaN for numbers, None otherwise
            value = F.coalesce(value, F.lit("nan" if numeric_src else "None"))
        return value, F.lit(False)
    if dtype == "bool":
        value = truthy(c, src)
        if strict:
            value = F.coalesce(value, F.lit(numeric_src))  # bool(NaN) is True, bool(None) False
        return value, F.lit(False)
    if dtype in ("int32", "int64"):
        if numeric_src:
            bad_number = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
            value = F.when(~bad_number, c.try_cast(target))
        else:
            value = c.try_cast(target)
        failed = c.isNotNull() & value.isNull()
        if strict:
            failed = failed | c.isNull()
        return value, failed
    # float32 / float64
    value = c.try_cast(target)
    return value, c.isNotNull() & value.isNull()


def coerce(df: DataFrame, contract: Contract, *, strict: bool, keep: list[str] = ()) -> DataFrame:
    """Typed contract columns plus ``dtype_status`` ('ok' / 'dtype_error') and
    ``error_feature`` (first failing feature in contract order).

    strict=True is the snapshot path: a missing int fails, a missing text
    becomes 'nan'/'None'. strict=False is the reconstruction path: missing
    values stay NULL (NaN at the model boundary).
    """
    check_present(df, contract)
    types = {f.name: f.dataType for f in df.schema.fields}
    cols, fails = [], []
    for name, dtype in contract.features:
        if dtype not in DTYPE_TO_SPARK:
            raise FeatureParityError(f"unknown dtype {dtype!r} for feature {name!r}")
        v, bad = _coerce(F.col(name), types[name], dtype, strict)
        cols.append(v.alias(name))
        fails.append(F.when(bad, F.lit(name)))
    first = F.coalesce(F.lit(None).cast("string"), *fails)
    return df.select(*keep, *cols, first.alias("error_feature")).withColumn(
        "dtype_status", F.when(F.col("error_feature").isNull(), F.lit("ok")).otherwise(F.lit("dtype_error")))
