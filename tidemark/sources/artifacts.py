"""Model-bundle artifacts: ``models/<name>/<version>/model_metadata.json``.

Read with a fixed all-text schema (a missing key reads as NULL and becomes
a reject reason downstream instead of failing the job); each record keeps
the file it came from and the path of the model file next to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METADATA_FIELDS = ["model_version", "trained_at", "target", "model_type", "input_dataset_name",
                   "input_dataset_version", "started_at", "completed_at"]
METADATA_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in METADATA_FIELDS])


def _with_paths(raw: DataFrame, model_file: str, deployment_id: str | None, *others: str) -> DataFrame:
    folder = F.regexp_replace(F.col("source_file"), r"/[^/]*$", "")
    dep = F.lit(deployment_id) if deployment_id is not None else F.regexp_replace(folder, r"^file:(//)?", "")
    return raw.select("source_file", F.concat(folder, F.lit("/" + model_file)).alias("model_path"),
                      dep.alias("deployment_id"), *others, *METADATA_FIELDS)


def read_bundle_metadata(spark: SparkSession, path: str, model_file: str = "model.pkl",
                         deployment_id: str | None = None) -> DataFrame:
    """One row per metadata file under ``path`` (a folder or glob).

    ``deployment_id`` defaults to the bundle folder (one deployment per
    bundle); pass a literal to tag every bundle with one deployment.
    """
    raw = (spark.read.schema(METADATA_SCHEMA).option("multiLine", True)
           .option("recursiveFileLookup", True).json(path)
           .withColumn("source_file", F.col("_metadata.file_path")))
    return _with_paths(raw, model_file, deployment_id)


def stream_bundle_metadata(spark: SparkSession, path: str, model_file: str = "model.pkl",
                           deployment_id: str | None = None) -> DataFrame:
    """The same rows as a stream of new files, with ``put_at``, the time each file was put there."""
    raw = (spark.readStream.schema(METADATA_SCHEMA).option("multiLine", True)
           .option("recursiveFileLookup", True).json(path)
           .select("*", F.col("_metadata.file_path").alias("source_file"),
                   F.col("_metadata.file_modification_time").alias("put_at")))
    return _with_paths(raw, model_file, deployment_id, "put_at")
