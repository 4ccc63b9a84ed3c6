"""Corpus pipeline: documents to packed token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's docs. All but the last return
the columns of documents. Every stage works on whole texts of all rows that
its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import op3_toxicity, op4_mixture, op7_ngram_jaccard, op8_packed_ids, op10_decontaminate
from tidemark.llm.common import bound_batches, saved, scratch, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = op3_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return op3_toxicity.clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    bound_batches(spark)
    return op7_ngram_jaccard.deduplicate(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within the error budget."""
    return op10_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens meet the source, language and topic targets, as far as there are tokens."""
    bound_batches(spark)
    return op4_mixture.sample(docs, tolerance=op4_mixture.TOLERANCE)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids, read back: doc_id, start, n_tokens, ids_crc32."""
    bound_batches(spark)
    return op8_packed_ids.digests(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("token_ids", token_ids)]

ORACLE_SQL = None  # a trained classifier and edit distances are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), scratch(spark, f"pipeline-{name}"))
    return docs
