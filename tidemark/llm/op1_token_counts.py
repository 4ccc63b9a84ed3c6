"""Token counts with a digest cache.

A stored table maps (tokenizer digest, digest of the normalised content) to a
token count. Counting a table of documents joins it to that store; only the
distinct contents the store lacks are encoded, and their counts are appended.

Defined results: a null text counts as empty (0 tokens); repeated rows and
copies are encoded once and each gets its own result row; a null id stays
null; an empty table gives an empty result; columns other than the id and the
text are ignored, whatever their names. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, table, text_of

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"
OVER = 4096  # tokens


def tokenizer_digest(model: bytes) -> str:
    return hashlib.sha256(model).hexdigest()


def normalised(text):
    """The space and U+2581 are one symbol to the tokenizer, so they share a digest."""
    return F.translate(text, "▁", " ")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"),
                       F.unhex(F.sha2(normalised(text), 256)).alias("digest"), normalised(text).alias("content"))


def open_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Counts stored for one tokenizer. Two jobs may have appended the same digest: one row is kept."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(path)
    return (spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("tokenizer") == tokenizer)
            .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))


def encoder(model: bytes):
    def encode(batches):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        for b in batches:
            counts = [len(sp.encode(t)) for t in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])
    return encode


def fill_cache(docs: DataFrame, model: bytes, path: str, id_col="doc_id", text_col="text") -> None:
    """Encode the distinct contents that the store lacks and append their counts.

    Copies are dropped on the map side before the shuffle (partial
    aggregation), so a content with a third of all rows reaches its task
    once per input task.
    """
    tok = tokenizer_digest(model)
    cache = open_cache(docs.sparkSession, path, tok)
    distinct = keyed(docs, id_col, text_col).groupBy("digest").agg(F.first("content").alias("content"))
    misses = distinct.join(cache, "digest", "left_anti").select("digest", "content")
    (misses.mapInArrow(encoder(model), "digest binary, n_tokens bigint")
     .withColumn("tokenizer", F.lit(tok)).write.mode("append").partitionBy("tokenizer").parquet(path))


def count_tokens(docs: DataFrame, model: bytes, path: str, id_col="doc_id", text_col="text",
                 over: int = OVER) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit per row, through the store at ``path``."""
    fill_cache(docs, model, path, id_col, text_col)
    cache = open_cache(docs.sparkSession, path, tokenizer_digest(model))
    return (keyed(docs, id_col, text_col).select("doc_id", "n_bytes", "digest").join(cache, "digest")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit")))


def query(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    import public_tokenizers

    model = Path(model_path or public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    return count_tokens(table(spark, sf_dir, "documents"), model, scratch(spark, "token-counts"))
