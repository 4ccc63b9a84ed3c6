"""Chunks of a corpus that ask hash buckets which of their keys are frequent.

Texts stay in a table bucketed by chunk, written once. At each level every
chunk sends its distinct keys, packed as one binary per hash bucket; the task
of a bucket answers each chunk with the keys whose occurrences over all
chunks reach the threshold. Only keys and answers cross the network: the
chunk table is scanned bucket by bucket, without an exchange.

A hot key is counted inside each chunk first, so it is one entry a chunk,
whatever its frequency. Buckets are numbered by hash, and their number grows
with the keys (``bucket_count``), so a bucket's task holds a bounded share.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, shuffle_partitions

QUESTION = "bucket bigint, chunk bigint, body binary"
ANSWER = "chunk bigint, level int, bucket bigint, body binary"
_ASKED = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("body", pa.binary())])
_ANSWERED = pa.schema([("chunk", pa.int64()), ("level", pa.int32()), ("bucket", pa.int64()), ("body", pa.binary())])

LEAST, MOST = 1 << 18, 1 << 25  # keys of a bucket
LOW = np.uint64(0xFFFFFFFF)
SHIFT = np.uint64(32)
CEILING = 255  # counts travel in a byte

KEY = np.dtype([("low", "<u4"), ("count", "u1")])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` bucketed by its column ``chunk`` to the shared folder and read it back with its buckets."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    (df.write.format("parquet").option("compression", "zstd").option("path", scratch(spark, name))
     .bucketBy(shuffle_partitions(spark), "chunk").saveAsTable(table))
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay: the table is external
    return out


def bucket_count(spark: SparkSession, keys: int) -> int:
    """Four buckets a shuffle partition, as long as a bucket has ``LEAST`` to ``MOST`` keys."""
    return max(1, -(-keys // MOST), min(4 * shuffle_partitions(spark), keys // LEAST))


def placed(keys: np.ndarray, buckets: int) -> np.ndarray:
    """64-bit keys as (bucket, low 32 bits), in one sortable number."""
    return (keys >> SHIFT) % np.uint64(buckets) << SHIFT | keys & LOW


def asked(chunk: int, keys: np.ndarray, bodies: np.ndarray) -> pa.Table:
    """One row for each bucket of ``keys`` (placed, sorted); ``bodies`` goes along with the keys."""
    bucket = (keys >> SHIFT).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cuts[1:], len(bucket))
    return pa.table({"bucket": pa.array(bucket[cuts]), "chunk": pa.array(np.full(len(cuts), chunk, np.int64)),
                     "body": pa.array([bodies[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())}, schema=_ASKED)


def counted(chunk: int, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
    """Question of distinct placed keys, sorted, with their counts in this chunk."""
    bodies = np.empty(len(keys), KEY)
    bodies["low"], bodies["count"] = keys & LOW, np.minimum(counts, CEILING)
    return asked(chunk, keys, bodies)


def frequent(threshold: int, level: int) -> Callable[[pa.Table], pa.Table]:
    """The answer of one bucket: of each chunk's keys, those that occur ``threshold`` times or more (at most 255).

    Keys are the low 32 bits inside a bucket, so a few rarer keys pass as
    well; no frequent key is lost.
    """
    if threshold > CEILING:
        raise ValueError(f"threshold {threshold}: counts stop at {CEILING}")

    def answer(t: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x.as_buffer(), KEY) for x in t["body"]]
        low = np.concatenate([r["low"] for r in rows])
        order = np.argsort(low, kind="stable")
        ranked = low[order]
        new = np.flatnonzero(np.diff(ranked, prepend=ranked[0] ^ np.uint32(1)))
        sums = np.add.reduceat(np.concatenate([r["count"] for r in rows])[order].astype(np.int64), new)
        keep = np.empty(len(low), bool)
        keep[order] = np.repeat(sums >= threshold, np.diff(np.append(new, len(low))))
        return answered(t, level, rows, keep, lambda r, k: r["low"][k].tobytes())

    return answer


def answered(t: pa.Table, level: int, rows: list[np.ndarray], keep: np.ndarray,
             body: Callable[[np.ndarray, np.ndarray], bytes]) -> pa.Table:
    at, chunks, buckets, bodies = 0, [], [], []
    for chunk, bucket, r in zip(t["chunk"].to_pylist(), t["bucket"].to_pylist(), rows):
        k = keep[at:at + len(r)]
        at += len(r)
        if k.any():
            chunks.append(chunk)
            buckets.append(bucket)
            bodies.append(body(r, k))
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "level": pa.array([level] * len(chunks), pa.int32()),
                     "bucket": pa.array(buckets, pa.int64()), "body": pa.array(bodies, pa.binary())}, schema=_ANSWERED)


def passed(answers: pa.Table, level: int) -> np.ndarray:
    """The placed keys of a level that a chunk's answers name, sorted."""
    parts = [np.uint64(b) << SHIFT | np.frombuffer(x.as_buffer(), "<u4").astype(np.uint64)
             for n, b, x in zip(answers["level"].to_pylist(), answers["bucket"].to_pylist(), answers["body"]) if n == level]
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``keys`` are in the sorted ``some``."""
    if not len(some) or not len(keys):
        return np.zeros(len(keys), bool)
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


def empty_question() -> pa.Table:
    return _ASKED.empty_table()


def cogrouped(table: DataFrame, answers: DataFrame, func: Callable, schema: str) -> DataFrame:
    """``func(chunk row, its answers)`` for every chunk; the chunk table is not moved."""
    return table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(func, schema)


def total(table: DataFrame, column: str) -> int:
    return int(table.agg(F.sum(column)).first()[0] or 0)
