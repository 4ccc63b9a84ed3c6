"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir


BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's default of 10,000 rows: whole texts are long. A caller's own choice stays."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: lineage ends at shared storage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def release() -> None:
    """Give memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches in stretches of ``rows``, which bounds the Python objects alive at once.

    Python workers outlive their tasks, so what a task has freed goes back to the system at its end, and what it
    freed only then at the start of the worker's next one.
    """
    release()
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
    b = None
    release()


_K = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * _K)
_PIECE = 1 << 18  # bytes hashed together
_BASE = 0xD1342543DE82EF95


def _powers(base: int) -> np.ndarray:
    out = np.full(_PIECE, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts, found and hashed by numpy.

    ``starts``/``ends``: byte spans in ``buf``; ``first[d]:first[d + 1]`` are
    the words of text d; ``hashes``: 64 bits of each word's bytes (a
    polynomial over mixed symbols, position taken out, mixed with the length).
    """

    _pow = _inv = None

    def __init__(self, raw: list[bytes]):
        self.buf = b"\n".join([b"", *raw, b""])
        a = self.array = np.frombuffer(self.buf, np.uint8)
        space = _SPACE[a]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.text_starts = np.cumsum([1, *(len(r) + 1 for r in raw)])
        self.first = np.searchsorted(self.starts, self.text_starts)
        self._hashes = None

    def __len__(self) -> int:
        return len(self.starts)

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i]:self.ends[i]]

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            if Words._pow is None:
                Words._pow, Words._inv = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
            out, i, n = np.empty(len(self), np.uint64), 0, len(self)
            while i < n:
                at = int(self.starts[i])
                j = int(np.searchsorted(self.ends, at + _PIECE, "right"))
                if j <= i:  # a word longer than a piece
                    out[i], j = self._long(at, int(self.ends[i])), i + 1
                else:
                    sums = self._sums(at, int(self.ends[j - 1]))
                    s, e = self.starts[i:j] - at, self.ends[i:j] - at
                    out[i:j] = (sums[e] - sums[s]) * Words._inv[s]
                i = j
            self._hashes = mix(out ^ (self.ends - self.starts).astype(np.uint64))
        return self._hashes

    def _sums(self, start: int, end: int) -> np.ndarray:
        out = np.zeros(end - start + 1, np.uint64)
        np.cumsum(_SYMBOL[self.array[start:end]] * Words._pow[:end - start], out=out[1:])
        return out

    def _long(self, start: int, end: int) -> int:
        total, mask = 0, (1 << 64) - 1
        for k in range(start, end, _PIECE):
            part = int(self._sums(k, min(end, k + _PIECE))[-1])
            total = (total + part * pow(_BASE, k - start, 1 << 64)) & mask
        return total


def word_batches(texts: list[str | None], lower: bool = False, size: int = 1 << 20):
    """(index of the first text, Words) over texts of about ``size`` bytes together; null is empty."""
    raw, at, held = [], 0, 0
    for t in texts:
        r = (t or "").encode("utf-8", "surrogatepass")
        raw.append(r.lower() if lower else r)
        held += len(r)
        if held >= size:
            yield at, Words(raw)
            at, raw, held = at + len(raw), [], 0
    if raw:
        yield at, Words(raw)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles of word hashes ``h``.

    Fewer words than ``n``: the whole sequence as one shingle; no words: empty.
    """
    if not len(h):
        return np.empty(0, np.uint64)
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix(out * _K + h[k:len(h) - size + 1 + k])
    return np.unique(out)
