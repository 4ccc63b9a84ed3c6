"""Clustering around centroids in exact integers, assigned by Orchard search.

Every centroid keeps the list of the others, nearest first. A vector starts
at centroid 0 and walks down the list of the nearest centroid found so far;
a closer one (or one as close with a smaller number) becomes the new list to
walk from its top, a centroid met before is passed over, and the walk stops
at the first neighbour strictly further from the list's centroid than twice
the vector's distance: by the triangle inequality none behind it can be as
close. Distances are squared, so the bound is four times. numpy walks all
vectors of a batch at once; each round is one scan with one partial sum per
task and cluster, and only ``k`` centroids pass through the driver.

Integers are exact: 64 bits while components stay below ``narrow(dim)``, Python
integers beyond; a component of 10**15 or more is an error, since sums of its
squares may not fit 38 digits. A distance above 2**63 - 1 is given as null.

Defined results: vectors of another length, null vectors and those with a
null, NaN or infinite component are left out; a null id is clustered but
starts no centroid; rows of equal id are separate vectors (equal hashes are
ordered by components); equal vectors get equal clusters; with fewer than
``k`` ids there are fewer centroids, with none the cluster columns are null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import saved, scratch, table

SCALE, DIM, K, ROUNDS, SALT = 1024, 64, 8, 10, "3:"
WIDEST = 1e15


def quantized(df: DataFrame, dim: int = DIM, scale: float = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): the kept vectors, floor(scale * x) of each component as ``dim`` whole doubles in a binary."""
    if dim < 1:
        raise ValueError("dim must be 1 or more")
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.size("v") == dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten()
            x = np.floor(flat.to_numpy(zero_copy_only=False).reshape(-1, dim) * scale)  # a null becomes NaN
            kept = np.isfinite(x).all(axis=1)
            if (np.abs(x[kept]) >= WIDEST).any():
                raise ValueError(f"a component of {WIDEST:g} or more after scaling")
            body = [r.tobytes() for r in x[kept] + 0.0]  # -0.0 becomes 0.0
            yield pa.RecordBatch.from_arrays([pc.filter(b.column(0), pa.array(kept)), pa.array(body, pa.binary())], names=["id", "v"])

    return rows.mapInArrow(run, T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("v", T.BinaryType())]))


def narrow(dim: int) -> float:
    """Components below this have squared distances below 2**60."""
    return (1 << 29) / dim ** 0.5


def integers(x: np.ndarray) -> np.ndarray:
    """Whole doubles as 64-bit integers, or as Python's where they are too wide to square."""
    if not x.size or np.abs(x).max() < narrow(x.shape[1]):
        return x.astype(np.int64)
    return np.frompyfunc(int, 1, 1)(x)


class Orchard:
    """Centroids (k x dim integers) with their sorted neighbour lists."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.between = np.stack([self._squared(centroids, np.broadcast_to(c, centroids.shape)) for c in centroids])
        k = len(centroids)
        self.lists = np.array([sorted((j for j in range(k) if j != c), key=lambda j: (self.between[c, j], j)) for c in range(k)],
                              np.int64).reshape(k, k - 1)

    @staticmethod
    def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = a - b
        return (d * d).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance) of each row, smaller numbers first in ties, and how many distances were taken."""
        n, k = len(x), len(self.centroids)
        if x.dtype != self.centroids.dtype:  # either side too wide: Python integers on both
            x = x.astype(object)
        now = np.zeros(n, np.int64)
        best = self._squared(x, np.broadcast_to(self.centroids[0], x.shape))
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        place, walking, taken = np.zeros(n, np.int64), np.arange(n), n
        while True:
            walking = walking[place[walking] < k - 1]
            c = now[walking]
            j = self.lists[c, place[walking]]
            within = (self.between[c, j] <= 4 * best[walking]).astype(bool)
            walking, j = walking[within], j[within]
            if not len(walking):
                return now, best, taken
            place[walking] += 1
            new = ~seen[walking, j]
            who, j = walking[new], j[new]
            seen[who, j] = True
            d = self._squared(x[who], self.centroids[j])
            taken += len(who)
            closer = ((d < best[who]) | ((d == best[who]) & (j < now[who]))).astype(bool)
            who, j = who[closer], j[closer]
            now[who], best[who], place[who] = j, d[closer], 0


def _vectors(b: pa.RecordBatch, dim: int) -> np.ndarray:
    return integers(np.frombuffer(b"".join(b.column(1).to_pylist()), np.float64).reshape(-1, dim))


def first_centroids(vectors: DataFrame, k: int, dim: int, salt: str) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``salt`` and the id, in the order of the hashes."""
    rows = (vectors.where(F.col("id").isNotNull())
            .select(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("hash"), "v")
            .orderBy("hash", "v").limit(k).collect())
    return integers(np.array([np.frombuffer(bytes(r.v), np.float64) for r in rows]).reshape(-1, dim))


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: each centroid with vectors becomes the floor of their mean, the others stay."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), object)
        for b in batches:
            x = _vectors(b, dim)
            if len(x):
                now = search.nearest(x)[0]
                for c in np.unique(now):
                    part = x[now == c]
                    counts[c] += len(part)
                    sums[c] += part.sum(axis=0)
        held = np.flatnonzero(counts)
        if len(held):
            yield pa.RecordBatch.from_arrays([
                pa.array(held.astype(np.int32)), pa.array(counts[held]),
                pa.array([[Decimal(int(s)) for s in sums[c]] for c in held], pa.list_(pa.decimal128(38, 0)))], names=["cluster", "n", "sums"])

    partial = vectors.select("id", "v").mapInArrow(run, "cluster int, n bigint, sums array<decimal(38,0)>")
    total = (partial.select("cluster", "n", F.posexplode("sums").alias("i", "s"))
             .groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())
    out = centroids.astype(object)
    for r in total:
        out[r.cluster, r.i] = int(r.s) // r.n
    return integers(out.astype(np.float64)) if all(abs(int(v)) < narrow(dim) for v in out.flat) else out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance, exact): ``distance`` is null above 64 bits, ``exact`` has 38 digits."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids) if k else None
        for b in batches:
            x = _vectors(b, dim)
            if search is None or not len(x):
                now, best = [None] * len(x), [None] * len(x)
            else:
                now, best = (v.tolist() for v in search.nearest(x)[:2])
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(now, pa.int32()),
                pa.array([d if d is not None and d < 1 << 63 else None for d in best], pa.int64()),
                pa.array([None if d is None else Decimal(d) for d in best], pa.decimal128(38, 0))],
                names=["id", "cluster", "distance", "exact"])

    return vectors.select("id", "v").mapInArrow(run, T.StructType([
        vectors.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()),
        T.StructField("exact", T.DecimalType(38, 0))]))


def cluster(df: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: float = SCALE, salt: str = SALT,
            id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(per vector: id column, cluster, distance, cluster_inertia, inertia; the final centroids).

    The kept vectors are written once, and so are the last assignments.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    spark = df.sparkSession
    vectors = saved(quantized(df, dim, scale, id_col, vec_col), scratch(spark, "orchard-vectors"))
    centroids = first_centroids(vectors, k, dim, salt)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)
    last = saved(assigned(vectors, centroids), scratch(spark, "orchard-assigned"))
    whole = "decimal(38,0)"
    by_cluster = last.groupBy("cluster").agg(F.sum("exact").alias("s")).collect()  # k rows at most
    sums = {r.cluster: r.s for r in by_cluster if r.cluster is not None}
    total = F.lit(sum(sums.values(), Decimal(0))).cast(whole).try_cast("bigint")
    of = F.create_map(*[x for c, s in sums.items() for x in (F.lit(c), F.lit(s).cast(whole).try_cast("bigint"))]) if sums else None
    out = last.select(F.col("id").alias(id_col), "cluster", "distance",
                      (of[F.col("cluster")] if sums else F.lit(None).cast("bigint")).alias("cluster_inertia"),
                      F.when(F.col("cluster").isNotNull(), total).alias("inertia"))
    return out, centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    return rows.withColumn("centroid_sha256", F.get(F.array(*map(F.lit, digests)).cast("array<string>"), F.col("cluster")))
