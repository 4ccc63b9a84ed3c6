"""Connected components of an edge table, by alternating stars, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved, scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to the least of its neighbours and itself."""
    near = _both(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every vertex of ``edges`` with its component's least vertex, that vertex itself left out.

    Rounds of two stars until nothing changes; each round is a written table,
    so lineage stays short and a lost executor costs one round at most.
    """
    spark = edges.sparkSession
    now = saved(edges.where("a <> b").select("a", "b").distinct(), scratch(spark, "edges"))
    mark = _mark(now)
    while True:
        now = saved(_small_star(_large_star(now)), scratch(spark, "edges"))
        new = _mark(now)
        if new == mark:
            return now
        mark = new
