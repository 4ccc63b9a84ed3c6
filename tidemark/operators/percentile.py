"""Exact nearest-rank percentiles per group by radix selection.

Nearest rank: for ``n`` values sorted ascending, the ``p``-th percentile is
the value at 1-based rank ``k = clamp(ceil(p / 100 * n), 1, n)``.

Equal values are counted first (map-side combine). Each value has an
order-preserving 64-bit key, read as digits of ``DIGITS`` bits from the top.
A histogram of the first digit in each group says which digit holds rank
``k``; only the rows with that digit go into the histogram of the second,
and so on: a group, however large, is never sorted or gathered, and a
histogram has at most 2**24 rows. All of it is one lazy plan: no sampled
ranges, no checkpoint, no job while it is built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = (24, 20, 20)


def ordered_key(value: Column, dtype: T.DataType) -> Column:
    """A BIGINT that sorts as the value does (NaN last, as Spark sorts it)."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return value.cast("bigint")
    if not isinstance(dtype, (T.FloatType, T.DoubleType)):
        raise TypeError(f"no ordered key for {dtype.simpleString()}")
    # The 52 bits of the fraction below the exponent, as the number itself is laid out, by exact arithmetic.
    x = value.cast("double")
    a, unit = F.abs(x), F.lit(float(1 << 52))

    def power(e: Column) -> Column:
        return F.pow(F.lit(2.0), e.cast("double"))

    e = F.floor(F.log2(a))
    e = F.when(power(e) > a, e - 1).when(power(e + 1) <= a, e + 1).otherwise(e)
    normal = (e + 1023) * F.lit(1 << 52) + ((a / power(e) - 1) * unit).cast("bigint")
    size = (F.when(F.isnan(x), F.lit(0x7FF8 << 48)).when(a == F.lit(float("inf")), F.lit(0x7FF0 << 48))
            .when(a < F.lit(2.0 ** -1022), (a / F.lit(2.0 ** -1074)).cast("bigint")).otherwise(normal))
    return F.when(value.isNotNull(), F.when(x < 0, -size).otherwise(size))


def _narrowed(targets: DataFrame, counts: DataFrame, g: list[str], above: str, digit: str) -> DataFrame:
    """Targets (group, which, k among the rows under ``above``) with the ``digit`` that holds k, and k among its rows."""
    t = targets.select(*[F.col(c).alias(f"_t_{c}") for c in g], F.col(above).alias("_t_above"), "_pr_i", "_pr_k")
    j = t.join(counts, reduce(lambda a, b: a & b, [F.col(f"_t_{c}").eqNullSafe(F.col(c)) for c in g],
                              F.col("_t_above") == F.col(above)))
    upto = Window.partitionBy(*g, above, "_pr_i").orderBy(digit).rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("_pr_upto", F.sum("_pr_c").over(upto))
    before = F.col("_pr_upto") - F.col("_pr_c")
    return (j.where((before < F.col("_pr_k")) & (F.col("_pr_k") <= F.col("_pr_upto")))
            .withColumn("_pr_k", F.col("_pr_k") - before).drop("_pr_upto", "_t_above", *[f"_t_{c}" for c in g]))


def nearest_rank(df: DataFrame, group_cols: list[str], value_col: str,
                 percentiles: dict[str, float], num_slices: int | None = None,
                 sums: dict[str, Column] | None = None, weight_col: str | None = None) -> DataFrame:
    """One row per group with a column per percentile (NULL values ignored;
    NULL percentiles for a group without values).

    ``sums`` are per-row additive expressions summed per group in the same
    pass (they ride along with the value counts), so a caller needing both
    counters and percentiles reads its input once. Rows with a NULL value
    still count in ``sums``. ``weight_col`` holds how often a row's value
    occurs (value counts made before). ``num_slices`` is the number of
    partitions of the value counts, else the session's.
    """
    g, sums = list(group_cols), sums or {}
    v = F.col(value_col)
    weight = F.when(v.isNotNull(), F.col(weight_col) if weight_col else F.lit(1)).otherwise(F.lit(0))
    riding = [F.sum(n).alias(n) for n in sums]
    spread = df.withColumn("_pr_v", v)
    if num_slices:
        spread = spread.repartition(num_slices, *g, "_pr_v")
    values = spread.groupBy(*g, "_pr_v").agg(F.sum(weight).alias("_pr_c"), *[F.sum(e).alias(n) for n, e in sums.items()])
    key = F.col("_pr_key")
    values = values.withColumn("_pr_key", ordered_key(F.col("_pr_v"), df.schema[value_col].dataType))
    shifts = [64 - sum(DIGITS[:n + 1]) for n in range(len(DIGITS))]  # of each level, 0 for the last
    names = [f"_pr_d{n}" for n in range(len(shifts))]
    values = values.withColumns({n: F.shiftright(key, s) if s else key for n, s in zip(names, shifts)})

    # Histograms from the finest to the coarsest, each from the one before.
    levels = [values]
    for n in range(len(names) - 1, 0, -1):
        levels.insert(0, levels[0].groupBy(*g, *names[:n]).agg(F.sum("_pr_c").alias("_pr_c"), *riding))
    whole = Window.partitionBy(*g)
    ranks = [(i, p) for i, p in enumerate(percentiles.values())]
    top = levels[0].select(*g, names[0], "_pr_c", *sums, F.sum("_pr_c").over(whole).alias("_pr_n"),
                           F.sum("_pr_c").over(whole.orderBy(names[0]).rowsBetween(Window.unboundedPreceding, 0)).alias("_pr_upto"))
    n, before = F.col("_pr_n"), F.col("_pr_upto") - F.col("_pr_c")
    wanted = [(i, F.least(n, F.greatest(F.lit(1), F.ceil(F.lit(p / 100.0) * n)))) for i, p in ranks]
    held = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), k.alias("k")) for i, k in wanted]),
                    lambda x: (x["k"] > before) & (x["k"] <= F.col("_pr_upto")))
    targets = top.select(*g, names[0], before.alias("_pr_before"), F.explode(held).alias("_pr_t")) \
        .select(*g, names[0], F.col("_pr_t.i").alias("_pr_i"), (F.col("_pr_t.k") - F.col("_pr_before")).alias("_pr_k"))
    for level, counts in enumerate(levels[1:], 1):
        targets = _narrowed(targets, counts.drop(*sums), g, names[level - 1], names[level])

    # Every group once, with its sums, and its values beside them.
    found = targets.select(*g, "_pr_i", "_pr_v", *[F.lit(None).cast(f.dataType).alias(f.name) for f in top.select(*sums).schema])
    groups = top.select(*g, F.lit(None).cast("int").alias("_pr_i"), F.lit(None).cast(values.schema["_pr_v"].dataType).alias("_pr_v"), *sums)
    return groups.unionByName(found).groupBy(*g).agg(
        *riding, *[F.max(F.when(F.col("_pr_i") == i, F.col("_pr_v"))).alias(name) for i, name in enumerate(percentiles)])
