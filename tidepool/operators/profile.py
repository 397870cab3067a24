"""Profiling: overview, column info, null map, describe, value counts,
histogram, top-k, head and seeded sample.

All are single-pass aggregates with partial aggregation, or ordered limits
(``TakeOrderedAndProject``: per-partition top k, then a k x partitions merge).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.operators.quantile import exact_quantile_values


def _missing(df: DataFrame, c: str) -> Column:
    col = F.col(f"`{c}`")
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def overview(df: DataFrame, time_col: str) -> DataFrame:
    """rows, columns, first and last time, total missing cells (NULL or NaN)."""
    miss = None
    for c in df.columns:
        m = F.sum(F.when(_missing(df, c), 1).otherwise(0))
        miss = m if miss is None else miss + m
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.lit(len(df.columns)).alias("n_cols"),
                  F.min(time_col).alias("min_time"),
                  F.max(time_col).alias("max_time"),
                  miss.cast("long").alias("n_missing"))


def column_info(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null) per column; one aggregate pass, then unpivot."""
    cols = df.columns
    agg = df.agg(*[F.sum(F.when(~_missing(df, c), 1).otherwise(0)).cast("long").alias(f"c{i}")
                   for i, c in enumerate(cols)])
    parts = ", ".join(f"'{c}', '{df.schema[c].dataType.simpleString()}', c{i}" for i, c in enumerate(cols))
    return agg.selectExpr(f"stack({len(cols)}, {parts}) AS (column, dtype, non_null)")


def null_map(df: DataFrame, time_col: str, cols: Sequence[str] | None = None,
             unit: str = "month") -> DataFrame:
    """Missing cells by (column, time bucket): the numbers behind a heat map."""
    cols = [c for c in (cols or df.columns) if c != time_col]
    flags = df.select(F.date_trunc(unit, F.col(time_col)).cast("date").alias("bucket"),
                      *[F.when(_missing(df, c), 1).otherwise(0).alias(f"m{i}") for i, c in enumerate(cols)])
    agg = flags.groupBy("bucket").agg(*[F.sum(f"m{i}").cast("long").alias(f"m{i}") for i in range(len(cols))])
    parts = ", ".join(f"'{c}', m{i}" for i, c in enumerate(cols))
    return agg.selectExpr("bucket", f"stack({len(cols)}, {parts}) AS (column, n_missing)")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """``unique()``: distinct values, NULL kept as a value."""
    return df.select(col).distinct()


def count_distinct(df: DataFrame, col: str) -> DataFrame:
    """``nunique()``: NULL not counted."""
    return df.agg(F.countDistinct(col).alias("n_unique"))


def describe(df: DataFrame, col: str) -> DataFrame:
    """count, mean, *sample* std, min, quartiles, max, median (exact quantiles)."""
    q25, q50, q75 = exact_quantile_values(df, col, [0.25, 0.5, 0.75])
    x = F.col(col)
    base = df.filter(x.isNotNull() & ~F.isnan(x))
    return base.agg(F.count(F.lit(1)).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                    F.min(x).alias("min"), F.lit(q25).cast("double").alias("q25"),
                    F.lit(q50).cast("double").alias("q50"), F.lit(q75).cast("double").alias("q75"),
                    F.max(x).alias("max"), F.lit(q50).cast("double").alias("median"))


def value_counts(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """Top k values by count (descending; ties by value)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(col)).limit(k)


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram over [min, max], last bin closed; empty bins kept.

    The range is a one-row aggregate (broadcast, size 1); the bin counts are
    a partial aggregate into at most ``bins`` groups; empty bins come from a
    left join with ``range(bins)``.
    """
    x = F.col(col)
    base = df.select(x.cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    rng = base.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = F.col("hi") - F.col("lo")
    b = F.least(F.floor((F.col("x") - F.col("lo")) / width * F.lit(bins)).cast("int") + 1, F.lit(bins))
    b = F.when(width == 0, F.lit(1)).otherwise(b)
    counts = base.crossJoin(F.broadcast(rng)).select(b.alias("bin")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    edges = (spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
             .crossJoin(F.broadcast(rng))
             .select("bin",
                     (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") - 1) / F.lit(bins)).alias("lo_edge"),
                     (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / F.lit(bins)).alias("hi_edge")))
    # at most ``bins`` rows: a proven bound, broadcast
    return (edges.join(F.broadcast(counts), on="bin", how="left")
                 .select("bin", "lo_edge", "hi_edge", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def top_k(df: DataFrame, col: str, k: int = 3, largest: bool = False, id_col: str = "row_id") -> DataFrame:
    """nsmallest / nlargest: nulls excluded, ties by id (first occurrence)."""
    x = F.col(col)
    order = [x.desc() if largest else x.asc(), F.col(id_col).asc()]
    return df.filter(x.isNotNull() & ~F.isnan(x)).orderBy(*order).limit(k)


def head(df: DataFrame, k: int = 3, id_col: str = "row_id") -> DataFrame:
    return df.orderBy(id_col).limit(k)


# Knuth's multiplicative hash constant and 2^32: a repeatable permutation of
# ids that does not depend on partitioning (fixed values)
HASH_MULT = 2654435761
HASH_MOD = 4294967296
HASH_IDS = 1 << 30


def seeded_sample(df: DataFrame, n: int, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """Exactly min(n, rows) rows without replacement, the same rows under any
    partitioning and in SQL: the n smallest of a seeded hash of the id."""
    # the id is reduced first, so that the product fits a BIGINT for any id
    key = (F.pmod(F.col(id_col), F.lit(HASH_IDS)) * F.lit(HASH_MULT) + F.lit(seed)) % F.lit(HASH_MOD)
    return df.withColumn("_h", key).orderBy("_h", id_col).limit(n).drop("_h")
