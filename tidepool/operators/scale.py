"""Standard scaler fitted on the training part only.

Statistics are the per-column mean and *population* standard deviation with
the zero-variance rule of common scalers (divide by 1). Spark ML's
StandardScaler uses the sample std and maps constant columns to 0, so it is
not used here.

The fitted state is a one-row DataFrame (a global aggregate without grouping
has exactly one row whatever the data size), so broadcasting it is safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _m(c: str) -> str:
    return f"{c}__mean"


def _s(c: str) -> str:
    return f"{c}__std"


def scaler_fit(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: ``<c>__mean`` and ``<c>__std`` for each column (nulls ignored)."""
    aggs = []
    for c in cols:
        sd = F.stddev_pop(F.col(c))
        aggs += [F.avg(c).alias(_m(c)),
                 F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd).alias(_s(c))]
    return train.agg(*aggs)


def scaler_long(stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, mean, std): the persisted form of the fitted state."""
    stack = ", ".join(f"'{c}', `{_m(c)}`, `{_s(c)}`" for c in cols)
    return stats.selectExpr(f"stack({len(cols)}, {stack}) AS (column, mean, std)")


def scaler_wide(long_stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Back from (column, mean, std) to the one-row form."""
    aggs = []
    for c in cols:
        aggs += [F.max(F.when(F.col("column") == c, F.col("mean"))).alias(_m(c)),
                 F.max(F.when(F.col("column") == c, F.col("std"))).alias(_s(c))]
    return long_stats.agg(*aggs)


def _apply(df: DataFrame, stats: DataFrame, cols: Sequence[str], fn, suffix: str) -> DataFrame:
    joined = df.crossJoin(F.broadcast(stats))
    out = joined
    for c in cols:
        out = out.withColumn(c + suffix, fn(F.col(c), F.col(_m(c)), F.col(_s(c))))
    return out.drop(*[c for c in stats.columns if c not in df.columns])


def standardize(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / std


def unstandardize(z: Column, mean: Column, std: Column) -> Column:
    return z * std + mean


def scaler_transform(df: DataFrame, stats: DataFrame, cols: Sequence[str],
                     suffix: str = "") -> DataFrame:
    """(x - mean) / std for each column; ``suffix=''`` replaces in place."""
    return _apply(df, stats, cols, standardize, suffix)


def scaler_inverse(df: DataFrame, stats: DataFrame, cols: Sequence[str],
                   suffix: str = "") -> DataFrame:
    """z * std + mean; exact round trip of ``scaler_transform``."""
    return _apply(df, stats, cols, unstandardize, suffix)


def scaler_inverse_as(df: DataFrame, stats: DataFrame, stat_col: str,
                      mapping: dict[str, str]) -> DataFrame:
    """Inverse-transform several columns with the statistics of one column
    (e.g. every model's prediction with the target scaler): ``mapping`` is
    {input column: output column}."""
    joined = df.crossJoin(F.broadcast(stats.select(_m(stat_col), _s(stat_col))))
    for src, dst in mapping.items():
        joined = joined.withColumn(dst, unstandardize(F.col(src), F.col(_m(stat_col)), F.col(_s(stat_col))))
    return joined.drop(_m(stat_col), _s(stat_col))


def save_scaler(stats: DataFrame, cols: Sequence[str], path: str) -> None:
    """Persist the fitted state as a (column, mean, std) Parquet table."""
    scaler_long(stats, cols).write.mode("overwrite").parquet(path)


def load_scaler(spark, path: str, cols: Sequence[str]) -> DataFrame:
    """The one-row fitted state back from a saved table."""
    return scaler_wide(spark.read.parquet(path), cols)
