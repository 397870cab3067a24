"""Sinusoidal position features for sequences.

p(t, 2j) = sin(t * f_j), p(t, 2j + 1) = cos(t * f_j), f_j = exp(-2j ln(10000) / n).
Evaluated as a JVM expression over ``array<array<double>>`` (no join, no
shuffle). An odd feature count is rejected, as in the reference, where the
even columns outnumber the odd ones and the assignment fails.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = 10000.0  # fixed value


def _check(n: int) -> None:
    if n % 2:
        raise ValueError(f"position encoding needs an even feature count, got {n}")


def pe_value(t: Column, j: Column, n: int) -> Column:
    """Encoding at step t (0-based) and feature j (0-based)."""
    pair = j - (j % 2)                              # 2 * (j // 2)
    freq = F.exp(-pair.cast("double") * F.lit(math.log(BASE) / n))
    ang = t.cast("double") * freq
    return F.when(j % 2 == 0, F.sin(ang)).otherwise(F.cos(ang))


def add_position_encoding(seq: Column, n: int) -> Column:
    """seq[t][j] + p(t, j) for every step and feature."""
    _check(n)
    return F.transform(seq, lambda r, t: F.transform(r, lambda x, j: x + pe_value(t, j, n)))


def position_encoding_table(spark: SparkSession, look_back: int, n: int) -> DataFrame:
    """(pos, dim, pe) for inspection and tests: look_back x n rows."""
    _check(n)
    return (spark.range(look_back).withColumnRenamed("id", "pos")
                 .crossJoin(spark.range(n).withColumnRenamed("id", "dim"))
                 .select(F.col("pos").cast("int").alias("pos"), F.col("dim").cast("int").alias("dim"),
                         pe_value(F.col("pos"), F.col("dim"), n).alias("pe")))
