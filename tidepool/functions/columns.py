"""Column helpers: feature lists, finiteness tests, time chunks, rounding."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType,
                 T.ByteType, T.DecimalType)
FLOATING_TYPES = (T.DoubleType, T.FloatType)

POS_INF = float("inf")
NEG_INF = float("-inf")


def feature_columns(columns: Iterable[str], targets: Iterable[str] = (),
                    keys: Sequence[str] = ("ticker", "date"),
                    exclude: Sequence[str] = ("row_id",)) -> list[str]:
    """Features by exclusion: every column that is not a target, key or id.

    The row id is excluded by default (an index column must not leak in as a
    feature); pass ``exclude=()`` to keep it.
    """
    drop = set(targets) | set(keys) | set(exclude)
    return [c for c in columns if c not in drop]


def is_finite(c: Column) -> Column:
    """True for ordinary numbers; false for NaN and +-Inf; null stays null."""
    return ~F.isnan(c) & (c != F.lit(POS_INF)) & (c != F.lit(NEG_INF))


def non_finite_to_null(c: Column) -> Column:
    """NaN / +-Inf become SQL NULL (Spark keeps NaN and NULL apart)."""
    return F.when(is_finite(c), c)


def time_chunk(c: Column, dtype: T.DataType, width: int) -> Column:
    """Integer bucket of a time column: ``width`` days for dates, seconds otherwise.

    Used to split one entity's rows into independent groups so that a hot
    entity never lands in a single task.
    """
    if isinstance(dtype, T.DateType):
        return F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / F.lit(width))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(width * 1_000_000))
    if isinstance(dtype, NUMERIC_TYPES):
        return F.floor(c / F.lit(width))
    # strings (ISO dates) order lexically; bucket on the parsed timestamp
    return F.floor(F.unix_micros(F.to_timestamp(c)) / F.lit(width * 1_000_000))
