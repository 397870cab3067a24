"""Checks and reshaping of request sequences ``array<array<double>>``.

All are JVM higher-order functions on the row (``exists``, ``forall``,
``transform``, ``flatten``); no Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# error codes, in the order the checks apply
NULL_VALUE = "null_value"       # a missing step or value (schema rejects it)
RAGGED = "ragged"               # steps of different widths (no matrix)
BAD_LENGTH = "bad_length"       # number of steps != look-back
NON_FINITE = "non_finite"       # NaN or +-Inf anywhere
BAD_WIDTH = "bad_width"         # uniform width != feature count


def _non_finite(x: Column) -> Column:
    return F.isnan(x) | (x == F.lit(float("inf"))) | (x == F.lit(float("-inf")))


def sequence_error(seq: Column, look_back: int, width: int) -> Column:
    """First failing check as an error code, NULL for a valid sequence. Most
    sequences are valid, so that is asked first, with one pass over the values;
    the checks by step and value run on the others."""
    has_null = seq.isNull() | F.exists(seq, lambda r: r.isNull() | F.exists(r, lambda x: x.isNull()))
    flat, width_each = F.flatten(seq), F.forall(seq, lambda r: F.size(r) == F.lit(width))
    # compiled loops over the flat values; array_contains is null if a value is missing
    clean = ~F.array_contains(flat, F.lit(float("nan"))) & ~F.array_contains(flat, F.lit(float("inf"))) \
        & ~F.array_contains(flat, F.lit(float("-inf")))
    valid = F.coalesce(clean & (F.size(seq) == F.lit(look_back)) & width_each, F.lit(False))
    w0 = F.size(F.element_at(seq, 1))
    ragged = ~F.forall(seq, lambda r: F.size(r) == w0)
    non_finite = F.exists(seq, lambda r: F.exists(r, _non_finite))
    return (F.when(valid & F.lit(look_back > 0), F.lit(None).cast("string"))
             .when(has_null, F.lit(NULL_VALUE))
             .when(F.size(seq) == 0, F.lit(BAD_LENGTH))
             .when(ragged, F.lit(RAGGED))
             .when(F.size(seq) != F.lit(look_back), F.lit(BAD_LENGTH))
             .when(non_finite, F.lit(NON_FINITE))
             .when(w0 != F.lit(width), F.lit(BAD_WIDTH)))


def validate_sequences(df: DataFrame, seq_col: str = "sequence", look_back: int = 20,
                       width: int = 68, error_col: str = "error_code") -> DataFrame:
    """Adds ``error_code`` (NULL when valid)."""
    return df.withColumn(error_col, sequence_error(F.col(seq_col), look_back, width))


def split_valid(df: DataFrame, error_col: str = "error_code") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(error_col).isNull()), df.filter(F.col(error_col).isNotNull())


def last_step(seq: Column) -> Column:
    """The newest time step (what a row model is served)."""
    return F.element_at(seq, -1)


def flatten_named(df: DataFrame, seq_col: str, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Row-major flatten, long form (ids..., position, name, value): the
    first ``len(names)`` positions take the given names, later ones
    ``feature_<position>``. Only the named ones can meet reference columns."""
    names_arr = F.array(*[F.lit(n) for n in names])
    flat = df.select(*keep, F.posexplode(F.flatten(F.col(seq_col))).alias("position", "value"))
    name = F.when(F.col("position") < F.lit(len(names)), F.element_at(names_arr, F.col("position") + 1)) \
            .otherwise(F.concat(F.lit("feature_"), F.col("position").cast("string")))
    return flat.select(*keep, F.col("position").cast("int").alias("position"), name.alias("name"), "value")
