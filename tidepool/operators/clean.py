"""Dataset build: parse, join, prune, clean, forward fill, trim."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.columns import non_finite_to_null
from tidepool.operators.sequence import chunk_column, in_order, with_keys


# ------------------------------------------------------------------ projections

def drop_columns(df: DataFrame, cols: Sequence[str], strict: bool = False) -> DataFrame:
    """Drop columns. ``strict=False`` ignores names that are absent;
    ``strict=True`` raises KeyError listing them (both reference behaviours)."""
    missing = [c for c in cols if c not in df.columns]
    if strict and missing:
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*[c for c in cols if c in df.columns])


def inf_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """+-Inf and NaN become NULL in floating columns (Spark keeps NaN apart
    from NULL; the reference has one missing marker)."""
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    target = [c for c in (cols or df.columns) if c in fl]
    return df.select(*[non_finite_to_null(F.col(c)).alias(c) if c in target else F.col(c)
                       for c in df.columns])


def parse_dates(df: DataFrame, col: str, strict: bool = True, out: str | None = None) -> DataFrame:
    """ISO-8601 text -> timestamp in UTC. ``strict`` raises on a bad value (ANSI
    ``to_timestamp``); otherwise bad values become NULL (``try_to_timestamp``)
    for quarantine."""
    parse = F.to_timestamp if strict else F.try_to_timestamp
    return df.withColumn(out or col, parse(F.col(col)))


def quarantine_dates(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """(good rows with parsed timestamp, rows whose text does not parse)."""
    p = df.withColumn("_ts", F.try_to_timestamp(F.col(col)))
    good = p.filter(F.col("_ts").isNotNull()).withColumn(col, F.col("_ts")).drop("_ts")
    bad = p.filter(F.col("_ts").isNull() & F.col(col).isNotNull()).drop("_ts")
    return good, bad


# ------------------------------------------------------------------ join

def left_join_macro(panel: DataFrame, macro: DataFrame, on: str = "date",
                    suffixes: tuple[str, str] = ("_x", "_y"),
                    broadcast_max_rows: int | None = None) -> DataFrame:
    """Left equi-join of the entity panel to a shared daily table.

    Clashing non-key names get the pandas suffixes. Duplicate macro dates fan
    out, and a missing date matches a missing date (pandas' rule). The join strategy is Spark's: AQE turns it into a broadcast hash
    join when the shuffled macro side is measured below the broadcast
    threshold, otherwise it stays a sort-merge join. ``broadcast_max_rows``
    forces a broadcast only after a bounded count confirms the size.
    """
    clash = (set(panel.columns) & set(macro.columns)) - {on}
    p = panel.select(*[F.col(c).alias(c + suffixes[0]) if c in clash else F.col(c) for c in panel.columns])
    m = macro.select(*[F.col(c).alias(c + suffixes[1]) if c in clash else F.col(c) for c in macro.columns])
    if broadcast_max_rows is not None and has_at_most(m, broadcast_max_rows):
        m = F.broadcast(m)
    m = m.withColumnRenamed(on, "_on")
    return p.join(m, p[on].eqNullSafe(m["_on"]), "left").drop("_on").select(
        on, *[c for c in p.columns if c != on], *[c for c in m.columns if c != "_on"])


def has_at_most(df: DataFrame, n: int) -> bool:
    """Bounded size check: reads at most n + 1 rows."""
    return df.limit(n + 1).count() <= n


# ------------------------------------------------------------------ forward fill

def ffill(df: DataFrame, keys: Sequence[str], time_col: str, cols: Sequence[str] | None = None,
          tiebreak: Sequence[str] = (), chunk_width: int | None = None) -> DataFrame:
    """Forward fill per entity in time order, skew-safe.

    Level 1: ``last(c, ignorenulls)`` inside (entity, time chunk).
    Level 2: the last non-null value of each chunk (``max_by`` over the time
    order, a partial aggregate of the input, one row per chunk) is carried
    into later chunks by a window over that small table and joined in on
    (entity, chunk); one window over (entity, chunk) does the rest.
    Rows with a null entity key are dropped (the reference loops over key
    values with an equality filter, which never matches null); rows with a
    null time sort last in their entity, so nothing is filled from them.
    """
    keys = list(keys)
    cols = [c for c in (cols or df.columns) if c not in keys + [time_col, *tiebreak]]
    order = in_order([time_col, *tiebreak])
    d = with_keys(df, keys).withColumn("_ck", chunk_column(df, time_col, chunk_width, tiebreak))
    # nulls last in a struct: a marker before each value
    ordering = F.struct(*[x for c in [time_col, *tiebreak] for x in (F.col(c).isNull(), F.col(c))])
    last_of_chunk = d.groupBy(*keys, "_ck").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), ordering)).alias(c) for c in cols])
    prior = Window.partitionBy(*keys).orderBy("_ck").rowsBetween(Window.unboundedPreceding, -1)
    carry = last_of_chunk.select(*keys, "_ck",
                                 *[F.last(c, ignorenulls=True).over(prior).alias(f"_in_{c}") for c in cols])
    j = d.join(carry, on=[*keys, "_ck"], how="inner")
    w = Window.partitionBy(*keys, "_ck").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return j.select(*[F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_in_{c}")).alias(c)
                      if c in cols else F.col(c) for c in df.columns])


def ffill_dropna(df: DataFrame, keys: Sequence[str], time_col: str, cols: Sequence[str] | None = None,
                 tiebreak: Sequence[str] = (), chunk_width: int | None = None) -> DataFrame:
    """Forward fill then drop every row that still has a null (leading gaps)."""
    return ffill(df, keys, time_col, cols, tiebreak, chunk_width).na.drop("any")


# ------------------------------------------------------------------ extremes and trim

def extreme_rows(df: DataFrame, col: str) -> DataFrame:
    """Rows whose ``col`` equals the global min or max, tagged ``extreme``; of
    a constant column every row is both, and comes once for each.

    The min/max is a one-row aggregate, joined by broadcast (size 1 by
    construction)."""
    mm = df.agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    j = df.crossJoin(F.broadcast(mm))
    return (j.filter((F.col(col) == F.col("_mn")) | (F.col(col) == F.col("_mx")))
             .withColumn("extreme", F.explode(F.array_compact(F.array(
                 F.when(F.col(col) == F.col("_mn"), "min"), F.when(F.col(col) == F.col("_mx"), "max")))))
             .drop("_mn", "_mx"))


def quantile_trim(df: DataFrame, col: str, lower: float = 0.01, upper: float = 0.99,
                  bounds: DataFrame | None = None) -> DataFrame:
    """Keep rows strictly inside the global (lower, upper) quantiles of ``col``.

    ``bounds`` is a one-row DataFrame (q_lo, q_hi); by default the exact
    distributed quantiles of ``tidepool.operators.quantile``.
    """
    from tidepool.operators.quantile import exact_quantiles
    if bounds is None:
        bounds = exact_quantiles(df, col, [lower, upper], names=["_q_lo", "_q_hi"])
    else:
        bounds = bounds.toDF("_q_lo", "_q_hi")
    j = df.crossJoin(F.broadcast(bounds))
    return (j.filter((F.col(col) > F.col("_q_lo")) & (F.col(col) < F.col("_q_hi")))
             .drop("_q_lo", "_q_hi"))

