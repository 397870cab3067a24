"""Look-back windows and last-N selection.

``lookback_windows``: for each row at position i >= L of an entity (and
split), the feature vectors of rows i-L .. i-1 and the row's own label and
id -- the window never contains its target row. Features are packed into one
``array<double>`` before the shuffle so the L-fold blow-up applies to a
compact column, and the layout is the skew-safe block layout of
``tidepool.operators.sequence``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators.sequence import DEFAULT_BLOCK, block_window, blocked, in_order, with_keys, with_positions


def pack_features(cols: Sequence[str]):
    return F.array(*[F.col(c).cast("double") for c in cols])


def lookback_windows(df: DataFrame, keys: Sequence[str], time_col: str, features: Sequence[str],
                     look_back: int = 20, id_col: str = "row_id", carry: Sequence[str] = (),
                     seq_col: str = "seq", row_col: str = "x_row",
                     block: int = DEFAULT_BLOCK, chunk_width: int | None = None) -> DataFrame:
    """Windows of ``look_back`` preceding rows per ``keys`` group.

    Output: keys, time, id, ``carry`` columns (e.g. the label), ``seq``
    (array of ``look_back`` feature arrays, oldest first) and ``x_row`` (the
    target row's own features). Groups with <= L rows give no window.
    Ties in time are ordered by ``id_col``; rows with a null key are dropped,
    rows with a null time come last in their entity.
    """
    keys = list(keys)
    base = df.select(*keys, time_col, id_col, *carry, pack_features(features).alias(row_col))
    d = with_positions(base, keys, time_col, [id_col], chunk_width)
    d = blocked(d, "pos", max(block, look_back), before=look_back)
    w = block_window(keys).rowsBetween(-look_back, -1)
    # collect the packed arrays (never null), so the length counts rows even
    # when a feature value is null
    d = d.withColumn(seq_col, F.collect_list(row_col).over(w))
    return (d.filter(~F.col("_halo") & (F.size(seq_col) == look_back))
             .drop("_blk", "_halo", "pos"))


def window_feature(seq_col: str, idx: int, how: str, look_back: int):
    """A scalar from one feature of a window, JVM-side (higher-order functions):
    ``mean``, ``first`` (oldest), ``last`` (newest), ``sum``, ``min``, ``max``."""
    s = F.col(seq_col)
    if how == "first":
        return F.element_at(s, 1)[idx]
    if how == "last":
        return F.element_at(s, -1)[idx]
    if how in ("sum", "mean"):
        tot = F.aggregate(s, F.lit(0.0).cast("double"), lambda acc, x: acc + x[idx])
        return tot / F.lit(float(look_back)) if how == "mean" else tot
    if how == "min":
        return F.array_min(F.transform(s, lambda x: x[idx]))
    if how == "max":
        return F.array_max(F.transform(s, lambda x: x[idx]))
    raise ValueError(how)


def last_n(df: DataFrame, n: int, order_cols: Sequence[str]) -> DataFrame:
    """Newest ``n`` rows by ``order_cols`` descending (FIFO window of size n).

    An ordered limit: each partition keeps its own top n, then n x partitions
    rows are merged -- bounded by n, never a full sort or a single-task window.
    """
    return df.orderBy(*[F.col(c).desc() for c in order_cols]).limit(n)


SUMMARY_HOW = ("mean", "sum", "min", "max", "first", "last")


def _frame_columns(w: Window, row_col: str, seq_col: str, time_col: str, look_back: int,
                   extra: dict, summaries: dict, collect: bool) -> list[Column]:
    fr = w.rowsBetween(-look_back, -1)
    cols = [F.count(F.lit(1)).over(fr).alias("_n"), F.lag(time_col, look_back).over(w).alias("_t0")]
    if collect:
        cols.append(F.collect_list(row_col).over(fr).alias(seq_col))
    for name, (feat, how) in summaries.items():
        x = F.col(feat)
        e = {"mean": lambda: F.avg(x).over(fr), "sum": lambda: F.sum(x).over(fr),
             "min": lambda: F.min(x).over(fr), "max": lambda: F.max(x).over(fr),
             "first": lambda: F.lag(x, look_back).over(w), "last": lambda: F.lag(x, 1).over(w)}[how]()
        cols.append(e.alias(name))
    cols += [fn(w).alias(name) for name, fn in extra.items()]
    return cols


def sequence_frame(df: DataFrame, keys: Sequence[str], time_col: str, features: Sequence[str],
                   look_back: int = 20, id_col: str = "row_id", extra: dict | None = None, after: int = 0,
                   seq_col: str = "seq", row_col: str = "x_row", block: int = DEFAULT_BLOCK,
                   chunk_width: int | None = None, pos_col: str | None = None,
                   summaries: dict | None = None, collect: bool = True, whole: bool = False) -> DataFrame:
    """Every row of ``df`` with its look-back window: ``seq`` (up to L
    preceding rows of the entity, oldest first; ``collect=False`` skips it),
    ``summaries`` (name -> (feature, how) with how in mean / sum / min / max /
    first / last over the same L rows, plain window aggregates without
    arrays; nulls are skipped), ``_n`` (rows in the window), ``_t0`` (time of
    the oldest window row) and any ``extra`` per-entity window expressions
    (name -> function(window) -> Column, e.g. a label from ``lead``; rows
    needed after the current one are given by ``after``).

    One position pass and one block layout (skew-safe); with ``pos_col`` the
    rows already carry their position and only the block shuffle is needed.
    ``whole``: an entity is one group, for entities that are bounded by
    construction; positions and blocks are not needed then.
    """
    keys = list(keys)
    extra = extra or {}
    summaries = summaries or {}
    base = df.select(*df.columns, pack_features(features).alias(row_col)) if collect else df
    if whole:
        d = with_keys(base, keys)
        w = Window.partitionBy(*keys).orderBy(*in_order([time_col, id_col]))
        return d.select("*", *_frame_columns(w, row_col, seq_col, time_col, look_back, extra, summaries, collect))
    if pos_col is None:
        d = with_positions(base, keys, time_col, [id_col], chunk_width)
    else:
        d = with_keys(base, keys).withColumnRenamed(pos_col, "pos")
    d = blocked(d, "pos", max(block, look_back, after), before=look_back, after=after)
    w = block_window(keys)
    cols = _frame_columns(w, row_col, seq_col, time_col, look_back, extra, summaries, collect)
    return d.select(*d.columns, *cols).filter(~F.col("_halo")).drop("_blk", "_halo", "pos")


def windows_in_intervals(frame: DataFrame, time_col: str, intervals: dict, look_back: int = 20,
                         seq_col: str = "seq", split_col: str = "split") -> DataFrame:
    """Windows per (entity, split) when every split is a time interval.

    ``intervals`` maps split name to (lo, hi) ISO bounds (None = open); a row
    belongs to every interval holding its time (independent predicates, so
    overlaps and gaps are kept as given). An interval is contiguous in time
    order, so "the L preceding rows of the same entity and split" are exactly
    the L preceding rows of the entity when the oldest of them lies inside
    the same interval. Output: one row per (row, split) with a full window.
    """
    t, t0 = F.col(time_col), F.col("_t0")
    dtype = frame.schema[time_col].dataType

    def inside(c, lo, hi):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (c >= F.lit(lo).cast(dtype))
        if hi is not None:
            cond = cond & (c < F.lit(hi).cast(dtype))
        return cond

    tags = F.array(*[F.when(inside(t, lo, hi) & inside(t0, lo, hi), F.lit(name))
                     for name, (lo, hi) in intervals.items()])
    return (frame.filter(F.col("_n") == look_back)
                 .withColumn(split_col, F.explode(F.filter(tags, lambda x: x.isNotNull())))
                 .drop("_t0", "_n"))


def scale_sequences(seq: Column, means: Sequence[Column], stds: Sequence[Column]) -> Column:
    """Standardise every step of ``array<array<double>>`` with per-feature
    statistics (JVM higher-order functions). A step of the expected width is
    written out: the general form builds both statistics arrays for every value."""
    m = F.array(*means)
    s = F.array(*stds)

    def step(r: Column) -> Column:
        known = F.array(*[(r[j] - means[j]) / stds[j] for j in range(len(means))])
        return F.when(F.size(r) == len(means), known).otherwise(F.transform(r, lambda x, j: (x - m[j]) / s[j]))

    return F.transform(seq, step)
