"""Skew-safe per-entity sequence layout.

A plain ``Window.partitionBy(entity)`` puts every row of one entity in one
task; if one entity holds a third of the data that task holds a third of the
data. The helpers here split each entity into independent groups:

* ``with_positions`` numbers rows 0..n-1 inside each entity in two levels:
  a row_number inside ``(entity, time chunk)`` plus the count of all earlier
  chunks (a window over the small per-chunk count table).
* ``blocked`` cuts the numbered rows into fixed-size blocks of ``block`` rows
  and copies the ``before`` last rows of each block into the next block (and
  the ``after`` first rows into the previous one) as read-only halo rows, so a
  frame of up to ``before`` preceding / ``after`` following rows can be
  evaluated with ``partitionBy(entity, block)``.

Both cost one shuffle of the big side each; every group is bounded by the
chunk width (positions) or the block size (windows), never by entity size.

The layout is the same at every size. An entity that is bounded by the way its
rows are made (a panel aggregated to days has one row for each day) may be one
group instead (``whole``): one shuffle, no counts, no halo rows.

Rows with a null key belong to no entity and are dropped; rows with a null time come last in their entity, in chunks of the
first tiebreak, so an entity without any time is spread too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.columns import time_chunk

DEFAULT_BLOCK = 8192
NULL_CHUNK = (1 << 62)       # after every chunk of a real time
TIEBREAK_BITS = 12           # rows without a time: 4096 values of the tiebreak to a chunk
LAST_CHUNK = (1 << 63) - 1


def with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose entity keys are all present."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df


def in_order(xs: Sequence[str | Column]) -> list[Column]:
    """Ascending sort keys, nulls last."""
    return [(F.col(x) if isinstance(x, str) else x).asc_nulls_last() for x in xs]


def chunk_column(df: DataFrame, time_col: str, width: int | None, tiebreak: Sequence[str] = ()) -> Column:
    """Time chunk of a row, never null. Rows without a time come after all
    others, in chunks of their first tiebreak if that is a number (one without
    it comes last), else in one chunk."""
    from pyspark.sql import types as T

    if width is None:
        width = default_chunk_width(df, time_col)
    chunk = time_chunk(F.col(time_col), df.schema[time_col].dataType, width)
    after = F.lit(NULL_CHUNK)
    if tiebreak and isinstance(df.schema[tiebreak[0]].dataType, T.IntegralType):
        t = F.col(tiebreak[0]).cast("long")
        after = F.coalesce(F.lit(NULL_CHUNK) + F.shiftright(t, TIEBREAK_BITS), F.lit(LAST_CHUNK))
    return F.coalesce(chunk.cast("long"), after)


def default_chunk_width(df: DataFrame, time_col: str) -> int:
    from pyspark.sql import types as T
    dt = df.schema[time_col].dataType
    if isinstance(dt, T.DateType):
        return 64            # days: a daily panel gives <= 64 rows per group
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return 3600          # seconds
    return 1 << 16


def with_positions(df: DataFrame, keys: Sequence[str], time_col: str,
                   tiebreak: Sequence[str] = (), chunk_width: int | None = None,
                   pos_col: str = "pos") -> DataFrame:
    """Add a 0-based position of each row inside its ``keys`` group, ordered
    by ``(time_col, *tiebreak)``, without a per-entity single task.

    Row counts per (entity, chunk) come from a partial aggregate of the
    input; their running sum over chunks (a window over that small table)
    is each chunk's offset, joined back (AQE broadcasts it when it is
    measured small); one window over (entity, chunk) adds the row number.
    Rows with a null key are dropped; null times come last.
    """
    keys = list(keys)
    order = in_order([time_col, *tiebreak])
    d = with_keys(df, keys).withColumn("_ck", chunk_column(df, time_col, chunk_width, tiebreak))
    counts = d.groupBy(*keys, "_ck").agg(F.count(F.lit(1)).alias("_cnt"))
    prior = Window.partitionBy(*keys).orderBy("_ck").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_ck", F.coalesce(F.sum("_cnt").over(prior), F.lit(0)).alias("_off"))
    j = d.join(offsets, on=[*keys, "_ck"], how="inner")
    rn = F.row_number().over(Window.partitionBy(*keys, "_ck").orderBy(*order))
    return (j.withColumn(pos_col, (F.col("_off") + rn - 1).cast("long"))
             .drop("_ck", "_off"))


def blocked(df: DataFrame, pos_col: str = "pos", block: int = DEFAULT_BLOCK,
            before: int = 0, after: int = 0) -> DataFrame:
    """Assign ``_blk`` (home block) and copy boundary rows into neighbour
    blocks as halo rows (``_halo`` = true). Requires block >= before, after."""
    if block < max(before, after, 1):
        raise ValueError("block must be at least as large as the halo")
    p = F.col(pos_col)
    b = F.floor(p / F.lit(block)).cast("long")
    r = p - b * F.lit(block)
    home = F.struct(b.alias("blk"), F.lit(False).alias("halo"))
    nxt = F.when(r >= F.lit(block - before), F.struct((b + 1).alias("blk"), F.lit(True).alias("halo")))
    prv = F.when((r < F.lit(after)) & (b > 0), F.struct((b - 1).alias("blk"), F.lit(True).alias("halo")))
    copies = [home]
    if before > 0:
        copies.append(nxt)
    if after > 0:
        copies.append(prv)
    arr = F.filter(F.array(*copies), lambda x: x.isNotNull())
    return (df.withColumn("_cp", F.explode(arr))
              .withColumn("_blk", F.col("_cp.blk"))
              .withColumn("_halo", F.col("_cp.halo"))
              .drop("_cp"))


def block_window(keys: Sequence[str], pos_col: str = "pos") -> Window:
    return Window.partitionBy(*keys, "_blk").orderBy(pos_col)


def lead_lag(df: DataFrame, keys: Sequence[str], time_col: str, exprs: dict[str, tuple[str, int]],
             tiebreak: Sequence[str] = (), chunk_width: int | None = None,
             block: int = DEFAULT_BLOCK, keep_pos: str | None = None, whole: bool = False) -> DataFrame:
    """Skew-safe ``lead``/``lag``: ``exprs`` maps output name to
    ``(column, offset)``; offset > 0 is lead, < 0 is lag. ``keep_pos`` names
    a column to keep the row position in (for later block layouts). ``whole``:
    an entity is one group, for entities that are bounded by construction."""
    if whole:
        w = Window.partitionBy(*keys).orderBy(*in_order([time_col, *tiebreak]))
        cols = [(F.lead(c, off) if off > 0 else F.lag(c, -off)).over(w).alias(name) for name, (c, off) in exprs.items()]
        if keep_pos:
            cols.insert(0, (F.row_number().over(w) - 1).cast("long").alias(keep_pos))
        return with_keys(df, keys).select("*", *cols)
    before = max([-o for _, o in exprs.values() if o < 0], default=0)
    after = max([o for _, o in exprs.values() if o > 0], default=0)
    d = with_positions(df, keys, time_col, tiebreak, chunk_width, "_pos")
    d = blocked(d, "_pos", max(block, before, after), before, after)
    w = block_window(keys, "_pos")
    for name, (c, off) in exprs.items():
        fn = F.lead(c, off) if off > 0 else F.lag(c, -off)
        d = d.withColumn(name, fn.over(w))
    d = d.filter(~F.col("_halo")).drop("_blk", "_halo")
    return d.withColumnRenamed("_pos", keep_pos) if keep_pos else d.drop("_pos")
