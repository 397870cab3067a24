"""Quantiles: exact by selection, approximate by mergeable sketches.

Exact. Spark's ``percentile`` merges a value->count map of the whole column in
one task, and a sort of the column for a few ranks is a shuffle of all of it.
Here the ranks are selected:

1. one aggregate counts the column and asks a bounded sketch for values a little
   below and above each needed rank;
2. one aggregate counts, for these intervals, the rows below and inside;
3. an interval that holds its ranks and few rows is read as (value, count); one
   with many rows is narrowed again, by a sketch of its own rows.

Nothing but partial aggregates is shuffled: no sort, and no row of the column.
The sketch only proposes; the counts decide, so the result is exact whatever
the sketch's error. Position h = (n - 1) * p, result
x[floor h] + (h - floor h) * (x[ceil h] - x[floor h]), the rule of pandas,
NumPy, Spark ``percentile`` and DuckDB ``quantile_cont``. NULL and NaN are
skipped.

Approximate (opt-in). ``quantile_sketches`` writes a KLL sketch for each group,
a table of bounded rows that merges over groups, days or runs;
``sketch_quantiles`` reads quantiles off it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEW = 100_000       # values gathered at once
ACCURACY = 10_000   # of the proposing sketch: its rank error is n / ACCURACY


def _values(df: DataFrame, col: str) -> DataFrame:
    x = F.col(col).cast("double")
    return df.select(x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))


def _inside(a: float | None, b: float | None) -> Column:
    """a <= x <= b; None is open. -0.0 and 0.0 are one value."""
    ok = F.lit(True)
    if a is not None:
        ok = ok & (F.col("x") >= F.lit(a))
    return ok if b is None else ok & (F.col("x") <= F.lit(b))


def _propose(values: DataFrame, wanted: list[tuple[Column, list[float]]]) -> list[list[float]]:
    """For each (condition, shares): sketched values at these shares of the rows that fulfil it, in one aggregate."""
    row = values.agg(*[F.percentile_approx(F.when(c, F.col("x")), s, ACCURACY).alias(f"q{i}") for i, (c, s) in enumerate(wanted)]).first()
    return [list(row[i]) for i in range(len(wanted))]


def select_ranks(values: DataFrame, ranks: Sequence[int], n: int, few: int = FEW) -> dict[int, float]:
    """Value at each 0-based rank of the column x of ``values`` (n rows, no null or NaN)."""
    ranks, found = sorted(set(ranks)), {}
    # (low, high, ranks): an interval of values and the ranks looked for in it
    open_: list[tuple[float | None, float | None, list[int], int, int]] = [(None, None, ranks, 0, n)]
    while open_:
        small = [iv for iv in open_ if iv[4] <= few or iv[0] is not None and iv[0] == iv[1]]
        large = [iv for iv in open_ if iv not in small]
        open_ = []
        for a, b, rs, below, _ in [iv for iv in small if iv[0] is not None and iv[0] == iv[1]]:
            found |= {r: a for r in rs}
        read = [iv for iv in small if not (iv[0] is not None and iv[0] == iv[1])]
        if read:        # few rows each, and two intervals for a rank at most: bounded
            any_of = F.lit(False)
            for a, b, *_ in read:
                any_of = any_of | _inside(a, b)
            rows = values.filter(any_of).groupBy("x").agg(F.count(F.lit(1)).alias("c")).collect()
            rows.sort(key=lambda r: r["x"])
            for a, b, rs, below, _ in read:
                at = below
                for x, c in rows:
                    if (a is None or x >= a) and (b is None or x <= b):
                        found |= {r: x for r in rs if at <= r < at + c}
                        at += c
        if not large:
            continue
        # narrow: values just around each rank by a sketch, then true counts
        margin = 2.0 / ACCURACY
        asked = []
        for a, b, rs, below, size in large:
            shares = [s for r in rs for s in (max(0.0, (r - below) / size - margin), min(1.0, (r + 1 - below) / size + margin))]
            asked.append((_inside(a, b), shares))
        proposed = []
        for (a, b, rs, below, size), qs in zip(large, _propose(values, asked)):
            for i, r in enumerate(rs):
                proposed.append((a, b, below, size, qs[2 * i], qs[2 * i + 1], r))
        counts = values.agg(*[c for i, (_, _, _, _, lo, hi, _) in enumerate(proposed) for c in (
            F.count(F.when(F.col("x") < F.lit(lo), True)).alias(f"b{i}"), F.count(F.when(_inside(lo, hi), True)).alias(f"i{i}"))]).first()
        for i, (a, b, below, size, lo, hi, r) in enumerate(proposed):
            under, held = counts[f"b{i}"], counts[f"i{i}"]
            if under <= r < under + held and held < size:
                open_.append((lo, hi, [r], under, held))
            else:           # the sketch missed, or one value fills the interval: halve it by counts
                open_.append(_halved(values, a, b, r, below, size))
    return found


def _halved(values: DataFrame, a: float | None, b: float | None, r: int, below: int, size: int):
    """The interval cut at a value of its own: below it, it alone, or above it."""
    mid = values.filter(_inside(a, b)).agg(F.percentile_approx("x", 0.5, ACCURACY)).first()[0]
    low = values.filter(_inside(a, b)).agg(F.count(F.when(F.col("x") < mid, True)), F.count(F.when(F.col("x") == mid, True)),
                                           F.max(F.when(F.col("x") < mid, F.col("x"))), F.min(F.when(F.col("x") > mid, F.col("x")))).first()
    if r < below + low[0]:
        return a, low[2], [r], below, low[0]
    if r < below + low[0] + low[1]:
        return mid, mid, [r], below + low[0], low[1]
    return low[3], b, [r], below + low[0] + low[1], size - low[0] - low[1]


def exact_quantile_values(df: DataFrame, col: str, probs: Sequence[float], few: int = FEW) -> list[float | None]:
    values = _values(df, col)
    n = values.count()
    if n == 0:
        return [None for _ in probs]
    need = []
    for p in probs:
        h = (n - 1) * float(p)
        need.append((h, int(math.floor(h)), int(math.ceil(h))))
    at = select_ranks(values, [r for _, a, b in need for r in (a, b)], n, few)
    return [at[a] + (h - a) * (at[b] - at[a]) for h, a, b in need]


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], names: Sequence[str] | None = None,
                    **kw) -> DataFrame:
    """One-row DataFrame of exact quantiles (safe to broadcast: one row)."""
    names = list(names or [f"q{int(round(p * 100)):02d}" for p in probs])
    vals = exact_quantile_values(df, col, probs, **kw)
    schema = T.StructType([T.StructField(nm, T.DoubleType()) for nm in names])
    return df.sparkSession.createDataFrame([tuple(vals)], schema)


# ------------------------------------------------------------------ opt-in: mergeable sketches

def quantile_sketches(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), k: int = 400) -> DataFrame:
    """(keys..., column, sketch): a KLL sketch for every group and column; one
    without values has a null sketch. The rank error of a single quantile is
    about 2 / k of the rows with 99 % confidence (k = 400: half a percent)."""
    num = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    agg = df.groupBy(*keys).agg(*[F.when(F.count(num(c)) > 0, F.kll_sketch_agg_double(num(c), k)).alias(f"s{i}") for i, c in enumerate(cols)])
    cells = ", ".join(f"'{c}', s{i}" for i, c in enumerate(cols))
    return agg.selectExpr(*keys, f"stack({len(cols)}, {cells}) AS (column, sketch)")


def merge_sketches(sketches: DataFrame, keys: Sequence[str] = (), k: int = 400) -> DataFrame:
    """The sketches of coarser ``keys`` (none: of the whole table) from finer ones."""
    return sketches.filter("sketch IS NOT NULL").groupBy(*keys, "column").agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, probs: Sequence[float]) -> DataFrame:
    """The sketch table with n (values seen) and quantiles (array, as ``probs``)."""
    q = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for p in probs])
    return sketches.withColumn("n", F.coalesce(F.kll_sketch_get_n_double("sketch"), F.lit(0))).withColumn(
        "quantiles", F.when(F.col("sketch").isNotNull(), q)).drop("sketch")
