"""Drift of many current windows against one stored reference summary.

``reference_summary`` reads the reference once and keeps, for each column, its
distinct values with their counts. ``windows_drift`` compares any number of
windows (rows with a window key) with it in one job, with the statistics of
``tidepool.operators.drift``: no second scan of the reference, and its cost
does not grow with the number of windows times the reference.

* KS. Between two values of a window its distribution function is constant and
  the reference's is monotone, so the largest gap lies at a value of the window:
  right of it or just left of it. Only the reference counts below and up to
  those values are needed.
* Wasserstein. The distance is the integral of |Q_ref(u) - Q_cur(u)| over u. The
  i-th of m window values covers u from (i - 1) / m to i / m, so its share
  follows from the reference's running sums at these two ranks and at the value
  itself. The ranks depend on m alone, so windows of one size share them.
* JS. Categories that the window lacks add ln 2 / 2 times their reference share.

Groups are bounded: windows are of bounded size by definition, and the running
sums over the reference's values are in two levels (``ordered_cumsum``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators.drift import (CRITICAL_SHARE, DATASET_THRESHOLD, DISTANCE_THRESHOLD, KS_P, ks_pvalue,
                                      ordered_cumsum)

SUMMARY = "column string, x double, v string, c long"


def _long(df: DataFrame, keep: Sequence[str], numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """(keep..., column, x, v): a row for each value; NULL and NaN are left out."""
    cells = [f"'{c}', CAST(`{c}` AS DOUBLE), CAST(NULL AS STRING)" for c in numeric]
    cells += [f"'{c}', CAST(NULL AS DOUBLE), CAST(`{c}` AS STRING)" for c in categorical]
    long = df.selectExpr(*keep, f"stack({len(cells)}, {', '.join(cells)}) AS (column, x, v)")
    return long.filter((F.col("x").isNotNull() & ~F.isnan("x")) | F.col("v").isNotNull())


def reference_summary(ref: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """(column, x, v, c): the distinct values of numeric (x) and categorical
    (v) columns with their counts. Write it as a table and use it for every check."""
    return _long(ref, [], numeric, categorical).groupBy("column", "x", "v").agg(F.count(F.lit(1)).alias("c"))


def _method_of(numeric: Sequence[str], categorical: Sequence[str], method: dict[str, str] | None) -> Column:
    method = method or {}
    unknown = set(method.values()) - {"ks", "wasserstein"}
    if unknown:
        raise ValueError(f"unknown drift method: {sorted(unknown)}")
    pairs = [(c, method.get(c, "ks")) for c in numeric] + [(c, "js") for c in categorical]
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


def windows_drift(summary: DataFrame, windows: DataFrame, key: str, numeric: Sequence[str],
                  categorical: Sequence[str] = (), method: dict[str, str] | None = None,
                  ks_p: float = KS_P, distance_threshold: float = DISTANCE_THRESHOLD) -> DataFrame:
    """(key, column, method, n_ref, n_cur, stat, p_value, threshold, status,
    drifted) for every window and column, as ``drift_columns`` gives them for
    one window. ``windows`` has a row for each record of each window; every
    window fits a task."""
    cols = [*numeric, *categorical]
    methods = _method_of(numeric, categorical, method)
    of = lambda kind: [c for c in numeric if (method or {}).get(c, "ks") == kind]
    summary = summary.filter(F.col("column").isin(cols))
    cur = _long(windows, [f"`{key}` AS _k"], numeric, categorical).groupBy("_k", "column", "x", "v").agg(
        F.count(F.lit(1)).alias("c"))
    is_number = F.col("v").isNull()
    spread = summary.groupBy("column").agg(                       # a row for each column: bounded by the schema
        F.sum("c").alias("n_ref"), (F.sum(F.col("c") * F.col("x")) / F.sum("c")).alias("_mean"))
    spread = summary.join(F.broadcast(spread), "column").groupBy("column").agg(
        F.first("n_ref").alias("n_ref"),
        F.sqrt(F.sum(F.col("c") * F.pow(F.col("x") - F.col("_mean"), F.lit(2))) / F.first("n_ref")).alias("_sd"))
    # reference counts and sums up to every value of any window: one pass over the summary
    points = summary.filter(is_number).select("column", "x", "c", (F.col("x") * F.col("c")).alias("s")).unionByName(
        cur.filter(is_number).select("column", "x", F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("s")))
    points = points.groupBy("column", "x").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
    points = ordered_cumsum(points, ["column"], "x", ["c", "s"])
    at_value = points.select("column", "x", F.col("cum_c").alias("_le"), F.col("c").alias("_eq"), F.col("cum_s").alias("_sum"))
    inside = Window.partitionBy("_k", "column").orderBy("x")
    numbers = (cur.filter(is_number).join(at_value, ["column", "x"]).join(F.broadcast(spread), "column", "left")
                  .withColumn("_hi", F.sum("c").over(inside)).withColumn("_n", F.sum("c").over(Window.partitionBy("_k", "column")))
                  .withColumn("_lo", F.col("_hi") - F.col("c")))
    n, m = F.col("n_ref"), F.col("_n")
    gap = F.greatest(F.abs(F.col("_le") / n - F.col("_hi") / m), F.abs((F.col("_le") - F.col("_eq")) / n - F.col("_lo") / m))
    ks = numbers.filter(F.col("column").isin(of("ks"))).groupBy("_k", "column").agg(F.max(gap).alias("stat"))
    w = _wasserstein(numbers.filter(F.col("column").isin(of("wasserstein"))), points.filter(F.col("column").isin(of("wasserstein"))))
    shares = cur.filter(~is_number).join(summary.filter(~is_number).select("column", "v", F.col("c").alias("_r")), ["column", "v"], "left")
    shares = shares.join(F.broadcast(spread), "column", "left").withColumn("_n", F.sum("c").over(Window.partitionBy("_k", "column")))
    p, q = F.coalesce(F.col("_r"), F.lit(0)) / n, F.col("c") / m
    part = lambda a: F.when(a > 0, a * F.log(a * 2 / (p + q))).otherwise(F.lit(0.0))
    js = shares.groupBy("_k", "column").agg(
        (F.sum(part(p) + part(q)) / 2 + (1 - F.sum(p)) * F.log(F.lit(2.0)) / 2).alias("stat"))
    js = js.select("_k", "column", F.sqrt(F.greatest("stat", F.lit(0.0))).alias("stat"))
    # every window has a row for every column, also where one side has no value
    sizes = cur.groupBy("_k", "column").agg(F.sum("c").alias("n_cur"))
    grid = windows.select(F.col(f"`{key}`").alias("_k")).distinct().select(
        "_k", F.explode(F.array(*[F.lit(c) for c in cols])).alias("column"))
    out = grid.join(sizes, ["_k", "column"], "left").join(F.broadcast(spread), "column", "left").join(
        ks.unionByName(w).unionByName(js), ["_k", "column"], "left")
    out = out.select("_k", "column", methods[F.col("column")].alias("method"), F.coalesce("n_ref", F.lit(0)).alias("n_ref"),
                     F.coalesce("n_cur", F.lit(0)).alias("n_cur"), "stat")
    is_ks = F.col("method") == "ks"
    no_data = (F.col("n_ref") == 0) | (F.col("n_cur") == 0) | F.col("stat").isNull()
    out = out.withColumn("stat", F.when(~no_data, F.col("stat"))).withColumn(
        "p_value", F.when(is_ks, ks_pvalue(F.col("stat"), F.col("n_ref").cast("double"), F.col("n_cur").cast("double")))).withColumn(
        "threshold", F.when(is_ks, F.lit(ks_p)).otherwise(F.lit(distance_threshold)))
    drifted = F.when(is_ks, F.col("p_value") < F.col("threshold")).otherwise(F.col("stat") >= F.col("threshold"))
    return out.select(F.col("_k").alias(key), "column", "method", "n_ref", "n_cur", "stat", "p_value", "threshold",
                      F.when(no_data, "no_data").otherwise("ok").alias("status"),
                      F.when(no_data, F.lit(False)).otherwise(drifted).alias("drifted"))


def _wasserstein(numbers: DataFrame, points: DataFrame) -> DataFrame:
    """(_k, column, stat): over the reference's standard deviation (1 if 0)."""
    # running sums of the sorted reference at the ranks k n / m, for the window sizes m that occur
    sizes = numbers.groupBy("column").agg(F.collect_set("_n").alias("_sizes"), F.first("n_ref").alias("n_ref"))
    low = F.col("cum_c") - F.col("c")
    first = lambda x: F.ceil(x * F.col("_m") / F.col("n_ref"))           # first k with k n / m >= x
    rank = points.filter("c > 0").join(F.broadcast(sizes), "column").withColumn("_m", F.explode("_sizes"))
    rank = rank.withColumn("_first", first(low)).withColumn("_last", first(F.col("cum_c")) - 1).filter("_last >= _first")
    rank = rank.withColumn("_rank", F.explode(F.sequence("_first", "_last")))
    before = F.col("cum_s") - F.col("s")
    rank = rank.select("column", F.col("_m").alias("_n"), F.col("_rank"),
                       (before + (F.col("_rank") * F.col("n_ref") / F.col("_m") - low) * F.col("x")).alias("_part"))
    whole = points.groupBy("column").agg(F.sum("s").alias("_all"))
    at = lambda edge: rank.select("column", "_n", F.col("_rank").alias(edge), F.col("_part").alias(f"_part{edge}"))
    j = numbers.join(at("_lo"), ["column", "_n", "_lo"], "left").join(at("_hi"), ["column", "_n", "_hi"], "left").join(
        F.broadcast(whole), "column")
    n, m = F.col("n_ref"), F.col("_n")
    u_lo, u_hi, u_x = F.col("_lo") * n / m, F.col("_hi") * n / m, F.col("_le").cast("double")
    h_lo, h_hi = F.col("_part_lo"), F.coalesce("_part_hi", "_all")       # rank n is the whole sum
    # the reference's values up to rank u_x are x at most, the others larger
    u = F.least(F.greatest(u_x, u_lo), u_hi)
    h = F.when(u_x <= u_lo, h_lo).when(u_x >= u_hi, h_hi).otherwise(F.col("_sum"))
    x = F.col("x")
    area = x * (u - u_lo) - (h - h_lo) + (h_hi - h) - x * (u_hi - u)
    sd = F.when(F.col("_sd").isNull() | (F.col("_sd") == 0), F.lit(1.0)).otherwise(F.col("_sd"))
    return j.groupBy("_k", "column").agg((F.sum(area / n) / F.first(sd)).alias("stat"))


def windows_verdict(columns: DataFrame, key: str, threshold: float = DATASET_THRESHOLD,
                    critical: float = CRITICAL_SHARE) -> DataFrame:
    """Per window: share of drifted columns, dataset drift and severity, as ``drift_dataset``."""
    out = columns.groupBy(key).agg(F.count(F.lit(1)).alias("n_columns"), F.sum(F.col("drifted").cast("int")).cast("long").alias("n_drifted"),
                                   F.avg(F.col("drifted").cast("double")).alias("drift_share"))
    drift = F.col("drift_share") > F.lit(threshold)
    return out.withColumn("dataset_drift", drift).withColumn(
        "severity", F.when(~drift, F.lit("none")).when(F.col("drift_share") > F.lit(critical), "critical").otherwise("warning"))
