"""Data and prediction drift between a reference and a current sample.

Per column (all columns in one job, never one job per column):

* ``ks``: two-sample Kolmogorov-Smirnov. D = max |F_ref - F_cur| over the
  union of values; p from the asymptotic series with Stephens' small-sample
  correction (Stephens 1970): ne = n m / (n + m),
  lambda = (sqrt(ne) + 0.12 + 0.11 / sqrt(ne)) D,
  p = 2 sum_{k>=1} (-1)^(k-1) exp(-2 k^2 lambda^2), clamped to [0, 1], and
  p = 1 for lambda < 0.2 where the truncated series is invalid.
  Drift iff p < threshold (0.05).
* ``wasserstein``: W1 = sum |F_ref(x_i) - F_cur(x_i)| (x_{i+1} - x_i) over the
  sorted union, divided by the population std of the reference (1 if 0).
  Drift iff W >= threshold (0.1).
* ``js``: Jensen-Shannon distance (natural log) between the category shares
  of the two sides over the union of categories. Drift iff >= threshold (0.1).

Empirical CDFs need a cumulative sum over sorted distinct values per column.
A plain window partitioned by column would put a whole column in one task, so
``ordered_cumsum`` runs it in two levels: ``percentile_approx`` cuts (a
bounded sketch per column) split each column into buckets; cumulative sums
run inside (column, bucket), and bucket totals (a small table) give each
bucket its offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# fixed values: default tests and thresholds
KS_P = 0.05
DISTANCE_THRESHOLD = 0.1
KS_TERMS = 100
DATASET_THRESHOLD = 0.3
CRITICAL_SHARE = 0.5
MIN_COMMON_COLUMNS = 5
MIN_CURRENT_ROWS = 10
MIN_PREDICTIONS = 50
PREDICTION_WINDOW = 100
MIN_MEAN = 0.01
RETRAIN = "Consider retraining the model"
NO_ACTION = "No action required"


# ------------------------------------------------------------------ two-level cumulative sum

def ordered_cumsum(df: DataFrame, part: Sequence[str], order: str, vals: Sequence[str],
                   buckets: int = 256, accuracy: int = 10000) -> DataFrame:
    """Add ``cum_<v>`` = running sum of ``v`` over ``order`` within ``part``
    (inclusive), and ``next_<order>`` = the next larger ``order`` value.
    ``order`` must be unique within ``part`` (e.g. after a group-by).

    Two levels at every size: ``buckets`` ranges per part, a running sum inside
    each, and the ranges' totals as offsets."""
    part = list(part)
    grid = [i / buckets for i in range(1, buckets)]
    # one row per part with a bounded sketch result: safe to broadcast
    cuts = df.groupBy(*part).agg(F.percentile_approx(order, grid, accuracy).alias("_cuts"))
    d = (df.join(F.broadcast(cuts), on=part, how="inner")
           .withColumn("_b", F.size(F.filter("_cuts", lambda t: t < F.col(order))))
           .drop("_cuts"))
    # bucket totals straight from the input (partial aggregation), then
    # offsets = running totals over buckets (a window over <= buckets rows per part)
    tot = d.groupBy(*part, "_b").agg(*[F.sum(v).alias(f"_t_{v}") for v in vals], F.min(order).alias("_mn"))
    prior = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*part, "_b",
                     *[F.coalesce(F.sum(f"_t_{v}").over(prior), F.lit(0)).alias(f"_o_{v}") for v in vals],
                     F.lead("_mn").over(Window.partitionBy(*part).orderBy("_b")).alias("_nb"))
    j = d.join(off, on=[*part, "_b"], how="inner")
    w = Window.partitionBy(*part, "_b").orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return j.select(*df.columns,
                    *[(F.sum(v).over(run) + F.col(f"_o_{v}")).alias(f"cum_{v}") for v in vals],
                    F.coalesce(F.lead(order).over(w), F.col("_nb")).alias(f"next_{order}"))


# ------------------------------------------------------------------ inputs

def unpivot_numeric(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, side, x) for numeric columns; NULL / NaN removed per column."""
    def one(df: DataFrame, side: str) -> DataFrame:
        parts = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
        return (df.selectExpr(f"stack({len(cols)}, {parts}) AS (column, x)")
                  .withColumn("side", F.lit(side)))
    u = one(ref, "ref").unionByName(one(cur, "cur"))
    return u.filter(F.col("x").isNotNull() & ~F.isnan("x"))


def unpivot_categorical(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    def one(df: DataFrame, side: str) -> DataFrame:
        parts = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
        return (df.selectExpr(f"stack({len(cols)}, {parts}) AS (column, v)")
                  .withColumn("side", F.lit(side)))
    return one(ref, "ref").unionByName(one(cur, "cur")).filter(F.col("v").isNotNull())


def _sides(long: DataFrame, key: str) -> DataFrame:
    """(column, key, c_ref, c_cur): partial aggregation collapses repeats."""
    return long.groupBy("column", key).agg(
        F.sum(F.when(F.col("side") == "ref", 1).otherwise(0)).cast("long").alias("c_ref"),
        F.sum(F.when(F.col("side") == "cur", 1).otherwise(0)).cast("long").alias("c_cur"))


def ks_pvalue(d: Column, n: Column, m: Column, terms: int = KS_TERMS) -> Column:
    """NULL when either side is empty (no test)."""
    ok = (n > 0) & (m > 0) & d.isNotNull()
    ne = F.sqrt(n * m / F.when(ok, n + m))
    lam = (ne + F.lit(0.12) + F.lit(0.11) / ne) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0).cast("double"),
                         lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1)
                         * F.exp(F.lit(-2.0) * k * k * lam * lam))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(2.0) * series))
    return F.when(~ok, F.lit(None).cast("double")).when(lam < 0.2, F.lit(1.0)).otherwise(p)


# ------------------------------------------------------------------ per-column tests

def numeric_tests(ref: DataFrame, cur: DataFrame, cols: Sequence[str], buckets: int = 256) -> DataFrame:
    """(column, n_ref, n_cur, ks_d, ks_p, wasserstein) for every numeric column."""
    long = unpivot_numeric(ref, cur, cols)
    counts = _sides(long, "x")
    cum = ordered_cumsum(counts, ["column"], "x", ["c_ref", "c_cur"], buckets)
    is_ref = F.col("side") == "ref"
    # per-column totals and reference spread in one aggregate; one row per
    # column: bounded by the schema, safe to broadcast
    t = long.groupBy("column").agg(
        F.sum(F.when(is_ref, 1).otherwise(0)).cast("long").alias("n_ref"),
        F.sum(F.when(~is_ref, 1).otherwise(0)).cast("long").alias("n_cur"),
        F.stddev_pop(F.when(is_ref, F.col("x"))).alias("ref_std"))
    j = cum.join(F.broadcast(t), on="column", how="inner")
    gap = F.abs(F.col("cum_c_ref") / F.col("n_ref") - F.col("cum_c_cur") / F.col("n_cur"))
    stat = (j.filter((F.col("n_ref") > 0) & (F.col("n_cur") > 0))
             .groupBy("column")
             .agg(F.max(gap).alias("ks_d"),
                  F.sum(F.coalesce(gap * (F.col("next_x") - F.col("x")), F.lit(0.0))).alias("_w")))
    out = t.join(stat, on="column", how="left")
    sd = F.when(F.col("ref_std").isNull() | (F.col("ref_std") == 0), F.lit(1.0)).otherwise(F.col("ref_std"))
    return out.select("column", "n_ref", "n_cur", "ks_d",
                      ks_pvalue(F.col("ks_d"), F.col("n_ref").cast("double"), F.col("n_cur").cast("double"))
                      .alias("ks_p"),
                      (F.col("_w") / sd).alias("wasserstein"))


def categorical_tests(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n_ref, n_cur, js) -- aggregates only (no windows)."""
    counts = _sides(unpivot_categorical(ref, cur, cols), "v")
    totals = counts.groupBy("column").agg(F.sum("c_ref").alias("n_ref"), F.sum("c_cur").alias("n_cur"))
    j = counts.join(F.broadcast(totals), on="column", how="inner")
    p = F.col("c_ref") / F.col("n_ref")
    q = F.col("c_cur") / F.col("n_cur")
    m = (p + q) / 2

    def kl(a):
        return F.when(a > 0, a * F.log(a / m)).otherwise(F.lit(0.0))

    div = (j.filter((F.col("n_ref") > 0) & (F.col("n_cur") > 0))
            .groupBy("column").agg(F.sum(F.lit(0.5) * kl(p) + F.lit(0.5) * kl(q)).alias("_jsd")))
    return (totals.join(div, on="column", how="left")
                  .select("column", "n_ref", "n_cur",
                          F.sqrt(F.greatest(F.col("_jsd"), F.lit(0.0))).alias("js")))


def drift_columns(ref: DataFrame, cur: DataFrame, numeric: Sequence[str] = (),
                  categorical: Sequence[str] = (), method: dict[str, str] | None = None,
                  ks_p: float = KS_P, distance_threshold: float = DISTANCE_THRESHOLD,
                  buckets: int = 256) -> DataFrame:
    """One row per column: method, stat, p_value, threshold, drifted, status.

    ``method`` maps a numeric column to ``ks`` (default) or ``wasserstein``;
    categorical columns use ``js``. A column empty on either side gets status ``no_data`` and is not counted as drifted.
    """
    method = method or {}
    unknown = set(method.values()) - {"ks", "wasserstein"}
    if unknown:
        raise ValueError(f"unknown drift method: {sorted(unknown)}")
    parts = []
    if numeric:
        nt = numeric_tests(ref, cur, numeric, buckets)
        mlit = F.create_map(*[x for c in numeric for x in (F.lit(c), F.lit(method.get(c, "ks")))])
        nt = nt.withColumn("method", mlit[F.col("column")])
        is_ks = F.col("method") == "ks"
        parts.append(nt.select(
            "column", "method", "n_ref", "n_cur",
            F.when(is_ks, F.col("ks_d")).otherwise(F.col("wasserstein")).alias("stat"),
            F.when(is_ks, F.col("ks_p")).alias("p_value"),
            F.when(is_ks, F.lit(ks_p)).otherwise(F.lit(distance_threshold)).alias("threshold")))
    if categorical:
        ct = categorical_tests(ref, cur, categorical)
        parts.append(ct.select("column", F.lit("js").alias("method"), "n_ref", "n_cur",
                               F.col("js").alias("stat"), F.lit(None).cast("double").alias("p_value"),
                               F.lit(distance_threshold).alias("threshold")))
    if not parts:                      # nothing to compare: an empty result, not an error
        return cur.sparkSession.createDataFrame([], COLUMN_RESULT)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    no_data = (F.col("n_ref") == 0) | (F.col("n_cur") == 0) | F.col("stat").isNull()
    drifted = F.when(F.col("method") == "ks", F.col("p_value") < F.col("threshold")) \
               .otherwise(F.col("stat") >= F.col("threshold"))
    return (out.withColumn("status", F.when(no_data, "no_data").otherwise("ok"))
               .withColumn("drifted", F.when(no_data, F.lit(False)).otherwise(drifted)))


COLUMN_RESULT = T.StructType([
    T.StructField("column", T.StringType()), T.StructField("method", T.StringType()),
    T.StructField("n_ref", T.LongType()), T.StructField("n_cur", T.LongType()),
    T.StructField("stat", T.DoubleType()), T.StructField("p_value", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()), T.StructField("status", T.StringType()),
    T.StructField("drifted", T.BooleanType()),
])


# ------------------------------------------------------------------ dataset verdict

def common_columns(ref: DataFrame | None, cur: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Column-name intersection (driver-side set logic, no job); sorted."""
    if ref is None:
        return []
    return sorted((set(ref.columns) & set(cur.columns)) - set(exclude))


def drift_dataset(columns: DataFrame, threshold: float = DATASET_THRESHOLD,
                  critical: float = CRITICAL_SHARE) -> DataFrame:
    """Share of drifted columns; drift iff share > threshold; severity
    critical iff share > critical, else warning (both strict)."""
    share = F.avg(F.col("drifted").cast("double"))
    agg = columns.agg(F.count(F.lit(1)).alias("n_columns"),
                      F.sum(F.col("drifted").cast("int")).cast("long").alias("n_drifted"),
                      share.alias("drift_share"))
    dd = F.col("drift_share") > F.lit(threshold)
    return (agg.withColumn("status", F.lit("success"))
               .withColumn("dataset_drift", dd)
               .withColumn("severity", F.when(~dd, F.lit("none"))
                           .when(F.col("drift_share") > F.lit(critical), "critical").otherwise("warning")))


VERDICT = {"n_columns": "long", "n_drifted": "long", "drift_share": "double", "status": "string", "dataset_drift": "boolean",
           "severity": "string", "samples_analyzed": "long", "prediction_drift_score": "double"}


def status_row(spark, status: str) -> DataFrame:
    """A verdict that says only why there is none."""
    return spark.range(1).select(*[F.lit(status if c == "status" else None).cast(t).alias(c) for c, t in VERDICT.items()])


def check_drift(ref: DataFrame | None, cur: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                method: dict[str, str] | None = None, threshold: float = DATASET_THRESHOLD,
                preds: DataFrame | None = None, min_rows: int = MIN_CURRENT_ROWS,
                min_cols: int = MIN_COMMON_COLUMNS) -> DataFrame:
    """Guards, then per-column tests over the listed columns that both sides
    have, then the verdict with the number of current rows and the drift score
    of ``preds`` (``prediction``, ``ts``, ``id``; none: 0).

    ``insufficient_data``: no reference, or fewer than ``min_rows`` current
    rows. ``schema_mismatch``: the two sides share fewer than ``min_cols``
    columns, listed or not, or none that is listed. Rows are counted by the
    verdict's own plan; nothing runs while it is built."""
    spark = cur.sparkSession
    if ref is None:
        return status_row(spark, "insufficient_data")
    common = common_columns(ref, cur)
    num = [c for c in numeric if c in common]
    cat = [c for c in categorical if c in common]
    size = cur.agg(F.count(F.lit(1)).alias("_size"))
    if len(common) < min_cols or not num + cat:
        verdict = status_row(spark, "schema_mismatch").crossJoin(size)
    else:
        verdict = drift_dataset(drift_columns(ref, cur, num, cat, method), threshold).crossJoin(size)
        score = (drift_prediction(preds).select(F.col("drift_score").alias("prediction_drift_score")) if preds is not None
                 else spark.range(1).select(F.lit(0.0).cast("double").alias("prediction_drift_score")))
        verdict = verdict.withColumn("samples_analyzed", F.col("_size")).crossJoin(score)          # one row each
    few = F.col("_size") < F.lit(min_rows)
    return verdict.select(*[F.when(few, F.lit("insufficient_data" if c == "status" else None).cast(t)).otherwise(F.col(c)).alias(c)
                            for c, t in VERDICT.items()])


# ------------------------------------------------------------------ predictions

def drift_prediction(preds: DataFrame, value: str = "prediction", order: Sequence[str] = ("ts", "id"),
                     window: int = PREDICTION_WINDOW, min_n: int = MIN_PREDICTIONS,
                     keys: Sequence[str] = ()) -> DataFrame:
    """Spread of the newest ``window`` predictions relative to their mean:
    fewer than ``min_n`` -> 0; zero spread -> 0; else
    min(1, std_pop / max(|mean|, 0.01)). Per ``keys`` group if given."""
    if keys:
        w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
        last = preds.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= window).drop("_rk")
        g = last.groupBy(*keys)
    else:
        last = preds.orderBy(*[F.col(c).desc() for c in order]).limit(window)
        g = last.groupBy()
    x = F.col(value)
    agg = g.agg(F.count(x).alias("n_window"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
                F.min(x).alias("min"), F.max(x).alias("max"))
    score = (F.when(F.col("n_window") < min_n, F.lit(0.0))
              .when(F.col("std").isNull() | (F.col("std") == 0), F.lit(0.0))
              .otherwise(F.least(F.lit(1.0), F.col("std") / F.greatest(F.abs(F.col("mean")), F.lit(MIN_MEAN)))))
    return agg.withColumn("drift_score", score)


def drift_status(ref: DataFrame | None, cur: DataFrame, preds: DataFrame, window_size: int,
                 threshold: float = DATASET_THRESHOLD, checks: DataFrame | None = None) -> DataFrame:
    """Monitor status: reference rows, current and prediction window sizes
    (the windows hold ``window_size`` rows at most), time of the last check in
    the log ``checks`` (check_ts; null without one), threshold, window size."""
    spark = cur.sparkSession
    n_ref = ref.agg(F.count(F.lit(1)).alias("reference_samples")) if ref is not None else \
        spark.range(1).select(F.lit(0).cast("long").alias("reference_samples"))
    n_cur = cur.agg(F.least(F.count(F.lit(1)), F.lit(window_size)).cast("long").alias("current_window_size"))
    n_pred = preds.agg(F.least(F.count(F.lit(1)), F.lit(window_size)).cast("long").alias("prediction_window_size"))
    last = (checks.agg(F.max("check_ts").alias("last_drift_check")) if checks is not None
            else spark.range(1).select(F.lit(None).cast("timestamp").alias("last_drift_check")))
    return (n_ref.crossJoin(n_cur).crossJoin(n_pred).crossJoin(last)
                 .withColumn("drift_threshold", F.lit(float(threshold)))
                 .withColumn("window_size", F.lit(int(window_size))))


def drift_report(status: DataFrame, verdict: DataFrame, min_rows: int = MIN_CURRENT_ROWS) -> DataFrame:
    """Status + verdict + advice; a window under ``min_rows`` gives
    ``insufficient_data`` and no analysis."""
    extra = {"samples_analyzed": "long", "prediction_drift_score": "double"}      # what check_drift adds
    j = status.crossJoin(verdict.select(
        F.col("status").alias("check_status"), "dataset_drift", "drift_share", "severity",
        *[F.col(c) if c in verdict.columns else F.lit(None).cast(t).alias(c) for c, t in extra.items()]))
    few = F.col("current_window_size") < F.lit(min_rows)
    return j.select(
        F.when(few, F.lit("insufficient_data")).otherwise(F.lit("success")).alias("status"),
        "reference_samples", "current_window_size", "prediction_window_size", "drift_threshold", "window_size",
        F.when(few, F.lit(None)).otherwise(F.col("check_status")).alias("check_status"),
        F.when(few, F.lit(None)).otherwise(F.col("dataset_drift")).alias("dataset_drift"),
        F.when(few, F.lit(None)).otherwise(F.col("drift_share")).alias("drift_share"),
        F.when(few, F.lit(None)).otherwise(F.col("severity")).alias("severity"),
        F.when(few, F.lit(None)).otherwise(F.col("samples_analyzed")).alias("samples_analyzed"),
        F.when(few, F.lit(None)).otherwise(F.col("prediction_drift_score")).alias("prediction_drift_score"),
        F.when(few, F.lit(None)).when(F.coalesce(F.col("dataset_drift"), F.lit(False)), F.lit(RETRAIN))
         .otherwise(F.lit(NO_ACTION)).alias("recommendation"))
