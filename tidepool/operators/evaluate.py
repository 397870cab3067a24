"""Aligning, ensembling and evaluating predictions.

Predictions are long: (ids..., model, yhat). Everything here is a join on the
row id or a grouped aggregate with map-side partial aggregation; the groups
of the metric aggregates are (split, model), a handful of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def attach_actuals(preds: DataFrame, truth: DataFrame, id_col: str = "row_id",
                   target: str = "y", actual_col: str = "actual",
                   on: Sequence[str] | None = None) -> DataFrame:
    """Look up the actual value of each predicted row by id. A predicted id
    that ``truth`` does not have is an error when the result is computed
    (``check_actuals`` counts them beforehand); a known id may have a null
    actual.
    """
    keys = list(on or [id_col])
    t = truth.select(*keys, F.struct(F.col(target).alias("v")).alias("_hit"))
    missing = F.concat(F.lit("no actual for id "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    known = F.when(F.col("_hit").isNull(), F.raise_error(missing).cast(truth.schema[target].dataType))
    return (preds.join(t, on=keys, how="left").withColumn(actual_col, known.otherwise(F.col("_hit.v"))).drop("_hit"))


def check_actuals(preds: DataFrame, truth: DataFrame, id_col: str = "row_id") -> DataFrame:
    """One row: number of predicted ids that have no actual (left anti join)."""
    miss = preds.select(id_col).join(truth.select(id_col), on=id_col, how="left_anti")
    return miss.agg(F.count(F.lit(1)).alias("missing_ids"))


def align_predictions(window_preds: DataFrame, row_preds: DataFrame,
                      on: Sequence[str] = ("row_id",)) -> DataFrame:
    """Keep the row model's predictions for exactly the ids the window models
    scored (semi join on the id; unmatched ids are skipped)."""
    return row_preds.join(window_preds.select(*on), on=list(on), how="left_semi")


def ensemble_mean(long_preds: DataFrame, id_cols: Sequence[str] = ("row_id",),
                  models: Sequence[str] | None = None, value: str = "yhat",
                  model_name: str = "ensemble") -> DataFrame:
    """Unweighted mean over the models present for each id.

    A hash aggregate on the id with partial aggregation; ids are unique per
    row so there is no hot key.
    """
    p = long_preds if models is None else long_preds.filter(F.col("model").isin(list(models)))
    return (p.groupBy(*id_cols)
             .agg(F.avg(value).alias(value), F.count(value).alias("n_models"))
             .withColumn("model", F.lit(model_name)))


def wide_ensemble(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """Row-wise mean of the non-null model columns (no shuffle)."""
    s = None
    n = None
    for c in cols:
        v = F.coalesce(F.col(c), F.lit(0.0))
        k = F.when(F.col(c).isNotNull(), 1).otherwise(0)
        s = v if s is None else s + v
        n = k if n is None else n + k
    return df.withColumn(out, s / F.when(n > 0, n))


def eval_metrics(scored: DataFrame, group_cols: Sequence[str] = ("split", "model"),
                 y: str = "actual", yhat: str = "yhat") -> DataFrame:
    """n, MAE and MSE per group; rows without an actual are left out."""
    err = F.col(y) - F.col(yhat)
    return (scored.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull())
                  .groupBy(*group_cols)
                  .agg(F.count(F.lit(1)).alias("n"),
                       F.avg(F.abs(err)).alias("mae"),
                       F.avg(err * err).alias("mse")))


def residual_stats(scored: DataFrame, group_cols: Sequence[str] = ("split", "model"),
                   y: str = "actual", yhat: str = "yhat") -> DataFrame:
    """Mean, population std, min and max of the residual y - yhat."""
    r = F.col(y) - F.col(yhat)
    return (scored.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull())
                  .groupBy(*group_cols)
                  .agg(F.count(F.lit(1)).alias("n"),
                       F.avg(r).alias("resid_mean"),
                       F.stddev_pop(r).alias("resid_std"),
                       F.min(r).alias("resid_min"),
                       F.max(r).alias("resid_max")))


def model_comparison(metrics: DataFrame, by: str = "mae", group_cols: Sequence[str] = ()) -> DataFrame:
    """Rank models by a metric (1 = best) inside each group; ties by name.

    The metrics table has one row per (group, model): the rank window runs
    over a few rows, not over data.
    """
    w = Window.partitionBy(*group_cols).orderBy(F.col(by).asc(), F.col("model").asc()) if group_cols \
        else Window.orderBy(F.col(by).asc(), F.col("model").asc())
    return metrics.withColumn(f"{by}_rank", F.row_number().over(w))
