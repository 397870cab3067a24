"""Fit a regressor on Spark: absolute loss, validation-based early stop.

``fit_absolute`` fits a linear model by reweighted least squares: one aggregate
over the rows for each iteration, whose result is a matrix of the number of
features; it stops when the validation error has not improved for ``patience``
iterations and keeps the best coefficients.

Single-machine networks are trained with MAE loss and early
stopping on the validation split; their distributed counterpart for curved
relations is a gradient-boosted tree ensemble with ``lossType="absolute"`` and
``validationIndicatorCol`` (training stops when the validation error stops
improving). It is a different learner: no numeric parity is claimed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit(train_val: DataFrame, features: Sequence[str], label: str, is_val: str = "is_val",
        max_iter: int = 30, max_depth: int = 4, step: float = 0.1, seed: int = 42) -> PipelineModel:
    """``train_val`` holds train and validation rows; ``is_val`` marks the latter.
    Rows without a label are not trained on; a null feature is an error."""
    asm = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error")
    gbt = GBTRegressor(featuresCol="_features", labelCol=label, predictionCol="yhat", lossType="absolute",
                       validationIndicatorCol=is_val, maxIter=max_iter, maxDepth=max_depth, stepSize=step,
                       seed=seed)
    data = train_val.filter(F.col(label).isNotNull()).withColumn(is_val, F.col(is_val).cast("boolean"))
    return Pipeline(stages=[asm, gbt]).fit(data)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).drop("_features")


@dataclass(frozen=True)
class AbsoluteLinear:
    """A linear model and how it was found: ``history`` has (iteration,
    coefficients with the intercept first, train error, validation error)."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    best: int
    history: tuple[tuple[int, tuple[float, ...], float, float], ...]

    def predict(self) -> Column:
        return _linear(self.features, self.coefficients)


def _linear(features: Sequence[str], b: Sequence[float]) -> Column:
    total = F.lit(float(b[0]))
    for c, w in zip(features, b[1:]):
        total = total + F.lit(float(w)) * F.col(c)
    return total


def fit_absolute(train_val: DataFrame, features: Sequence[str], label: str, is_val: str = "is_val",
                 max_iter: int = 50, patience: int = 10, delta: float = 1e-4) -> AbsoluteLinear:
    """Coefficients of least absolute error over the rows not marked ``is_val``.

    Iteration 0 is least squares; each further one weighs a row by 1 / max(|its
    residual|, ``delta``). The best iteration is the first with the smallest mean
    absolute error on the validation rows (on the training rows, if there are
    none). Rows without a label or a feature are left out; without training
    rows it raises. The row count meets the driver only in sums."""
    cols = [*features, label]
    val = F.coalesce(F.col(is_val).cast("boolean"), F.lit(False))
    d = train_val.select(*[F.col(c).cast("double").alias(c) for c in cols], val.alias("_val")).filter(
        " AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in cols))
    train, y = ~F.col("_val"), F.col(label)
    x = [F.lit(1.0), *[F.col(c) for c in features]]
    n = len(x)

    def sums(residual: Column | None) -> tuple:
        w = F.lit(1.0) if residual is None else 1.0 / F.greatest(F.abs(residual), F.lit(delta))
        r = F.lit(0.0) if residual is None else F.abs(residual)
        aggs = [F.sum(F.when(train, w * x[i] * x[j])) for i in range(n) for j in range(i, n)]
        aggs += [F.sum(F.when(train, w * x[i] * y)) for i in range(n)]
        return tuple(d.agg(*aggs, F.avg(F.when(train, r)), F.avg(F.when(~train, r))).first())

    history, best, got = [], 0, sums(None)
    if got[0] is None:
        raise ValueError("no training rows")
    for t in range(max_iter + 1):
        a = np.zeros((n, n))
        a[np.triu_indices(n)] = got[:n * (n + 1) // 2]
        b = np.linalg.lstsq(a + np.triu(a, 1).T, np.array(got[n * (n + 1) // 2:-2]), rcond=None)[0]
        got = sums(y - _linear(features, b))
        history.append((t, tuple(b.tolist()), got[-2], got[-1] if got[-1] is not None else got[-2]))
        if history[t][3] < history[best][3]:
            best = t
        elif t - best >= patience:
            break
    return AbsoluteLinear(tuple(features), history[best][1], best, tuple(history))
