"""Distributed batch scoring of any set of models.

A model is either

* ``LinearScorer``: a linear function of the target row's own features
  (a row model) or of one per-feature summary of the window (mean / last /
  first); evaluated as a JVM column expression inside whole-stage codegen;
* ``PandasScorer``: any ``predict(ndarray) -> ndarray`` (a loaded network, a
  fitted regressor). It runs in ``mapInPandas``: the model is loaded once per
  task and called on Arrow batches of windows shaped (batch, L, F) or (batch, F).

Output is long: (ids..., model, yhat). Linear models are produced side by side
on one row and unpivoted with ``stack`` -- no union, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.operators.windows import window_feature


@dataclass(frozen=True)
class LinearScorer:
    name: str
    weights: dict = field(default_factory=dict)   # feature -> weight
    source: str = "row"                           # row | mean | last | first
    bias: float = 0.0

    def expr(self, features: Sequence[str], seq_col: str, row_col: str, look_back: int):
        total = F.lit(float(self.bias)).cast("double")
        for feat, w in self.weights.items():
            i = list(features).index(feat)
            x = F.col(row_col)[i] if self.source == "row" else window_feature(seq_col, i, self.source, look_back)
            total = total + F.lit(float(w)) * x
        return total


    def summaries(self) -> dict:
        """Window summaries this scorer reads: name -> (feature, how)."""
        if self.source == "row":
            return {}
        return {f"{feat}__win_{self.source}": (feat, self.source) for feat in self.weights}

    def scaled_expr(self, look_back: int, mean, std):
        """The same model on *raw* window summaries with standardisation
        applied afterwards: exact because scaling is affine and mean / sum /
        first / last / min / max commute with it (std > 0). ``mean(f)`` and
        ``std(f)`` give the fitted statistics of feature f as columns."""
        total = F.lit(float(self.bias)).cast("double")
        for feat, w in self.weights.items():
            x = F.col(feat) if self.source == "row" else F.col(f"{feat}__win_{self.source}")
            shift = mean(feat) * F.lit(float(look_back)) if self.source == "sum" else mean(feat)
            total = total + F.lit(float(w)) * ((x - shift) / std(feat))
        return total


def summary_columns(scorers: Sequence) -> dict:
    out = {}
    for s in scorers:
        if isinstance(s, LinearScorer):
            out.update(s.summaries())
    return out


@dataclass(frozen=True)
class PandasScorer:
    name: str
    load: Callable[[], Callable[[np.ndarray], np.ndarray]]   # returns predict()
    source: str = "window"                                   # window | row


def linear_scores_wide(windows: DataFrame, scorers: Sequence[LinearScorer], features: Sequence[str],
                       look_back: int, seq_col: str = "seq", row_col: str = "x_row") -> DataFrame:
    out = windows
    for s in scorers:
        out = out.withColumn(f"yhat__{s.name}", s.expr(features, seq_col, row_col, look_back))
    return out


def to_long(wide: DataFrame, id_cols: Sequence[str], models: Sequence[str],
            value: str = "yhat") -> DataFrame:
    """Unpivot ``yhat__<model>`` columns to (ids..., model, yhat)."""
    parts = ", ".join(f"'{m}', `{value}__{m}`" for m in models)
    return wide.selectExpr(*[f"`{c}`" for c in id_cols],
                           f"stack({len(models)}, {parts}) AS (model, {value})")


def pandas_scores(windows: DataFrame, scorers: Sequence[PandasScorer], id_cols: Sequence[str], look_back: int,
                  seq_col: str = "seq", row_col: str = "x_row") -> DataFrame:
    """Wide output (ids..., yhat__<model>...) of any predict functions: one pass
    over the windows for all models, which are loaded once per task."""
    scorers = list(scorers)
    ids = [f"_id{i}" for i in range(len(id_cols))]
    src = windows.select(*[F.col(c).alias(i) for c, i in zip(id_cols, ids)],
                         *([F.flatten(seq_col).alias("_seq")] if any(s.source == "window" for s in scorers) else []),
                         *([F.col(row_col).alias("_row")] if any(s.source == "row" for s in scorers) else []))
    schema = T.StructType([src.schema[i] for i in ids]
                          + [T.StructField(f"yhat__{s.name}", T.DoubleType()) for s in scorers])

    def run(batches):
        models = [(s.name, s.source, s.load()) for s in scorers]
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = {}
            if "_seq" in pdf:
                x["window"] = np.concatenate(pdf["_seq"].to_list()).astype(np.float64).reshape(len(pdf), look_back, -1)
            if "_row" in pdf:
                x["row"] = np.concatenate(pdf["_row"].to_list()).astype(np.float64).reshape(len(pdf), -1)
            out = pdf[ids].copy()
            for name, source, predict in models:
                out[f"yhat__{name}"] = np.asarray(predict(x[source]), dtype=np.float64).reshape(-1)
            yield out

    return src.mapInPandas(run, schema).withColumnsRenamed(dict(zip(ids, id_cols)))


def batch_score(windows: DataFrame, scorers: Sequence, features: Sequence[str], look_back: int,
                id_cols: Sequence[str] = ("row_id",), seq_col: str = "seq",
                row_col: str = "x_row") -> DataFrame:
    """Score every window with every model; long (ids..., model, yhat)."""
    lin = [s for s in scorers if isinstance(s, LinearScorer)]
    pys = [s for s in scorers if isinstance(s, PandasScorer)]
    if not lin and not pys:
        raise ValueError("batch_score needs at least one LinearScorer or PandasScorer")
    parts = []
    if lin:
        wide = linear_scores_wide(windows, lin, features, look_back, seq_col, row_col)
        parts.append(to_long(wide, id_cols, [s.name for s in lin]))
    if pys:
        parts.append(to_long(pandas_scores(windows, pys, id_cols, look_back, seq_col, row_col), id_cols,
                             [s.name for s in pys]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def linear_predict(weights: np.ndarray, bias: float = 0.0, how: str = "last") -> Callable:
    """A numpy predict() for PandasScorer tests: linear in a window summary."""
    def predict(x: np.ndarray) -> np.ndarray:
        if x.ndim == 3:
            x = {"last": x[:, -1, :], "first": x[:, 0, :], "mean": x.mean(axis=1)}[how]
        return x @ weights + bias
    return predict
