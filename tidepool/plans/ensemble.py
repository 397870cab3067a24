"""End-to-end ensemble evaluation on the daily panel.

panel -> temporal split -> scaler fit on train -> standardise -> look-back
windows per (ticker, split) -> score four models -> ensemble mean ->
inverse transform -> metrics per (split, model) -> model comparison.

Shuffles of the big side: the panel aggregate, the label's lead by supplier, the
windows by ticker (``scored`` takes label and windows from one shuffle). Scaler
statistics are a one-row table joined by broadcast; metrics are partial
aggregates into a few groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators.evaluate import wide_ensemble
from tidepool.operators.scale import scaler_fit, scaler_transform
from tidepool.operators.score import LinearScorer, summary_columns, to_long
from tidepool.operators.split import temporal_split
from tidepool.operators.windows import sequence_frame, windows_in_intervals
from tidepool.plans import fixtures as fx
from tidepool.session import materialize

LOOK_BACK = 20

# fixed values: the four stand-in models (scaled space). "ann" is a row model
# that sees the target row's own features; the others see the window.
MODELS = [
    LinearScorer("ann", {"px": 0.5, "disc": -0.2}, "row"),
    LinearScorer("gru", {"px": 1.0}, "mean"),
    LinearScorer("lstm", {"px": 1.0}, "last"),
    LinearScorer("transformer", {"px": 0.5, "qty": 0.1}, "first"),
]
MODEL_NAMES = [m.name for m in MODELS]
SCALED = [f"{c}__z" for c in fx.PANEL_FEATURES]


def split_panel(spark: SparkSession, sf_dir: str, labeled: DataFrame | None = None) -> DataFrame:
    panel = labeled if labeled is not None else fx.labeled_panel(spark, sf_dir)
    return temporal_split(panel, "date", fx.SPLIT_TRAIN, fx.SPLIT_VAL, fx.SPLIT_TEST)


def fitted_scaler(split_df: DataFrame) -> DataFrame:
    return scaler_fit(split_df.filter(F.col("split") == "train"), fx.PANEL_FEATURES + [fx.TARGET])


INTERVALS = {"train": (None, fx.SPLIT_TRAIN), "val": (fx.SPLIT_TRAIN, fx.SPLIT_VAL), "test": (fx.SPLIT_TEST, None)}


def train_stats(labeled: DataFrame) -> DataFrame:
    """The scaler fitted on the train rows, written once: one row that every
    later step reads instead of fitting it again."""
    train = labeled.filter(F.col("date") < F.lit(INTERVALS["train"][1]).cast("date"))
    return materialize(scaler_fit(train, fx.PANEL_FEATURES + [fx.TARGET]), "scaler")


def scaled_panel(spark: SparkSession, sf_dir: str, labeled: DataFrame | None = None,
                 stats: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    labeled = labeled if labeled is not None else fx.labeled_panel(spark, sf_dir)
    stats = stats if stats is not None else train_stats(labeled)
    z = scaler_transform(split_panel(spark, sf_dir, labeled), stats, fx.PANEL_FEATURES + [fx.TARGET], suffix="__z")
    return z, stats


def panel_windows(spark: SparkSession, sf_dir: str, labeled: DataFrame | None = None,
                  stats: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scaled windows per (ticker, split) and the scaler fitted on train rows.

    Both read the labelled panel table (written once; pass it as ``labeled``,
    and its scaler as ``stats``, when the caller has them already).
    The statistics are a one-row table, broadcast to standardise each row
    once; the windows of scaled rows then need one shuffle by ticker.
    """
    labeled = labeled if labeled is not None else fx.labeled_panel(spark, sf_dir)
    stats = stats if stats is not None else train_stats(labeled)
    z = scaler_transform(labeled.select("ticker", "date", "row_id", fx.TARGET, *fx.PANEL_FEATURES),
                         stats, fx.PANEL_FEATURES + [fx.TARGET], suffix="__z")
    z = z.select("ticker", "date", "row_id", fx.TARGET, f"{fx.TARGET}__z",
                 *[F.col(f"{c}__z").alias(c) for c in fx.PANEL_FEATURES])
    frame = sequence_frame(z, ["ticker"], "date", fx.PANEL_FEATURES, LOOK_BACK, "row_id", whole=True)
    w = windows_in_intervals(frame, "date", INTERVALS, LOOK_BACK)
    return w.select("ticker", "date", "row_id", "split", fx.TARGET, f"{fx.TARGET}__z", "seq", "x_row"), stats


def scored(spark: SparkSession, sf_dir: str, models=MODELS, with_ensemble: bool = True) -> DataFrame:
    """Long (split, ticker, row_id, model, yhat_z, yhat, actual, actual_z).

    The stand-in models are linear in window summaries, so they are
    evaluated from plain window aggregates of the raw features (no arrays)
    and standardised afterwards with the broadcast statistics -- the same
    numbers as scoring the scaled windows of ``panel_windows``.
    """
    # label and window summaries come from one window pass over the supplier's days
    ahead = {"_px_fwd": lambda w: F.lead("px", fx.LABEL_HORIZON).over(w)}
    frame = sequence_frame(fx.supplier_days(spark, sf_dir), ["l_suppkey"], "date", fx.PANEL_FEATURES, LOOK_BACK, "row_id",
                           extra=ahead, after=fx.LABEL_HORIZON, summaries=summary_columns(models), collect=False, whole=True)
    frame = frame.withColumn(fx.TARGET, fx.label(F.col("_px_fwd"))).drop("_px_fwd")
    frame = materialize(fx.with_ticker(frame), "windowed-panel")
    w = windows_in_intervals(frame, "date", INTERVALS, LOOK_BACK).crossJoin(F.broadcast(train_stats(frame)))
    mean = lambda c: F.col(f"{c}__mean")
    std = lambda c: F.col(f"{c}__std")
    wide = w
    for m in models:
        wide = wide.withColumn(f"yhat__{m.name}", m.scaled_expr(LOOK_BACK, mean, std))
    names = [m.name for m in models]
    if with_ensemble:
        wide = wide_ensemble(wide, [f"yhat__{n}" for n in names], "yhat__ensemble")
        names = names + ["ensemble"]
    wide = wide.withColumn(f"{fx.TARGET}__z", (F.col(fx.TARGET) - mean(fx.TARGET)) / std(fx.TARGET))
    ids = ["split", "ticker", "row_id", fx.TARGET, f"{fx.TARGET}__z", f"{fx.TARGET}__mean", f"{fx.TARGET}__std"]
    long = (to_long(wide, ids, names, "yhat")
            .withColumnRenamed("yhat", "yhat_z")
            .withColumnRenamed(fx.TARGET, "actual")
            .withColumnRenamed(f"{fx.TARGET}__z", "actual_z"))
    return (long.withColumn("yhat", F.col("yhat_z") * std(fx.TARGET) + mean(fx.TARGET))
                .drop(f"{fx.TARGET}__mean", f"{fx.TARGET}__std"))
