"""Serving and monitoring on the events table.

Requests are look-back windows of ``(value, k)`` per user (20 steps), some
broken on purpose; they are validated, scaled with statistics of the
reference period, scored by four stand-in models (the row model sees the
last step, the others the whole window), averaged and inverse-transformed.
The resulting prediction log feeds request metrics and drift monitoring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators.evaluate import wide_ensemble
from tidepool.operators.scale import scaler_fit
from tidepool.operators.score import LinearScorer, linear_scores_wide
from tidepool.operators.validate import last_step, split_valid, validate_sequences
from tidepool.operators.windows import lookback_windows, scale_sequences
from tidepool.plans import fixtures as fx
from tidepool.session import materialize

EV_FEATURES = ["value", "k"]
LOOK_BACK = 20
WINDOW_SIZE = 1000

# fixed values: stand-in models over scaled (value, k)
MODELS = [
    LinearScorer("ann", {"value": 0.5}, "row"),
    LinearScorer("gru", {"value": 1.0}, "mean"),
    LinearScorer("lstm", {"value": 1.0}, "last"),
    LinearScorer("transformer", {"value": 0.5, "k": 0.1}, "first"),
]
MODEL_NAMES = [m.name for m in MODELS]

# fixed values: latency histogram upper bounds in seconds
LATENCY_BOUNDS = [0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0]

NAN = float("nan")
INF = float("inf")


def break_some(seq: Column, rid: Column) -> Column:
    """Deterministically broken requests by ``event_id % 50``: 1 short,
    2 NaN, 3 +Inf, 4 wrong width, 5 ragged, 6 null value."""
    m = rid % 50
    head19 = F.slice(seq, 1, LOOK_BACK - 1)

    def with_last(*xs):
        return F.concat(head19, F.array(F.array(*[F.lit(x).cast("double") for x in xs])))

    return (F.when(m == 1, F.slice(seq, 1, 10))
             .when(m == 2, with_last(NAN, NAN))
             .when(m == 3, with_last(INF, 1.0))
             .when(m == 4, F.transform(seq, lambda r: F.slice(r, 1, 1)))
             .when(m == 5, with_last(1.0, 2.0, 3.0))
             .when(m == 6, with_last(None, 1.0))
             .otherwise(seq))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.event_features(spark, sf_dir)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, ts, sequence): one request per full window."""
    w = lookback_windows(events(spark, sf_dir), ["user_id"], "ts", EV_FEATURES, LOOK_BACK,
                         id_col="event_id", seq_col="seq", row_col="_x")
    return w.select("event_id", "user_id", "ts", break_some(F.col("seq"), F.col("event_id")).alias("sequence"))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate_sequences(requests(spark, sf_dir), "sequence", LOOK_BACK, len(EV_FEATURES))


def reference_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.event_features(spark, sf_dir, before=fx.DRIFT_CUT)


def current_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.event_features(spark, sf_dir, since=fx.DRIFT_CUT)


def fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature scaler of the reference period; ``value`` doubles as target."""
    return scaler_fit(reference_period(spark, sf_dir), EV_FEATURES)


def validated_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validated request batch written once (scoring and error counts
    both read it)."""
    return materialize(validated(spark, sf_dir), "requests")


def score_requests(spark: SparkSession, sf_dir: str, batch: DataFrame | None = None,
                   stats: DataFrame | None = None) -> DataFrame:
    """Valid requests only: (event_id, user_id, ts, yhat__<model> ..., yhat__ensemble)
    in original units, plus the scaled sequence (what the drift log keeps).
    ``stats``: a stored scaler (none: fitted here)."""
    good, _ = split_valid(batch if batch is not None else validated(spark, sf_dir))
    stats = stats if stats is not None else fitted(spark, sf_dir)
    j = good.crossJoin(F.broadcast(stats))
    means = [F.col(f"{c}__mean") for c in EV_FEATURES]
    stds = [F.col(f"{c}__std") for c in EV_FEATURES]
    z = j.withColumn("seq_z", scale_sequences(F.col("sequence"), means, stds)) \
         .withColumn("x_last", last_step(F.col("seq_z")))
    wide = linear_scores_wide(z, MODELS, EV_FEATURES, LOOK_BACK, seq_col="seq_z", row_col="x_last")
    wide = wide_ensemble(wide, [f"yhat__{m}" for m in MODEL_NAMES], "yhat__ensemble")
    m, s = F.col("value__mean"), F.col("value__std")
    outs = [(F.col(f"yhat__{n}") * s + m).alias(n) for n in MODEL_NAMES + ["ensemble"]]
    return wide.select("event_id", "user_id", "ts", "seq_z", *outs)


def latency(event_id: Column) -> Column:
    """Stand-in request latency in seconds."""
    return (event_id % 5000) / F.lit(1000.0)


def request_log(spark: SparkSession, sf_dir: str, batch: DataFrame | None = None,
                stats: DataFrame | None = None) -> DataFrame:
    """One record for each request: (id, ts, features, prediction), the
    flattened scaled sequence and the ensemble's prediction."""
    return score_requests(spark, sf_dir, batch, stats).selectExpr(
        "event_id AS id", "ts", "flatten(seq_z) AS features", "ensemble AS prediction")


def prediction_log(spark: SparkSession, sf_dir: str, batch: DataFrame | None = None,
                   stats: DataFrame | None = None) -> DataFrame:
    """Long log (id, ts, model, prediction, latency_s): one record per model
    and request. The ensemble has no latency of its own (null)."""
    s = score_requests(spark, sf_dir, batch, stats)
    parts = ", ".join(f"'{n}', `{n}`" for n in MODEL_NAMES + ["ensemble"])
    return s.selectExpr("event_id AS id", "ts", f"stack({len(MODEL_NAMES) + 1}, {parts}) AS (model, prediction)") \
            .withColumn("latency_s", F.when(F.col("model") != "ensemble", latency(F.col("id"))))


def request_metrics(log: DataFrame, invalid: DataFrame | None = None) -> DataFrame:
    """Per model: count, latency sum (null for a model without latencies), cumulative latency buckets (<= bound,
    then +Inf), last prediction by (ts, id); plus the validation error count."""
    lat = F.col("latency_s")
    aggs = [F.count(F.lit(1)).alias("n_predictions"), F.sum(lat).alias("latency_sum")]
    for b in LATENCY_BOUNDS:
        aggs.append(F.sum(F.when(lat.isNotNull(), (lat <= F.lit(b)).cast("int"))).cast("long")
                    .alias("le_" + str(b).replace(".", "_")))
    aggs.append(F.nullif(F.count(lat), F.lit(0)).cast("long").alias("le_inf"))
    aggs.append(F.max_by("prediction", F.struct("ts", "id")).alias("last_value"))
    m = log.groupBy("model").agg(*aggs)
    if invalid is not None:
        m = m.crossJoin(invalid.agg(F.count(F.lit(1)).alias("validation_errors")))
    return m
