"""Streaming plans over data derived from the events table.

Inputs are landed as weekly slices (one file set per week, appended in time
order) under the shared checkpoint folder and read back as file streams, a few
files per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators.drift_summary import reference_summary, windows_drift, windows_verdict
from tidepool.operators.validate import validate_sequences
from tidepool.plans import monitor as mon
from tidepool.session import materialize, scratch_path
from tidepool.streaming.jobs import (drift_cuts_stream, ingest_requests, last_n_stream, metrics_stream,
                                     stage_slices)
from tidepool.streaming.keyed import newest_per_key_stream
from tidepool.streaming.serving import counter, gauge, histogram, metrics_stream_by, score_stream, total

# fixed values: weekly slice edges of the January 2024 events
WEEKS = ["2024-01-08", "2024-01-15", "2024-01-22"]

DRIFT_NUMERIC = ["value", "k", "user_id", "hour"]
DRIFT_CATEGORICAL = ["event_type"]
DRIFT_METHOD = {"value": "ks", "k": "wasserstein", "user_id": "ks", "hour": "wasserstein"}


def _landed(spark: SparkSession, df: DataFrame, name: str, time_col: str = "ts") -> tuple[str, object]:
    src = scratch_path(spark, f"{name}-landing")
    # computed once, then landed slice by slice
    stage_slices(materialize(df, f"{name}-source"), src, time_col, WEEKS)
    return src, df.schema


def batch_files(spark: SparkSession) -> int:
    """Files of a micro-batch: two for every core, so that no core is idle and the
    fixed costs of a batch are paid less often. Results do not depend on it."""
    return max(8, 2 * spark.sparkContext.defaultParallelism)


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, schema = _landed(spark, mon.requests(spark, sf_dir), "requests")
    out = ingest_requests(spark, src, scratch_path(spark, "requests-sink"), scratch_path(spark, "ckpt"),
                          schema, mon.LOOK_BACK, len(mon.EV_FEATURES))
    return out.select("event_id", "error_code")


def monitored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = mon.events(spark, sf_dir)
    return e.select("event_id", "ts", "value", "k", F.col("user_id").cast("double").alias("user_id"),
                    F.hour("ts").cast("double").alias("hour"), "event_type")


def stream_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, schema = _landed(spark, monitored_events(spark, sf_dir), "events")
    return last_n_stream(spark, src, scratch_path(spark, "window"), scratch_path(spark, "ckpt"), schema,
                         mon.WINDOW_SIZE, ("ts", "event_id"))


def stream_drift_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly checks of the newest records against the stored summary of the reference period."""
    ev = monitored_events(spark, sf_dir)
    src, schema = _landed(spark, ev, "events")
    ref = ev.filter(F.col("ts") < F.lit(mon.fx.DRIFT_CUT).cast("timestamp"))
    summary = materialize(reference_summary(ref, DRIFT_NUMERIC, DRIFT_CATEGORICAL), "reference-summary")

    def check(windows: DataFrame) -> DataFrame:
        columns = windows_drift(summary, windows, "check_ts", DRIFT_NUMERIC, DRIFT_CATEGORICAL, DRIFT_METHOD)
        return windows_verdict(columns, "check_ts")

    return drift_cuts_stream(spark, src, scratch_path(spark, "window"), scratch_path(spark, "ckpt"), schema,
                             mon.WINDOW_SIZE, check, ("ts", "event_id"))


def stream_last_n_by_model(spark: SparkSession, sf_dir: str, n: int = 100) -> DataFrame:
    """The newest n predictions of every model, from the state store."""
    # from the written requests: a filter on them would build every broken sequence again for each check
    log = mon.prediction_log(spark, sf_dir, mon.validated_table(spark, sf_dir))
    src, schema = _landed(spark, log, "prediction-log")
    return newest_per_key_stream(spark, src, scratch_path(spark, "ckpt"), schema, "model", n, ("ts", "id"),
                                 files_per_batch=batch_files(spark))


def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = mon.prediction_log(spark, sf_dir)
    src, schema = _landed(spark, log, "prediction-log")
    aggs = [F.count(F.lit(1)).alias("n_predictions"), F.sum("latency_s").alias("latency_sum"),
            F.sum("prediction").alias("prediction_sum")]
    return metrics_stream(spark, src, scratch_path(spark, "metrics"), scratch_path(spark, "ckpt"), schema, aggs)


def stored_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model state that serving reads: the scaler as a table, one row."""
    return materialize(mon.fitted(spark, sf_dir), "scaler")


def checked(batch: DataFrame) -> DataFrame:
    return validate_sequences(batch, "sequence", mon.LOOK_BACK, len(mon.EV_FEATURES))


def stream_prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests validated, scaled, scored and logged by one streaming query."""
    src, schema = _landed(spark, mon.requests(spark, sf_dir), "requests")
    stats = stored_scaler(spark, sf_dir)
    return score_stream(spark, src, scratch_path(spark, "prediction-log"), scratch_path(spark, "ckpt"), schema,
                        lambda requests: mon.request_log(spark, sf_dir, checked(requests), stats))


def stream_request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request counter, latency histogram, last prediction by model and the
    counter of invalid requests, from the stream of requests."""
    src, schema = _landed(spark, mon.requests(spark, sf_dir), "requests")
    stats = stored_scaler(spark, sf_dir)

    def served(batch: DataFrame) -> DataFrame:
        batch = checked(batch)
        invalid = batch.filter("error_code IS NOT NULL").selectExpr(
            "event_id AS id", "ts", "CAST(NULL AS STRING) AS model", "CAST(NULL AS DOUBLE) AS prediction",
            "CAST(NULL AS DOUBLE) AS latency_s")
        return mon.prediction_log(spark, sf_dir, batch, stats).unionByName(invalid)

    latency, model = F.col("latency_s"), F.col("model")
    metrics = [counter("n_predictions", model.isNotNull()), total("latency_sum", latency),
               *histogram("le", latency, mon.LATENCY_BOUNDS), gauge("last", F.col("prediction"), ("ts", "id")),
               counter("validation_errors", model.isNull())]
    out = metrics_stream_by(spark, src, scratch_path(spark, "metrics"), scratch_path(spark, "ckpt"), schema, ["model"],
                            metrics, served, files_per_batch=batch_files(spark), compact_every=4)
    buckets = [m.name for m in metrics if m.name.startswith("le_")]
    no_latency = F.col("le_inf") == 0                    # a model without latencies has no histogram
    errors = out.agg(F.coalesce(F.sum("validation_errors"), F.lit(0)).alias("validation_errors"))     # one row
    return out.filter("model IS NOT NULL").select(
        "model", "n_predictions", "latency_sum", *[F.when(~no_latency, F.col(c)).alias(c) for c in buckets],
        F.col("last.value").alias("last_value")).crossJoin(F.broadcast(errors))
