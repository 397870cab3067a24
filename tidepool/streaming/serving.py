"""Requests served as a stream: scored into a log, and measured.

* ``score_stream``: requests -> validation -> scaling -> scoring -> log, one
  streaming query with an exactly-once file sink.
* ``metrics_stream_by``: counters, histograms and gauges by key. Each batch
  writes one row of partial values for each key; partials merge by sum or by
  maximum, so a gauge is the maximum of (time, id, value). Every few batches the
  partials so far are folded into one table, so a view reads a bounded number of
  them however long the stream is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.streaming.jobs import _run, file_stream


def score_stream(spark: SparkSession, source: str, log: str, checkpoint: str, schema: T.StructType,
                 score: Callable[[DataFrame], DataFrame], files_per_batch: int = 8) -> DataFrame:
    """Append ``score(requests)`` to ``log``; returns the log. ``score`` is a
    plan without aggregates over the stream (validation, joins with static
    tables such as a scaler's, scoring); each request is logged once, over
    restarts too."""
    stream = score(file_stream(spark, source, schema, files_per_batch))
    _run(stream.writeStream.format("parquet").option("path", log).outputMode("append"), "score", checkpoint)
    return spark.read.schema(stream.schema).parquet(log)


@dataclass(frozen=True)
class Metric:
    """``partial`` is an aggregate over rows; partials merge by ``merge`` (sum or max)."""

    name: str
    partial: Column
    merge: str = "sum"


def counter(name: str, when: Column) -> Metric:
    return Metric(name, F.count(F.when(when, True)))


def total(name: str, value: Column) -> Metric:
    return Metric(name, F.sum(value))


def histogram(prefix: str, value: Column, bounds: Sequence[float]) -> list[Metric]:
    """Cumulative buckets ``value <= bound`` named <prefix>_<bound>, then <prefix>_inf."""
    out = [counter(f"{prefix}_{str(b).replace('.', '_')}", value <= F.lit(b)) for b in bounds]
    return [*out, counter(f"{prefix}_inf", value.isNotNull())]


def gauge(name: str, value: Column, order: Sequence[str]) -> Metric:
    """The value with the greatest ``order`` (read as <name>.value)."""
    return Metric(name, F.max(F.struct(*order, value.alias("value"))), "max")


def metrics_stream_by(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: T.StructType, keys: Sequence[str],
                      metrics: Sequence[Metric], prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch,
                      files_per_batch: int = 8, compact_every: int = 16) -> DataFrame:
    """Metrics by ``keys`` (null is a key) over ``prepare(batch)`` of all batches.

    A replayed batch overwrites its own partials and its own fold, so each
    request counts once; rows count however late they come."""
    folds = f"{sink}-folded"
    merged = [F.expr(f"{m.merge}(`{m.name}`)").alias(m.name) for m in metrics]

    def so_far(through: int | None) -> DataFrame:
        parts = spark.read.parquet(sink)
        if through is not None:
            parts = parts.filter(F.col("batch") <= through)
        try:
            old = spark.read.parquet(folds)
            last = old.filter(F.col("through") < F.lit(through)) if through is not None else old
            last = last.agg(F.max("through")).first()[0]                    # from the folder names
        except AnalysisException:
            last = None
        if last is not None:
            parts = parts.filter(F.col("batch") > last).drop("batch").unionByName(
                old.filter(F.col("through") == last).drop("through"))
        return parts.groupBy(*keys).agg(*merged)

    def step(batch: DataFrame, batch_id: int) -> None:
        part = prepare(batch).groupBy(*keys).agg(*[m.partial.alias(m.name) for m in metrics])
        part.coalesce(1).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            so_far(batch_id).write.mode("overwrite").parquet(f"{folds}/through={batch_id}")

    _run(file_stream(spark, source, schema, files_per_batch).writeStream.foreachBatch(step), "metrics", checkpoint)
    return so_far(None)
