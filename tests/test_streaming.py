"""Streaming jobs against their batch twins on the smallest driver tables."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidepool.plans import monitor as mon
from tidepool.plans import streams
from tidepool.operators.windows import last_n

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_stream_last_n_equals_batch(spark):
    s = sorted(r["event_id"] for r in streams.stream_last_n(spark, SF).collect())
    b = sorted(r["event_id"] for r in last_n(mon.events(spark, SF), mon.WINDOW_SIZE, ["ts", "event_id"]).collect())
    assert s == b and len(s) == min(1000, mon.events(spark, SF).count())


def test_stream_ingest_equals_batch(spark):
    s = {(r["event_id"], r["error_code"]) for r in streams.stream_ingest(spark, SF).collect()}
    b = {(r["event_id"], r["error_code"]) for r in mon.validated(spark, SF).collect()}
    assert s == b


def test_stream_metrics_equals_batch(spark):
    s = {(r["window_start"], r["model"], r["n_predictions"]) for r in streams.stream_metrics(spark, SF).collect()}
    log = mon.prediction_log(spark, SF)
    b = {(r["w"].start, r["model"], r["n"]) for r in
         log.groupBy(F.window("ts", "1 hour").alias("w"), "model").agg(F.count("*").alias("n")).collect()}
    assert s == b


def test_stream_drift_checks(spark):
    """One check for each hour with events, but for the first few and the last."""
    ev = streams.monitored_events(spark, SF)
    hours = sorted(r[0] for r in ev.select(F.date_trunc("hour", "ts")).distinct().collect())
    checks = streams.stream_drift_check(spark, SF).orderBy("check_ts").collect()
    ts = [c["check_ts"] for c in checks]
    assert len(ts) > 100 and ts == [h + dt.timedelta(hours=1) for h in hours[:-1]][-len(ts):]
    sizes = [c["window_size"] for c in checks]
    assert sizes == sorted(sizes) and sizes[0] >= 100 and sizes[-1] <= 1000
    assert all(c["n_columns"] == 5 and c["drift_share"] == c["n_drifted"] / 5 for c in checks)


def test_last_n_stream_restarts_from_checkpoint(spark):
    """A second run over the same checkpoint processes nothing and keeps the
    window; newly landed files are picked up incrementally."""
    from pyspark.sql import types as T

    from tidepool.session import scratch_path
    from tidepool.streaming.jobs import last_n_stream
    schema = T.StructType([T.StructField("ts", T.LongType()), T.StructField("id", T.LongType())])
    src, state, ckpt = (scratch_path(spark, n) for n in ("src", "state", "ckpt"))
    spark.createDataFrame([(i, i) for i in range(30)], schema).write.mode("append").parquet(src)
    first = sorted(r["id"] for r in last_n_stream(spark, src, state, ckpt, schema, 10).collect())
    assert first == list(range(20, 30))
    again = sorted(r["id"] for r in last_n_stream(spark, src, state, ckpt, schema, 10).collect())
    assert again == first
    spark.createDataFrame([(i, i) for i in range(30, 35)], schema).write.mode("append").parquet(src)
    more = sorted(r["id"] for r in last_n_stream(spark, src, state, ckpt, schema, 10).collect())
    assert more == list(range(25, 35))


def test_rows_without_a_time_and_late_rows_count(spark):
    import datetime as dt

    from tidepool.session import scratch_path
    from tidepool.streaming.jobs import metrics_stream, stage_slices
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    df = spark.createDataFrame([("m", at(20, 1), 1.0), ("m", at(2, 1), 2.0), ("m", None, 4.0), ("m", at(9, 5), 8.0)],
                               "model string, ts timestamp, v double")
    src, sink, ckpt = (scratch_path(spark, n) for n in ("src", "sink", "ckpt"))
    stage_slices(df, src, "ts", ["2024-01-08"])
    assert spark.read.parquet(src).count() == 4
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("v").alias("v")]
    first = metrics_stream(spark, src, sink, ckpt, df.schema, aggs)
    assert sorted((r["n"], r["v"]) for r in first.collect()) == [(1, 1.0), (1, 2.0), (1, 4.0), (1, 8.0)]
    spark.createDataFrame([("m", at(2, 1), 16.0)], df.schema).write.mode("append").parquet(src)      # very late
    more = metrics_stream(spark, src, sink, ckpt, df.schema, aggs)
    assert sorted((r["n"], r["v"]) for r in more.collect()) == [(1, 1.0), (1, 4.0), (1, 8.0), (2, 18.0)]


def test_drift_check_runs_when_the_window_spans_minutes(spark):
    """A record a second for six hours: the newest 1000 span 17 minutes, less
    than the interval. The clock runs from the stream's start, over a restart too."""
    import datetime as dt

    from tidepool.session import scratch_path
    from tidepool.streaming.jobs import drift_check_stream
    src, state, ckpt = (scratch_path(spark, n) for n in ("src", "state", "ckpt"))
    begin = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    df = spark.range(6 * 3600).select(F.timestamp_seconds(F.col("id") + begin).alias("ts"), "id")
    verdict = spark.createDataFrame([("success", 0.0, False, "none")],
                                    "status string, drift_share double, dataset_drift boolean, severity string")
    def land(hours):        # eight files, one batch, an hour
        for h in hours:
            df.filter(F.floor(F.col("id") / 3600) == h).repartition(8).write.mode("append").parquet(src)
    run = lambda: drift_check_stream(spark, src, state, ckpt, df.schema, 1000, lambda w: verdict, ("ts", "id"))
    land([0])
    assert run().count() == 0
    land(range(1, 6))
    log = run().orderBy("batch_id").collect()
    assert [(r["batch_id"], r["window_size"]) for r in log] == [(1, 1000), (3, 1000), (5, 1000)]
    assert all((b["check_ts"] - a["check_ts"]).total_seconds() == 7200 for a, b in zip(log, log[1:]))
