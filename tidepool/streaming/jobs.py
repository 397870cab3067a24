"""Structured Streaming jobs for the prediction path and its monitoring.

* ``ingest_requests``: file stream of requests -> validation -> append sink.
* ``last_n_stream``: the newest N records (FIFO window) kept across
  micro-batches in ``foreachBatch``; order is by (ts, id), never by arrival,
  so the result does not depend on how records are split into batches.
* ``drift_cuts_stream``: drift checks at multiples of the interval in event
  time, whatever the micro-batches.
* ``drift_check_stream``: the same window plus a periodic drift check when
  the window holds at least min(100, N // 2) records and more than the check
  interval (event time) has passed since the last check.
* ``metrics_stream``: hourly request metrics per model; every batch writes
  partial aggregates, and the view adds them up.

Every job takes its checkpoint and state folders under the shared checkpoint
directory, is idempotent per batch id (state versions are written by batch
id with overwrite), and so survives a restart from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.operators.sequence import with_positions
from tidepool.operators.validate import sequence_error

# fixed values
CHECK_INTERVAL = timedelta(hours=1)


def _run(query_builder, name: str, checkpoint: str) -> None:
    q = query_builder.option("checkpointLocation", f"{checkpoint}/{name}") \
                     .trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:  # pragma: no cover - surfaced to caller
        raise RuntimeError(str(q.exception()))


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stage_slices(df: DataFrame, path: str, time_col: str, bounds: Sequence[str]) -> None:
    """Land ``df`` as consecutive time slices (one append each), the way
    records arrive over time. ``bounds`` are the slice edges (ISO text); rows
    without a time arrive last."""
    edges = [None, *bounds, None]
    t = F.col(time_col)
    for lo, hi in zip(edges[:-1], edges[1:]):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (t >= F.lit(lo).cast("timestamp"))
        if hi is not None:
            cond = cond & (t < F.lit(hi).cast("timestamp"))
        else:
            cond = cond | t.isNull()
        df.filter(cond).write.mode("append").parquet(path)


# ------------------------------------------------------------------ T1 ingest

def ingest_requests(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: T.StructType,
                    look_back: int, width: int, seq_col: str = "sequence") -> DataFrame:
    """Validated requests appended to ``sink`` (exactly-once file sink)."""
    s = file_stream(spark, source, schema).withColumn("error_code", sequence_error(F.col(seq_col), look_back, width))
    _run(s.writeStream.format("parquet").option("path", sink).outputMode("append"), "ingest", checkpoint)
    return spark.read.parquet(sink)


# ------------------------------------------------------------------ T2 / T3 window state

def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _previous_version(spark: SparkSession, state: str, batch_id: int, schema: T.StructType) -> DataFrame:
    """Window after the previous batch. Batch ids are consecutive and a
    replayed batch overwrites its own version, so v=(id-1) is the input."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    # a lost version is an error: going on without it would forget n records
    return spark.read.schema(schema).parquet(f"{state}/v={batch_id - 1}")


def _final_version(spark: SparkSession, state: str, schema: T.StructType) -> DataFrame:
    try:
        top = spark.read.parquet(state).agg(F.max("v")).first()[0]      # from the folder names
    except AnalysisException:
        return spark.createDataFrame([], schema)
    if top is None:                                                     # only empty windows were written
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{state}/v={top}")


def _keep_newest(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def last_n_stream(spark: SparkSession, source: str, state: str, checkpoint: str, schema: T.StructType,
                  n: int, order: Sequence[str] = ("ts", "id"),
                  on_window: Callable[[DataFrame, int, DataFrame], None] | None = None) -> DataFrame:
    """Keep the newest ``n`` records by ``order``; returns the final window."""
    def step(batch: DataFrame, batch_id: int) -> None:
        prev = _previous_version(spark, state, batch_id, schema)
        window = _keep_newest(prev.unionByName(batch.select(*schema.fieldNames())), n, order)
        window.write.mode("overwrite").parquet(f"{state}/v={batch_id}")
        if on_window is not None:
            on_window(spark.read.schema(schema).parquet(f"{state}/v={batch_id}"), batch_id, batch)

    _run(file_stream(spark, source, schema).writeStream.foreachBatch(step), "last_n", checkpoint)
    return _final_version(spark, state, schema)


CHECK_SCHEMA = T.StructType([
    T.StructField("batch_id", T.LongType()), T.StructField("check_ts", T.TimestampType()),
    T.StructField("window_size", T.LongType()), T.StructField("status", T.StringType()),
    T.StructField("drift_share", T.DoubleType()), T.StructField("dataset_drift", T.BooleanType()),
    T.StructField("severity", T.StringType()),
])
BOUNDARY_SCHEMA = T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("check_ts", T.TimestampType())])
START_SCHEMA = T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("start_ts", T.TimestampType())])


def drift_check_stream(spark: SparkSession, source: str, state: str, checkpoint: str, schema: T.StructType,
                       n: int, check: Callable[[DataFrame], DataFrame], order: Sequence[str] = ("ts", "id"),
                       interval: timedelta = CHECK_INTERVAL) -> DataFrame:
    """Window state as in ``last_n_stream``; after each batch a drift check
    runs when due. ``check(window)`` returns the one-row verdict of
    ``tidepool.operators.drift.check_drift``. Returns the check log. Until a
    first check is logged the clock runs from the stream's start, the oldest
    time of the first batch that has one, which is written beside the log."""
    checks, starts = f"{state}-checks", f"{state}-start"
    min_size = min(100, n // 2)

    def on_window(window: DataFrame, batch_id: int, batch: DataFrame) -> None:
        oldest, now = batch.agg(F.min(order[0]), F.max(order[0])).first()
        if now is None:
            return
        before = F.col("batch_id") < batch_id
        # not from the window, which holds the newest n records only
        start = _read_or_empty(spark, starts, START_SCHEMA).filter(before).agg(F.min("start_ts")).first()[0]
        if start is None:
            start = oldest
            spark.createDataFrame([(batch_id, start)], START_SCHEMA).write.mode("overwrite").parquet(f"{starts}/batch={batch_id}")
        size = window.count()                                   # <= n
        if size < min_size:
            return
        last = _read_or_empty(spark, checks, CHECK_SCHEMA).filter(before).agg(F.max("check_ts")).first()[0] or start
        if now - last <= interval:
            return
        v = check(window).first()
        row = (batch_id, now, size, v["status"], v["drift_share"], v["dataset_drift"], v["severity"])
        spark.createDataFrame([row], CHECK_SCHEMA).write.mode("overwrite").parquet(f"{checks}/batch={batch_id}")

    last_n_stream(spark, source, state, checkpoint, schema, n, order, on_window)
    return _read_or_empty(spark, checks, CHECK_SCHEMA)


def drift_cuts_stream(spark: SparkSession, source: str, state: str, checkpoint: str, schema: T.StructType, n: int,
                      check: Callable[[DataFrame], DataFrame], order: Sequence[str] = ("ts", "id"),
                      interval: timedelta = CHECK_INTERVAL, files_per_batch: int = 8) -> DataFrame:
    """A drift check at every cut of event time (a multiple of ``interval``)
    that follows an interval with records, over the newest ``n`` records before
    the cut, if these are min(100, n // 2) at least. A cut is due when a record
    at or after it has come, so the checks do not depend on how the records
    are split into batches; a record that comes after its cuts were checked counts
    for later cuts only. Records without a time take no part.

    All due cuts of a batch are checked together: ``check(windows)`` gets the
    records of all their windows, with the cut as ``check_ts``, and returns rows
    with a ``check_ts``. Returns the log: these rows and ``window_size``.

    Kept between batches: the newest n records before the last cut, and those after it.
    """
    checks, cuts = f"{state}-cuts", f"{state}-boundary"
    seconds = int(interval.total_seconds())
    ts, min_size = F.col(order[0]), min(100, n // 2)
    whole = lambda t: F.timestamp_seconds(F.floor(F.unix_micros(t) / (seconds * 1_000_000)) * seconds)

    def step(batch: DataFrame, batch_id: int) -> None:
        prev = _previous_version(spark, state, batch_id, schema)
        rows = prev.unionByName(batch.select(*schema.fieldNames())).filter(ts.isNotNull())
        numbered = with_positions(rows.withColumn("_one", F.lit(0)), ["_one"], order[0], list(order[1:]), seconds, "_pos").drop("_one")
        path = f"{state}-numbered/v={batch_id}"
        numbered.write.mode("overwrite").parquet(path)
        numbered = spark.read.parquet(path)
        done = _read_or_empty(spark, cuts, BOUNDARY_SCHEMA).filter(F.col("batch_id") < batch_id).agg(F.max("check_ts")).first()[0]
        last = numbered.agg(F.max(whole(ts))).first()[0]
        kept = numbered
        if last is not None and (done is None or last > done):
            ends = numbered.filter(ts < F.lit(last)).groupBy((whole(ts) + F.lit(interval)).alias("check_ts")).agg(
                (F.max("_pos") + 1).alias("_end"))
            due = (ends if done is None else ends.filter(F.col("check_ts") > F.lit(done))).withColumn(
                "window_size", F.least("_end", F.lit(n))).filter(F.col("window_size") >= min_size)
            # a window covers two blocks of n positions at most
            blocks = due.withColumn("_block", F.explode(F.sequence(
                F.floor((F.col("_end") - F.col("window_size")) / n), F.floor((F.col("_end") - 1) / n))))
            windows = numbered.withColumn("_block", F.floor(F.col("_pos") / n)).join(blocks, "_block").filter(
                (F.col("_pos") < F.col("_end")) & (F.col("_pos") >= F.col("_end") - F.col("window_size")))
            out = check(windows.drop("_block", "_pos", "_end", "window_size")).join(due.select("check_ts", "window_size"), "check_ts")
            out.write.mode("overwrite").parquet(f"{checks}/batch={batch_id}")
            spark.createDataFrame([(batch_id, last)], BOUNDARY_SCHEMA).write.mode("overwrite").parquet(f"{cuts}/batch={batch_id}")
            before = numbered.filter(ts < F.lit(last)).agg(F.coalesce(F.max("_pos") + 1, F.lit(0))).first()[0]
            kept = numbered.filter(F.col("_pos") >= before - n)
        kept.drop("_pos").write.mode("overwrite").parquet(f"{state}/v={batch_id}")

    _run(file_stream(spark, source, schema, files_per_batch).writeStream.foreachBatch(step), "drift_cuts", checkpoint)
    try:
        return spark.read.parquet(checks).drop("batch")
    except AnalysisException:                   # no cut was due
        return check(spark.createDataFrame([], schema).withColumn("check_ts", ts.cast("timestamp"))).withColumn(
            "window_size", F.lit(0).cast("long"))


# ------------------------------------------------------------------ T5 metrics

def metrics_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: T.StructType,
                   aggs: Sequence, keys: Sequence[str] = ("model",), time_col: str = "ts",
                   every: str = "1 hour", files_per_batch: int = 8) -> DataFrame:
    """Counts and sums by time window. Each batch writes its own partial
    aggregates under ``sink`` and the view adds them up, so a row counts
    however late it comes and no state is kept between batches. Aggregates
    must be additive. Rows without a time have a null window."""
    names: list[str] = []

    def partial(batch: DataFrame, batch_id: int) -> None:
        t = F.col(time_col).cast("timestamp")
        # a plain truncation to the window: F.window() would drop null times
        start = F.window(F.coalesce(t, F.timestamp_seconds(F.lit(0))), every).getField("start")
        part = (batch.withColumn("_t", t).withColumn("window_start", F.when(F.col("_t").isNotNull(), start))
                     .groupBy("window_start", *keys).agg(*aggs))
        names[:] = [c for c in part.columns if c not in ("window_start", *keys)]
        part.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    _run(file_stream(spark, source, schema, files_per_batch).writeStream.foreachBatch(partial), "metrics", checkpoint)
    log = spark.read.parquet(sink)
    cols = names or [c for c in log.columns if c not in ("window_start", "batch", *keys)]
    return log.groupBy("window_start", *keys).agg(*[F.sum(c).alias(c) for c in cols])
