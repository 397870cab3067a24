"""Keyed state, event-time checks, streaming scoring and mergeable metrics on literal frames."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidepool.session import scratch_path
from tidepool.streaming.jobs import drift_cuts_stream
from tidepool.streaming.keyed import newest_per_key_stream
from tidepool.streaming.serving import counter, gauge, histogram, metrics_stream_by, score_stream, total

START = dt.datetime(2024, 1, 1)


def paths(spark, *names):
    return [scratch_path(spark, n) for n in names]


def land(spark, rows, schema, src, files=1):
    spark.createDataFrame(rows, schema).repartition(files).write.mode("append").parquet(src)


def test_newest_per_key_over_batches_and_restart(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        model = "hot" if i % 3 else rng.choice(["a", "b", None])        # two thirds on one key
        ts = None if i % 40 == 0 else START + dt.timedelta(microseconds=rng.randrange(10**9))
        rows.append((model, ts, i // 2, float("nan") if i % 11 == 0 else i / 7))
    rows += rows[:5]                                                     # repeated rows
    schema = spark.createDataFrame([], "model string, ts timestamp, id long, v double").schema
    src, ckpt = paths(spark, "src", "ckpt")

    def newest(rows, n):
        by = {}
        for r in rows:
            by.setdefault(r[0], []).append((r[1] or dt.datetime.min, r[2]))
        return {m: sorted(v, reverse=True)[:n] for m, v in by.items()}

    def run():
        out = newest_per_key_stream(spark, src, ckpt, schema, "model", 6, salts=3, files_per_batch=1)
        got = {}
        for r in out.orderBy("rank").collect():
            got.setdefault(r.model, []).append((r.ts or dt.datetime.min, r.id))
            assert r.rank == len(got[r.model])
        return got

    land(spark, rows[:150], schema, src, 2)
    assert run() == newest(rows[:150], 6)
    land(spark, rows[150:], schema, src)            # a restart goes on from the checkpoint
    assert run() == newest(rows, 6)
    assert run() == newest(rows, 6)


def cut_frame(spark):
    """Records of ten hours, none in the fifth, ties in time."""
    rows = [(START + dt.timedelta(hours=h, minutes=(7 * i) % 60), 100 * h + i, float(h)) for h in range(10) if h != 4 for i in range(12)]
    rows += [(None, 5000, 1.0)]
    return rows, spark.createDataFrame([], "ts timestamp, id long, v double").schema


def expected_cuts(rows, n):
    rows = sorted((r for r in rows if r[0]), key=lambda r: r[:2])
    hours = sorted({r[0].replace(minute=0) for r in rows})
    out = []
    for h in hours[:-1]:
        cut = h + dt.timedelta(hours=1)
        window = [r for r in rows if r[0] < cut][-n:]
        if len(window) >= min(100, n // 2):
            out.append((cut, len(window), sum(r[1] for r in window)))
    return out


def test_checks_at_cuts_do_not_depend_on_batches(spark):
    rows, schema = cut_frame(spark)
    check = lambda w: w.groupBy("check_ts").agg(F.sum("id").alias("ids"))
    want = expected_cuts(rows, 30)
    assert len(want) == 7
    for splits in ([len(rows)], [5, 20, 21, 60, 90, len(rows)]):
        src, state, ckpt = paths(spark, "src", "state", "ckpt")
        at = 0
        for end in splits:                          # a batch, and a restart, for each part
            land(spark, rows[at:end], schema, src)
            at = end
            log = drift_cuts_stream(spark, src, state, ckpt, schema, 30, check)
        got = sorted((r.check_ts, r.window_size, r.ids) for r in log.collect())
        assert got == want


def test_no_cut_is_due(spark):
    rows, schema = cut_frame(spark)
    src, state, ckpt = paths(spark, "src", "state", "ckpt")
    land(spark, rows[:12], schema, src)             # one hour, not over yet
    log = drift_cuts_stream(spark, src, state, ckpt, schema, 30, lambda w: w.groupBy("check_ts").agg(F.sum("id").alias("ids")))
    assert log.count() == 0 and set(log.columns) == {"check_ts", "ids", "window_size"}


def test_each_request_is_scored_once(spark):
    schema = spark.createDataFrame([], "id long, x double").schema
    scale = spark.createDataFrame([(2.0, 4.0)], "mean double, std double")
    score = lambda q: q.filter("x IS NOT NULL").crossJoin(F.broadcast(scale)).select("id", ((F.col("x") - F.col("mean")) / F.col("std")).alias("z"))
    src, log, ckpt = paths(spark, "src", "log", "ckpt")
    land(spark, [(i, None if i % 5 == 0 else float(i)) for i in range(20)], schema, src, 3)
    run = lambda: sorted((r.id, r.z) for r in score_stream(spark, src, log, ckpt, schema, score, 1).collect())
    assert run() == [(i, (i - 2) / 4) for i in range(20) if i % 5]
    land(spark, [(100, 2.0)], schema, src)
    want = [(i, (i - 2) / 4) for i in range(20) if i % 5] + [(100, 0.0)]
    assert run() == want and run() == want


def test_metrics_merge_over_batches_folds_and_restarts(spark):
    schema = spark.createDataFrame([], "m string, ts long, id long, lat double, y double").schema
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, *range(9)]), i, rng.choice([None, 0.05, 0.2, 3.0, 9.0]), i / 3) for i in range(60)]
    metrics = [counter("n", F.lit(True)), total("lat_sum", F.col("lat")), *histogram("le", F.col("lat"), [0.1, 2.5]),
               gauge("last", F.col("y"), ("ts", "id"))]
    src, sink, ckpt = paths(spark, "src", "sink", "ckpt")
    for at in range(0, 60, 10):
        land(spark, rows[at:at + 10], schema, src)
        if at in (20, 50):                          # three batches, fold after two; then three more
            out = metrics_stream_by(spark, src, sink, ckpt, schema, ["m"], metrics, files_per_batch=1, compact_every=2)
    assert spark.read.parquet(f"{sink}-folded").agg(F.count_distinct("through")).first()[0] == 3
    got = {r.m: r for r in out.collect()}
    for m in ("a", "b", None):
        own = [r for r in rows if r[0] == m]
        lat = [r[3] for r in own if r[3] is not None]
        r = got[m]
        assert (r.n, r.le_0_1, r.le_2_5, r.le_inf) == (len(own), sum(x <= 0.1 for x in lat), sum(x <= 2.5 for x in lat), len(lat))
        assert abs(r.lat_sum - sum(lat)) < 1e-9
        assert r["last"]["value"] == max(own, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))[4]


def test_state_has_no_more_partitions_than_salts_or_cores(spark):
    schema = spark.createDataFrame([], "model string, ts timestamp, id long").schema
    src, ckpt = paths(spark, "src", "ckpt")
    land(spark, [("a", START, i) for i in range(30)], schema, src)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        out = newest_per_key_stream(spark, src, ckpt, schema, "model", 3, salts=2)
        assert [r.id for r in out.orderBy("rank").collect()] == [29, 28, 27]
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = {r.numPartitions for r in spark.read.format("state-metadata").load(f"{ckpt}/newest").collect()}
    assert got == {max(2, spark.sparkContext.defaultParallelism)}


def test_request_metrics_batches_use_the_cores(spark, monkeypatch):
    import os

    import pytest

    from tidepool.plans import streams
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver tables not present")
    seen = []

    def run(*args, files_per_batch, **kw):
        seen.append(files_per_batch)
        return metrics_stream_by(*args, files_per_batch=files_per_batch, **kw)

    monkeypatch.setattr(streams, "metrics_stream_by", run)
    got = {r.model: r.n_predictions for r in streams.stream_request_metrics(spark, sf).collect()}
    assert seen[0] >= 2 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(streams, "batch_files", lambda spark: 1)            # the batches do not matter
    assert {r.model: r.n_predictions for r in streams.stream_request_metrics(spark, sf).collect()} == got and seen[1] == 1
