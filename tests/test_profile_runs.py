import datetime as dt

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidepool.operators.profile import (column_info, count_distinct, describe, distinct_values, histogram, overview,
                                        seeded_sample, top_k, value_counts)
from tidepool.operators.runs import best_runs, run_records


@pytest.fixture
def df(spark):
    rows = [(i, "A" if i % 3 else None, dt.date(2024, 1, 1) + dt.timedelta(days=i),
             float(i % 7) if i % 11 else float("nan")) for i in range(1, 60)]
    return spark.createDataFrame(rows, "row_id long, t string, d date, x double")


def test_overview_and_info(df):
    o = overview(df, "d").first()
    assert o["n_rows"] == 59 and o["n_cols"] == 4 and o["n_missing"] == 19 + 5
    info = {r["column"]: (r["dtype"], r["non_null"]) for r in column_info(df).collect()}
    assert info["x"] == ("double", 54) and info["t"] == ("string", 40)


def test_distinct_keeps_null_count_does_not(df):
    assert distinct_values(df, "t").count() == 2
    assert count_distinct(df, "t").first()["n_unique"] == 1


def test_describe_sample_std(spark):
    d = describe(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double"), "x").first()
    assert d["std"] == pytest.approx(1.5275252, rel=1e-6) and d["q50"] == 2.0 and d["q25"] == 1.5


def test_histogram_last_bin_closed_and_empty_bins(spark):
    xs = [0.0, 0.0, 1.0, 10.0]
    h = histogram(spark.createDataFrame([(x,) for x in xs], "x double"), "x", 5).orderBy("bin").collect()
    assert [r["n"] for r in h] == [3, 0, 0, 0, 1]
    assert list(np.histogram(xs, 5)[0]) == [3, 0, 0, 0, 1]


def test_topk_value_counts_sample(df):
    small = top_k(df, "x", 3).collect()
    assert [r["row_id"] for r in small] == [7, 14, 21]          # ties by id, NaN excluded
    big = top_k(df, "x", 3, largest=True).collect()
    assert [r["x"] for r in big] == [6.0, 6.0, 6.0]
    vc = value_counts(df, "t", 10).collect()
    assert vc[0]["t"] == "A" and vc[0]["n"] == 40
    s1 = sorted(r["row_id"] for r in seeded_sample(df, 10).collect())
    s2 = sorted(r["row_id"] for r in seeded_sample(df.repartition(7), 10).collect())
    assert s1 == s2 and len(s1) == 10
    assert seeded_sample(df, 1000).count() == 59


def test_run_log(spark):
    m = spark.createDataFrame([("test", "a", 2.0, 4.0), ("test", "b", 1.0, 1.0), ("val", "a", 3.0, 9.0)],
                              "split string, model string, mae double, mse double")
    runs = run_records(m, {"look_back": "20"})
    r = {x["model"]: x for x in runs.collect()}
    assert r["a"]["metrics"] == {"test_mae": 2.0, "test_mse": 4.0, "val_mae": 3.0, "val_mse": 9.0}
    assert r["a"]["params"] == {"look_back": "20"} and r["a"]["scale"] == "original"
    assert [x["model"] for x in best_runs(runs, "test_mae").orderBy("rank").collect()] == ["b", "a"]


def test_all_runs_are_ranked(spark):
    """1,500 runs, a third of them with one error, some without the metric."""
    import random
    rng = random.Random(1)
    errors = [(f"run{i:04d}", 0.5 if i % 3 == 0 else None if i % 50 == 1 else rng.random()) for i in range(1500)]
    runs = spark.createDataFrame([(n, "m", {"other": 1.0} if e is None else {"test_mae": e}) for n, e in errors],
                                 "run_name string, model string, metrics map<string,double>").repartition(7)
    want = sorted(errors, key=lambda r: (r[1] is None, r[1] or 0.0, r[0]))
    got = best_runs(runs, "test_mae").orderBy("rank").collect()
    assert [(r["run_name"], r["test_mae"]) for r in got] == want and [r["rank"] for r in got] == list(range(1, 1501))
    assert [r["run_name"] for r in best_runs(runs, "test_mae", top=20).orderBy("rank").collect()] == [n for n, _ in want[:20]]
    assert best_runs(runs.limit(0), "test_mae").count() == 0


def test_global_rank_has_no_single_task_window(spark):
    from tidepool.operators.runs import global_rank
    ranked = global_rank(spark.range(100).withColumn("x", F.col("id") % 7), [F.col("x"), F.col("id").desc()])
    assert "Window" not in ranked._jdf.queryExecution().toString()
    got = [r["id"] for r in ranked.orderBy("rank").collect()]
    assert got == sorted(range(100), key=lambda i: (i % 7, -i))


def test_seeded_sample_of_large_ids(spark):
    df = spark.createDataFrame([(10**12 + i,) for i in range(30)] + [(4_500_000_000,), (-5,)], "row_id long")
    assert seeded_sample(df, 12).count() == 12 and seeded_sample(df, 100).count() == 32
