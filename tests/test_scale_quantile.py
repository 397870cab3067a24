import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.functions.position import add_position_encoding, position_encoding_table
from tidepool.operators.quantile import exact_quantile_values
from tidepool.operators.scale import scaler_fit, scaler_inverse, scaler_long, scaler_transform, scaler_wide


def test_population_std_and_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "x double, c double")
    st = scaler_fit(df, ["x", "c"]).first()
    assert st["x__std"] == pytest.approx(1.2472191, rel=1e-6)        # population, not 1.5275 (sample)
    assert st["c__std"] == 1.0                                       # zero variance -> divide by 1
    z = scaler_transform(df, scaler_fit(df, ["x", "c"]), ["x", "c"]).collect()
    assert all(r["c"] == 0.0 for r in z)


def test_round_trip_and_long_form(spark):
    rng = np.random.default_rng(42)
    pdf = rng.normal(size=(200, 3)) * [1, 100, 0.01]
    df = spark.createDataFrame([tuple(map(float, r)) for r in pdf], "a double, b double, c double")
    stats = scaler_fit(df, ["a", "b", "c"])
    back = scaler_inverse(scaler_transform(df, stats, ["a", "b", "c"]), stats, ["a", "b", "c"])
    np.testing.assert_allclose(np.array(back.collect()), pdf, rtol=1e-9, atol=1e-9)
    again = scaler_wide(scaler_long(stats, ["a", "b", "c"]), ["a", "b", "c"]).first().asDict()
    assert again == stats.first().asDict()


def test_fit_on_train_only(spark):
    df = spark.createDataFrame([("train", 1.0), ("train", 3.0), ("test", 100.0)], "split string, x double")
    st = scaler_fit(df.filter("split = 'train'"), ["x"]).first()
    assert (st["x__mean"], st["x__std"]) == (2.0, 1.0)


PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("few", [100_000, 50, 1])
def test_exact_quantiles_match_numpy(spark, few):
    """Also when hardly any value may be gathered, so that intervals are narrowed
    again and again; a third of the rows hold one value."""
    rng = np.random.default_rng(1)
    xs = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), rng.exponential(size=500), [-0.0, 0.0, np.inf, -np.inf]])
    df = spark.createDataFrame([(float(x),) for x in xs] + [(None,), (float("nan"),)], "x double")
    probs = PROBS[1:-1]
    got = exact_quantile_values(df, "x", probs, few=few)
    np.testing.assert_allclose(got, np.quantile(xs, probs), rtol=1e-12, atol=1e-12)


def test_exact_quantiles_of_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(2.5,)] * 300, "x double")
    assert exact_quantile_values(df, "x", PROBS, few=10) == [2.5] * len(PROBS)
    assert exact_quantile_values(df.limit(0), "x", PROBS) == [None] * len(PROBS)
    two = spark.createDataFrame([(1.0,)] * 200 + [(4.0,)] * 201, "x double")
    assert exact_quantile_values(two, "x", [0.0, 0.4, 0.5, 1.0], few=10) == [1.0, 1.0, 4.0, 4.0]


def test_a_misleading_sketch_changes_nothing(spark, monkeypatch):
    from tidepool.operators import quantile
    xs = [float(i * i % 1009) for i in range(900)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    monkeypatch.setattr(quantile, "_propose", lambda values, wanted: [[700.0] * len(s) for _, s in wanted])
    np.testing.assert_allclose(exact_quantile_values(df, "x", [0.1, 0.9], few=100), np.quantile(xs, [0.1, 0.9]))


def test_selection_shuffles_partial_aggregates_only(spark):
    """No sort and no window in any plan of the selection."""
    from tidepool.operators.quantile import _values
    plan = _values(spark.range(10).selectExpr("CAST(id AS DOUBLE) AS v"), "v").groupBy("x").count()._jdf.queryExecution().toString()
    assert "Window" not in plan and "RangePartitioning" not in plan


def test_sketches_merge_and_keep_their_rank_error(spark):
    from tidepool.operators.quantile import merge_sketches, quantile_sketches, sketch_quantiles
    rng = np.random.default_rng(3)
    xs, day = rng.lognormal(size=20_000), rng.integers(0, 5, 20_000)
    df = spark.createDataFrame([(int(d), float(x), None) for d, x in zip(day, xs)] + [(9, None, float("nan"))], "day int, x double, y double")
    by_day = quantile_sketches(df, ["x", "y"], ["day"])
    whole = {r["column"]: r for r in sketch_quantiles(merge_sketches(by_day), [0.1, 0.5, 0.9]).collect()}
    assert set(whole) == {"x"} and whole["x"]["n"] == len(xs)
    for p, q in zip([0.1, 0.5, 0.9], whole["x"]["quantiles"]):
        assert abs((xs <= q).mean() - p) < 0.01
    rows = {(r["day"], r["column"]): r for r in sketch_quantiles(by_day, [0.5]).collect()}
    assert rows[9, "x"]["n"] == 0 and rows[9, "x"]["quantiles"] is None
    for d in range(5):
        own = xs[day == d]
        assert rows[d, "x"]["n"] == len(own) and abs((own <= rows[d, "x"]["quantiles"][0]).mean() - 0.5) < 0.01


def test_position_encoding(spark):
    n, L = 64, 20
    pe = np.zeros((L, n))
    pos = np.arange(L)[:, None]
    div = np.exp(np.arange(0, n, 2) * -(np.log(10000.0) / n))
    pe[:, 0::2] = np.sin(pos * div)
    pe[:, 1::2] = np.cos(pos * div)
    tab = position_encoding_table(spark, L, n).orderBy("pos", "dim").collect()
    np.testing.assert_allclose(np.array([r["pe"] for r in tab]).reshape(L, n), pe, atol=1e-12)
    seq = [[0.0] * n for _ in range(L)]
    df = spark.createDataFrame([(seq,)], "s array<array<double>>")
    out = np.array(df.select(add_position_encoding(F.col("s"), n).alias("e")).first()["e"])
    np.testing.assert_allclose(out, pe, atol=1e-12)
    with pytest.raises(ValueError):
        add_position_encoding(F.col("s"), 5)


def test_save_and_load_scaler(spark):
    from tidepool.operators.scale import load_scaler, save_scaler
    from tidepool.session import scratch_path
    df = spark.createDataFrame([(1.0, 10.0), (3.0, 30.0)], "a double, b double")
    stats = scaler_fit(df, ["a", "b"])
    path = scratch_path(spark, "scaler")
    save_scaler(stats, ["a", "b"], path)
    back = load_scaler(spark, path, ["a", "b"])
    assert back.first().asDict() == stats.first().asDict()
    z = scaler_transform(df, back, ["a", "b"]).collect()
    assert [r["a"] for r in z] == [-1.0, 1.0]
