import numpy as np
import pytest

from tidepool.operators.drift import (check_drift, drift_columns, drift_dataset, drift_prediction, drift_report,
                                      drift_status, ordered_cumsum)


def ks_reference(a, b):
    """Two-sample KS with the same asymptotic p-value, in NumPy."""
    a, b = np.sort(a), np.sort(b)
    grid = np.union1d(a, b)
    d = np.max(np.abs(np.searchsorted(a, grid, "right") / len(a) - np.searchsorted(b, grid, "right") / len(b)))
    ne = len(a) * len(b) / (len(a) + len(b))
    lam = (np.sqrt(ne) + 0.12 + 0.11 / np.sqrt(ne)) * d
    if lam < 0.2:
        return d, 1.0
    k = np.arange(1, 101)
    return d, float(min(1, max(0, 2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * k * k * lam * lam)))))


def wasserstein_reference(a, b):
    grid = np.union1d(a, b)
    fa = np.searchsorted(np.sort(a), grid, "right") / len(a)
    fb = np.searchsorted(np.sort(b), grid, "right") / len(b)
    return float(np.sum(np.abs(fa - fb)[:-1] * np.diff(grid)) / (np.std(a) or 1.0))


@pytest.fixture
def samples(spark):
    rng = np.random.default_rng(42)
    ref = rng.normal(size=400).round(2)
    cur = (rng.normal(size=300) * 1.3 + 0.2).round(2)
    r = spark.createDataFrame([(float(x), "abc"[i % 3]) for i, x in enumerate(ref)], "x double, c string")
    c = spark.createDataFrame([(float(x), "abcd"[i % 4]) for i, x in enumerate(cur)], "x double, c string")
    return ref, cur, r, c


def test_ks_wasserstein_js(samples):
    ref, cur, r, c = samples
    out = {row["column"]: row for row in drift_columns(r, c, ["x"], ["c"], buckets=5).collect()}
    d, p = ks_reference(ref, cur)
    assert out["x"]["stat"] == pytest.approx(d, abs=1e-12)
    assert out["x"]["p_value"] == pytest.approx(p, abs=1e-9)
    w = {row["column"]: row for row in drift_columns(r, c, ["x"], [], {"x": "wasserstein"}, buckets=5).collect()}
    assert w["x"]["stat"] == pytest.approx(wasserstein_reference(ref, cur), rel=1e-9)
    p_ = np.array([sum(1 for i in range(400) if i % 3 == k) for k in range(3)] + [0]) / 400
    q_ = np.array([75, 75, 75, 75]) / 300
    m = (p_ + q_) / 2
    js = np.sqrt(0.5 * np.sum(p_[p_ > 0] * np.log(p_[p_ > 0] / m[p_ > 0])) + 0.5 * np.sum(q_ * np.log(q_ / m)))
    assert out["c"]["stat"] == pytest.approx(js, rel=1e-9)


def test_ordered_cumsum_two_level(spark):
    rng = np.random.default_rng(3)
    data = [(p, float(x), int(rng.integers(1, 5))) for p in ("a", "b") for x in rng.permutation(500)]
    df = spark.createDataFrame(data, "part string, x double, c long")
    for buckets in (2, 7, 600):
        out = ordered_cumsum(df, ["part"], "x", ["c"], buckets=buckets).orderBy("part", "x").collect()
        for p in ("a", "b"):
            rows = [r for r in out if r["part"] == p]
            assert [r["cum_c"] for r in rows] == list(np.cumsum([r["c"] for r in rows]))
            assert [r["next_x"] for r in rows] == [r["x"] for r in rows[1:]] + [None]


def test_no_data_column(spark):
    r = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, y double")
    c = spark.createDataFrame([(1.5, 1.0), (2.5, 2.0)], "x double, y double")
    out = {row["column"]: row for row in drift_columns(r, c, ["x", "y"]).collect()}
    assert out["y"]["status"] == "no_data" and out["y"]["drifted"] is False


def _shares(spark, flags):
    return spark.createDataFrame([(f"c{i}", f) for i, f in enumerate(flags)], "column string, drifted boolean")


@pytest.mark.parametrize("flags,drift,severity", [
    ([True] + [False] * 9, False, "none"),                 # 0.1
    ([True] * 4 + [False] * 6, True, "warning"),           # 0.4
    ([True] * 6 + [False] * 4, True, "critical"),          # 0.6
    ([True] * 3 + [False] * 7, False, "none"),             # exactly 0.3: strict
    ([True] * 5 + [False] * 5, True, "warning"),           # exactly 0.5: strict
])
def test_drift_bands(spark, flags, drift, severity):
    v = drift_dataset(_shares(spark, flags)).first()
    assert (v["dataset_drift"], v["severity"]) == (drift, severity)


def test_guards(spark):
    cols5 = ["a", "b", "c", "d", "e"]
    mk = lambda n, cols: spark.createDataFrame([tuple(float(i + j) for j in range(len(cols))) for i in range(n)],
                                               ", ".join(f"{c} double" for c in cols))
    ref = mk(50, cols5)
    assert check_drift(ref, mk(20, cols5[:4]), cols5, []).first()["status"] == "schema_mismatch"
    assert check_drift(ref, mk(20, cols5), cols5, []).first()["status"] == "success"
    assert check_drift(ref, mk(9, cols5), cols5, []).first()["status"] == "insufficient_data"
    assert check_drift(ref, mk(10, cols5), cols5, []).first()["status"] == "success"
    assert check_drift(None, mk(10, cols5), cols5, []).first()["status"] == "insufficient_data"


def test_prediction_drift(spark):
    mk = lambda xs: spark.createDataFrame([(i, i, float(x)) for i, x in enumerate(xs)], "ts long, id long, prediction double")
    assert drift_prediction(mk(range(49))).first()["drift_score"] == 0.0
    assert drift_prediction(mk([3.0] * 80)).first()["drift_score"] == 0.0
    assert drift_prediction(mk([-1.0, 1.0] * 40)).first()["drift_score"] == 1.0   # mean 0 -> clamp
    xs = list(range(200))
    got = drift_prediction(mk(xs)).first()
    last = np.array(xs[-100:], dtype=float)
    assert got["n_window"] == 100 and got["drift_score"] == pytest.approx(min(1, last.std() / abs(last.mean())))


def test_report_insufficient(spark):
    cur = spark.createDataFrame([(float(i),) for i in range(5)], "x double")
    preds = spark.createDataFrame([(1, 1, 0.5)], "ts long, id long, prediction double")
    st = drift_status(cur, cur, preds, 50).drop("last_drift_check")
    verdict = drift_dataset(_shares(spark, [True, False]))
    rep = drift_report(st, verdict).first()
    assert rep["status"] == "insufficient_data" and rep["recommendation"] is None
    big = spark.createDataFrame([(float(i),) for i in range(60)], "x double")
    rep = drift_report(drift_status(big, big, preds, 50).drop("last_drift_check"),
                       drift_dataset(_shares(spark, [True] * 4 + [False]))).first()
    assert rep["current_window_size"] == 50 and rep["recommendation"] == "Consider retraining the model"


def test_method_is_explicit_at_every_size(spark):
    cur = spark.createDataFrame([(float(i) + 0.5,) for i in range(300)], "x double")
    for n in (500, 1500):
        ref = spark.createDataFrame([(float(i % 700),) for i in range(n)], "x double")
        ks = drift_columns(ref, cur, ["x"]).first()
        ws = drift_columns(ref, cur, ["x"], method={"x": "wasserstein"}).first()
        assert (ks["method"], ks["threshold"]) == ("ks", 0.05) and ks["p_value"] is not None
        assert (ws["method"], ws["threshold"]) == ("wasserstein", 0.1) and ws["p_value"] is None
        with pytest.raises(ValueError, match="auto"):
            drift_columns(ref, cur, ["x"], method={"x": "auto"})


def test_check_result_fields(spark):
    """The verdict carries the rows looked at and the drift of the predictions."""
    ref = spark.createDataFrame([(float(i),) * 5 for i in range(40)], "a double, b double, c double, d double, e double")
    preds = spark.createDataFrame([(i, i, float(i % 2)) for i in range(60)], "ts long, id long, prediction double")
    got = check_drift(ref, ref, list("abcde"), [], preds=preds).first()
    assert got["samples_analyzed"] == 40 and got["prediction_drift_score"] == pytest.approx(1.0)
    assert check_drift(ref, ref, list("abcde"), []).first()["prediction_drift_score"] == 0.0
    # the guard counts the columns that both sides have, tested or not
    assert check_drift(ref, ref, list("abc"), []).first()["n_columns"] == 3
    assert check_drift(ref, ref.select("a", "b", "c"), list("abc"), []).first()["status"] == "schema_mismatch"
    none = check_drift(ref, ref, ["z"], []).first()
    assert none["status"] == "schema_mismatch" and none["samples_analyzed"] is None and none["drift_share"] is None
    assert check_drift(None, ref, list("abcde"), []).first()["status"] == "insufficient_data"


def test_no_columns_to_compare_is_empty(spark):
    r = spark.createDataFrame([(1.0,)], "x double")
    out = drift_columns(r, r, [], [])
    assert out.count() == 0 and "drifted" in out.columns
    # the same schema as a real result
    assert out.schema.simpleString() == drift_columns(r, r, ["x"]).schema.simpleString()
