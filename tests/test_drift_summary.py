"""Windows against a stored reference summary equal one drift check for each window."""

import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators.drift import check_drift, drift_columns
from tidepool.operators.drift_summary import reference_summary, windows_drift, windows_verdict

COLS = ["a", "b", "c"]


def frames(spark, seed=1):
    rng = random.Random(seed)
    nan = float("nan")
    ref = [(rng.gauss(0, 1), float(rng.randint(0, 5)), rng.choice([1.0, None, nan, 3.5]), rng.choice("xyz"), rng.choice(["p", None])) for _ in range(300)]
    win = []
    for k, n in ((1, 40), (2, 40), (3, 17), (4, 1), (5, 40)):
        for _ in range(n):
            win.append((k, rng.gauss(k / 3, 1), float(rng.randint(0, 4 + k)), 9.0 if k == 5 else rng.choice([1.0, 2.0, None]),
                        rng.choice("xyzw"), None if k == 2 else rng.choice(["p", "q"])))
    win += [(6, None, None, None, None, None)]
    schema = "a double, b double, c double, s string, t string"
    return spark.createDataFrame(ref, schema), spark.createDataFrame(win, "k int, " + schema)


@pytest.mark.parametrize("method", [{}, {"a": "wasserstein", "b": "wasserstein"}, {"c": "wasserstein", "a": "ks"}])
def test_equals_one_check_for_each_window(spark, method):
    ref, win = frames(spark)
    got = {}
    for r in windows_drift(reference_summary(ref, COLS, ["s", "t"]), win, "k", COLS, ["s", "t"], method).collect():
        got[r.k, r.column] = r
    assert len(got) == 6 * 5
    for k in (2, 3, 4, 6) if not method else (1, 5):
        for w in drift_columns(ref, win.filter(F.col("k") == k), COLS, ["s", "t"], method).collect():
            g = got[k, w.column]
            assert (g.method, g.n_ref, g.n_cur, g.status, g.drifted, g.threshold) == (
                w.method, w.n_ref, w.n_cur, w.status, w.drifted, w.threshold)
            assert w.status == "ok" or g.stat is None
            for x, y in ((g.stat, w.stat), (g.p_value, w.p_value)) if w.status == "ok" else ():
                assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-9))


def test_verdict_equals_check(spark):
    ref, win = frames(spark, 2)
    cols = windows_drift(reference_summary(ref, COLS, ["s", "t"]), win, "k", COLS, ["s", "t"])
    got = {r.k: r for r in windows_verdict(cols, "k").collect()}
    for k in (1, 2, 3, 5):
        want = check_drift(ref, win.filter(F.col("k") == k).drop("k"), COLS, ["s", "t"]).first()
        assert (got[k].n_columns, got[k].n_drifted, got[k].dataset_drift, got[k].severity) == (
            want.n_columns, want.n_drifted, want.dataset_drift, want.severity)


def test_empty_sides(spark):
    ref, win = frames(spark)
    summary = reference_summary(ref.limit(0), COLS, ["s"])
    rows = windows_drift(summary, win, "k", COLS, ["s"]).collect()
    assert len(rows) == 6 * 4 and {r.status for r in rows} == {"no_data"} and not any(r.drifted for r in rows)
    assert windows_drift(reference_summary(ref, COLS), win.limit(0), "k", COLS).count() == 0
    with pytest.raises(ValueError):
        windows_drift(summary, win, "k", COLS, [], {"a": "psi"})
