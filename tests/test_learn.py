"""Least absolute error against a plain version."""

import numpy as np
import pytest

from tidepool.operators.learn import fit_absolute


def plain(x, y, val, iterations, delta):
    a = np.column_stack([np.ones(len(x)), x])
    tr, out, w = ~val, [], np.ones(len(x))
    for _ in range(iterations + 1):
        b = np.linalg.solve((a[tr] * w[tr, None]).T @ a[tr], (a[tr] * w[tr, None]).T @ y[tr])
        r = np.abs(y - a @ b)
        out.append((b, r[tr].mean(), r[val].mean()))
        w = 1 / np.maximum(r, delta)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = 1.0 + x @ np.array([2.0, -3.0]) + rng.normal(size=400) * 0.1
    y[::17] += 50                               # outliers that least squares follows
    return x, y, rng.random(400) < 0.25


def frame(spark, x, y, val, extra=()):
    data = [(*map(float, a), float(b), bool(v)) for a, b, v in zip(x, y, val)]
    return spark.createDataFrame([*data, *extra], "a double, b double, y double, is_val boolean")


def test_iterations_equal_the_plain_version(spark, rows):
    x, y, val = rows
    odd = [(None, 1.0, 1.0, False), (1.0, 1.0, None, False), (float("nan"), 1.0, 1.0, True)]
    m = fit_absolute(frame(spark, x, y, val, odd), ["a", "b"], "y", max_iter=8, patience=20, delta=1e-3)
    want = plain(x, y, val, 8, 1e-3)
    assert len(m.history) == 9
    for (t, b, tr, va), (wb, wtr, wva) in zip(m.history, want):
        np.testing.assert_allclose([*b, tr, va], [*wb, wtr, wva], rtol=1e-9)
    assert m.best == int(np.argmin([v for _, _, v in want])) and m.coefficients == m.history[m.best][1]
    np.testing.assert_allclose(m.coefficients, [1, 2, -3], atol=0.05)       # the outliers are not followed
    got = frame(spark, x[:1], y[:1], val[:1]).select(m.predict()).first()[0]
    assert got == pytest.approx(float(np.r_[1, x[0]] @ np.array(m.coefficients)))


def test_stops_after_patience_and_keeps_the_best(spark, rows):
    x, y, val = rows
    y = np.where(val, np.column_stack([np.ones(len(x)), x]) @ plain(x, y, val, 0, 1)[0][0], y)
    # validation rows on the line of least squares: later iterations only get worse
    m = fit_absolute(frame(spark, x, y, val), ["a", "b"], "y", max_iter=40, patience=2)
    assert m.best == 0 and len(m.history) == 3
    assert m.history[m.best][3] == min(h[3] for h in m.history)


def test_without_validation_or_training_rows(spark, rows):
    x, y, val = rows
    m = fit_absolute(frame(spark, x, y, val & False), ["a", "b"], "y", max_iter=3)
    assert all(h[2] == h[3] for h in m.history)
    with pytest.raises(ValueError):
        fit_absolute(frame(spark, x, y, val | True), ["a", "b"], "y")
    same = fit_absolute(frame(spark, np.ones((30, 2)), np.full(30, 4.0), np.zeros(30)), ["a", "b"], "y", max_iter=2)
    assert same.history[same.best][2] == pytest.approx(0.0, abs=1e-9)       # collinear features
