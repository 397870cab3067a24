import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidepool.operators.clean import (drop_columns, extreme_rows, ffill, ffill_dropna, inf_to_null,
                                      left_join_macro, parse_dates, quantile_trim, quarantine_dates)

D = dt.date


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(*cols[:2]).collect()]


@pytest.fixture
def panel(spark):
    data = [
        ("A", D(2024, 1, 1), 1, None, 10.0),
        ("A", D(2024, 1, 2), 2, 1.0, None),
        ("A", D(2024, 1, 3), 3, None, float("nan")),
        ("A", D(2024, 1, 4), 4, float("inf"), 12.0),
        ("A", D(2024, 1, 4), 5, 5.0, None),          # two rows on one date: tie by row_id
        ("B", D(2024, 1, 1), 6, 7.0, 1.0),
        ("B", D(2024, 3, 9), 7, None, None),         # far later: another time chunk
        (None, D(2024, 1, 2), 8, 9.0, 9.0),          # null entity vanishes
    ]
    return spark.createDataFrame(data, "ticker string, date date, row_id long, x double, y double")


def test_inf_to_null(panel):
    out = {r["row_id"]: (r["x"], r["y"]) for r in inf_to_null(panel).collect()}
    assert out[4][0] is None and out[3][1] is None and out[2] == (1.0, None)


def test_ffill_leading_inner_nan_inf_and_chunks(panel):
    f = ffill(inf_to_null(panel), ["ticker"], "date", tiebreak=["row_id"], chunk_width=7)
    got = {r["row_id"]: (r["x"], r["y"]) for r in f.collect()}
    assert 8 not in got
    assert got[1] == (None, 10.0)        # leading null stays
    assert got[2] == (1.0, 10.0)
    assert got[3] == (1.0, 10.0)         # NaN treated as missing after inf_to_null
    assert got[4] == (1.0, 12.0)         # Inf -> null -> filled
    assert got[5] == (5.0, 12.0)         # same date, later row_id
    assert got[7] == (7.0, 1.0)          # carried across chunks


def test_ffill_dropna_drops_leading(panel):
    f = ffill_dropna(inf_to_null(panel), ["ticker"], "date", tiebreak=["row_id"], chunk_width=7)
    assert sorted(r["row_id"] for r in f.collect()) == [2, 3, 4, 5, 6, 7]


def test_ffill_matches_plain_window(spark):
    import random
    rnd = random.Random(7)
    data = []
    for e in range(5):
        for d in range(300):
            v = None if rnd.random() < 0.6 else rnd.random()
            data.append((f"E{e}", D(2020, 1, 1) + dt.timedelta(days=d * (e + 1)), e * 1000 + d, v))
    df = spark.createDataFrame(data, "ticker string, date date, row_id long, v double")
    from pyspark.sql import Window
    w = Window.partitionBy("ticker").orderBy("date", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    plain = {r["row_id"]: r["v"] for r in df.select("row_id", F.last("v", True).over(w).alias("v")).collect()}
    for width in (3, 17, 64, 10000):
        ours = {r["row_id"]: r["v"] for r in ffill(df, ["ticker"], "date", ["v"], ["row_id"], width).collect()}
        assert ours == plain


def test_drop_columns_lenient_and_strict(panel):
    assert drop_columns(panel, ["x", "nope"]).columns == ["ticker", "date", "row_id", "y"]
    with pytest.raises(KeyError):
        drop_columns(panel, ["x", "nope"], strict=True)


def test_left_join_suffixes_and_fanout(spark, panel):
    macro = spark.createDataFrame([(D(2024, 1, 1), 1.0, 0.5), (D(2024, 1, 1), 2.0, 0.5)],
                                  "date date, y double, m double")
    j = left_join_macro(panel, macro, broadcast_max_rows=10)
    assert "y_x" in j.columns and "y_y" in j.columns
    assert j.count() == panel.count() + 2          # two matching panel rows fan out to two each
    assert j.filter(F.col("date") == D(2024, 1, 2)).filter(F.col("m").isNotNull()).count() == 0


def test_parse_dates_strict_and_quarantine(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-02T05:00:00+02:00",), ("nope",)], "d string")
    good, bad = quarantine_dates(df, "d")
    assert good.count() == 2 and bad.count() == 1
    ts = sorted(r["d"] for r in good.select(F.date_format("d", "yyyy-MM-dd HH:mm").alias("d")).collect())
    assert ts == ["2024-01-01 00:00", "2024-01-02 03:00"]
    with pytest.raises(Exception):
        parse_dates(df, "d", strict=True).collect()


def test_extremes_and_trim(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 101)], "row_id long, t double")
    ex = sorted((r["row_id"], r["extreme"]) for r in extreme_rows(df, "t").collect())
    assert ex == [(1, "min"), (100, "max")]
    kept = quantile_trim(df, "t", 0.01, 0.99)
    # q01 = 1.99, q99 = 99.01: strict bounds drop 1 and 100
    assert kept.count() == 98


def test_ffill_null_keys_null_times_and_ties(spark):
    """Rows without an entity vanish; rows without a date come last, so they
    take values but give none; ties go by row id."""
    rows = [("A", D(2024, 1, 1), 1, None), ("A", None, 2, 7.0), ("A", D(2024, 1, 2), 4, 3.0), ("A", D(2024, 1, 2), 3, 2.0),
            ("A", D(2024, 1, 9), 5, None), ("A", None, 6, None), (None, D(2024, 1, 1), 7, 1.0), (None, None, 8, None)]
    df = spark.createDataFrame(rows, "ticker string, date date, row_id long, v double")
    want = {1: None, 3: 2.0, 4: 3.0, 5: 3.0, 2: 7.0, 6: 7.0}
    for width in (1, 3, 1000):
        assert {r["row_id"]: r["v"] for r in ffill(df, ["ticker"], "date", ["v"], ["row_id"], width).collect()} == want


def test_extremes_of_a_constant_column(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0)], "row_id long, t double")
    assert sorted((r["row_id"], r["extreme"]) for r in extreme_rows(df, "t").collect()) == [
        (1, "max"), (1, "min"), (2, "max"), (2, "min")]
