import datetime as dt

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.operators.sequence import lead_lag, with_positions
from tidepool.operators.split import split_report, temporal_split
from tidepool.operators.windows import last_n, lookback_windows


def frame(spark, sizes):
    data = []
    for e, n in sizes.items():
        for i in range(n):
            data.append((e, dt.date(2024, 1, 1) + dt.timedelta(days=i), e * 1000 + i, float(i),
                         None if (e == 25 and i == 7) else float(i) * 2))
    return spark.createDataFrame(data, "ticker long, date date, row_id long, a double, b double")


def test_window_counts_19_20_21_25(spark):
    df = frame(spark, {19: 19, 20: 20, 21: 21, 25: 25})
    w = lookback_windows(df, ["ticker"], "date", ["a", "b"], 20, carry=["a"], block=32, chunk_width=3)
    counts = {r["ticker"]: r["n"] for r in w.groupBy("ticker").agg(F.count("*").alias("n")).collect()}
    assert counts.get(19, 0) == 0 and counts.get(20, 0) == 0 and counts[21] == 1 and counts[25] == 5
    first = w.filter("ticker = 21").first()
    assert first["a"] == 20.0                       # target row is the 21st row
    assert [s[0] for s in first["seq"]] == [float(i) for i in range(20)]   # rows 0..19, not the target
    # a null value inside a window keeps the window length at 20
    w25 = w.filter("ticker = 25").orderBy("row_id").first()
    assert len(w25["seq"]) == 20 and w25["seq"][7][1] is None


def test_blocks_and_chunks_match_plain_window(spark):
    df = frame(spark, {1: 130, 2: 77, 3: 21})
    w = Window.partitionBy("ticker").orderBy("date", "row_id")
    plain = {r["row_id"]: (r["s"], r["c"]) for r in df.select(
        "row_id", F.sum("a").over(w.rowsBetween(-5, -1)).alias("s"),
        F.count("a").over(w.rowsBetween(-5, -1)).alias("c")).collect() if r["c"] == 5}
    for block, chunk in ((5, 1), (7, 3), (64, 64)):
        lw = lookback_windows(df, ["ticker"], "date", ["a"], 5, block=block, chunk_width=chunk)
        ours = {r["row_id"]: (sum(x[0] for x in r["seq"]), 5) for r in lw.collect()}
        assert ours == plain


def test_positions_and_lead(spark):
    df = frame(spark, {1: 50})
    p = {r["row_id"]: r["pos"] for r in with_positions(df, ["ticker"], "date", ["row_id"], 4).collect()}
    assert p == {1000 + i: i for i in range(50)}
    for block in (6, 1000):
        ll = lead_lag(df, ["ticker"], "date", {"fwd": ("a", 5), "back": ("a", -2)}, ["row_id"], 3, block=block,
                      keep_pos="p")
        got = {r["row_id"]: (r["fwd"], r["back"], r["p"]) for r in ll.collect()}
        assert got[1000] == (5.0, None, 0) and got[1044] == (49.0, 42.0, 44) and got[1045] == (None, 43.0, 45)


def test_hot_entity_is_split(spark):
    df = frame(spark, {1: 300, 2: 10, 3: 10})            # entity 1 holds most rows
    split = lookback_windows(df, ["ticker"], "date", ["a"], 20, block=32, chunk_width=5)
    plain = lookback_windows(df, ["ticker"], "date", ["a"], 20, block=10**6, chunk_width=10**6)
    key = lambda d: sorted((r["row_id"], tuple(x[0] for x in r["seq"])) for r in d.collect())
    assert key(split) == key(plain) and len(key(split)) == 280


def test_entity_without_times_is_spread(spark):
    """All rows of an entity lack a time: they are numbered by the tiebreak, in
    many groups, a row without a tiebreak last; forward fill follows the same order."""
    from tidepool.operators.clean import ffill
    from tidepool.operators.sequence import chunk_column
    rows = [(1, None, i * 1000, float(i) if i % 7 == 0 else None) for i in range(-40, 200)] + [(1, None, None, None)]
    rows += [(1, dt.date(2024, 1, 1), 10**6, -1.0), (2, None, 5, 3.0)]
    df = spark.createDataFrame(rows, "ticker long, date date, row_id long, a double").repartition(5)
    assert df.filter("ticker = 1").select(chunk_column(df, "date", None, ["row_id"])).distinct().count() > 40
    want = {10**6: 0, **{i * 1000: i + 41 for i in range(-40, 200)}, None: 241}
    got = with_positions(df, ["ticker"], "date", ["row_id"]).filter("ticker = 1").collect()
    assert {r["row_id"]: r["pos"] for r in got} == want
    filled = {r["row_id"]: r["a"] for r in ffill(df, ["ticker"], "date", ["a"], ["row_id"]).filter("ticker = 1").collect()}
    assert filled[-40000] == -1.0 and filled[None] == 196.0 and all(filled[i * 1000] == i // 7 * 7 for i in range(-35, 200))


def test_split_overlap_and_gap(spark):
    df = frame(spark, {1: 40})
    # test start before val end: rows in both
    s = temporal_split(df, "date", "2024-01-10", "2024-01-20", "2024-01-15")
    by = {r["split"]: r["n_rows"] for r in split_report(s, "date").collect()}
    assert by == {"train": 9, "val": 10, "test": 26}
    assert s.count() == 45
    # test start after val end: rows in neither
    s2 = temporal_split(df, "date", "2024-01-10", "2024-01-20", "2024-01-25")
    assert s2.count() == 9 + 10 + 16


def test_last_n_fifo(spark):
    # window 50 after 60 adds keeps records 10..59 (newest by order)
    df = spark.createDataFrame([(i, i) for i in range(60)], "ts long, id long")
    assert sorted(r["id"] for r in last_n(df, 50, ["ts", "id"]).collect()) == list(range(10, 60))


def test_hot_entity_spread_over_bounded_groups(spark):
    """One entity with a third of all rows: every (entity, block) group of the
    split layout stays within block + halo rows, and the windows are the same."""
    from tidepool.operators.sequence import blocked
    sizes = {1: 600, **{e: 60 for e in range(2, 22)}}     # entity 1 = 600 of 1800 rows
    df = frame(spark, sizes)
    pos = with_positions(df, ["ticker"], "date", ["row_id"], chunk_width=16)
    lay = blocked(pos, "pos", block=64, before=5)
    biggest = lay.groupBy("ticker", "_blk").count().agg(F.max("count")).first()[0]
    assert biggest <= 64 + 5
    assert lay.filter("ticker = 1").select("_blk").distinct().count() == 10
    split = lookback_windows(df, ["ticker"], "date", ["a"], 5, block=64, chunk_width=16)
    plain = lookback_windows(df, ["ticker"], "date", ["a"], 5, block=10**6, chunk_width=10**6)
    key = lambda d: sorted((r["row_id"], tuple(x[0] for x in r["seq"])) for r in d.collect())
    assert key(split) == key(plain)


def test_windows_with_null_keys_and_times(spark):
    """Rows without an entity give no window; rows without a date come last."""
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    rows = [(1, day(i), i, float(i)) for i in range(6)] + [(1, None, 90, 90.0), (1, None, 91, 91.0)]
    rows += [(None, day(i), 200 + i, 0.0) for i in range(9)]
    df = spark.createDataFrame(rows, "ticker long, date date, row_id long, a double")
    for block, chunk in ((3, 1), (64, 64)):
        got = {r["row_id"]: [x[0] for x in r["seq"]]
               for r in lookback_windows(df, ["ticker"], "date", ["a"], 3, block=block, chunk_width=chunk).collect()}
        assert got == {3: [0, 1, 2], 4: [1, 2, 3], 5: [2, 3, 4], 90: [3, 4, 5], 91: [4, 5, 90]}
        lag = {r["row_id"]: r["b"] for r in
               lead_lag(df, ["ticker"], "date", {"b": ("a", -1)}, ["row_id"], chunk, block).collect()}
        assert lag == {0: None, 1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 90: 5, 91: 90}
