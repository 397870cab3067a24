"""Plans over the daily panel: what is shuffled and fitted, and the layout by whole entities."""

import datetime as dt
import os

import pytest

from pyspark.sql import functions as F

from tidepool.operators.sequence import lead_lag
from tidepool.operators.windows import sequence_frame
from tidepool.plans import ensemble as ens
from tidepool.plans import fixtures as fx

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def panel(spark):
    day = dt.date(2024, 1, 1)
    rows = [(e, day + dt.timedelta(days=3 * i), e * 100 + i, None if i == 4 else float(i * e)) for e in (1, 2, 3) for i in range(5 * e)]
    rows += [(2, None, 299, 7.0), (None, day, 1, 1.0)]            # a row without a time is the last; no key, no entity
    return spark.createDataFrame(rows, "ticker long, date date, row_id long, px double")


def test_whole_entities_give_the_rows_of_blocks(spark):
    df = panel(spark)
    args = (["ticker"], "date", {"fwd": ("px", 2), "back": ("px", -3)}, ["row_id"])
    blocks = lead_lag(df, *args, chunk_width=4, block=4, keep_pos="pos")
    whole = lead_lag(df, *args, keep_pos="pos", whole=True)
    key = lambda d: sorted(map(tuple, d.select("row_id", "fwd", "back", "pos").collect()))
    assert key(whole) == key(blocks) and whole.columns == blocks.columns
    args = (["ticker"], "date", ["px"], 3, "row_id", {"_f": lambda w: F.lead("px", 2).over(w)}, 2)
    sums = {"m": ("px", "mean"), "first": ("px", "first")}
    key = lambda d: sorted(map(tuple, d.select("row_id", "seq", "m", "first", "_f", "_n", "_t0").collect()), key=str)
    assert key(sequence_frame(df, *args, summaries=sums, whole=True)) == key(sequence_frame(df, *args, block=4, chunk_width=4, summaries=sums))


@needs_tables
def test_label_needs_the_aggregate_and_one_shuffle(spark):
    _, physical = plan(fx.daily_panel(spark, SF))
    assert physical.count("Exchange") == 2 and "Join" not in physical


@needs_tables
def test_scaler_is_fitted_once(spark):
    labeled = fx.labeled_panel(spark, SF)
    z, stats = ens.scaled_panel(spark, SF, labeled)
    for df in (stats, z):
        assert "Aggregate" not in plan(df)[0]


@needs_tables
def test_window_ids_are_aligned_with_one_fitted_scaler(spark):
    from tidepool.plans.registry import QUERIES
    logical, physical = plan(QUERIES["align_predictions"](spark, SF))
    assert "Aggregate" not in logical
    assert physical.count("Exchange hashpartitioning(ticker") <= 1 and "_halo" not in logical


@needs_tables
def test_scored_windows_are_read_not_computed_again(spark):
    s = ens.scored(spark, SF)
    logical, physical = plan(s)
    assert "Window" not in logical and "Exchange hashpartitioning" not in physical
    w, _ = ens.panel_windows(spark, SF)
    assert s.count() == w.count() * (len(ens.MODELS) + 1)
