"""Dataset build on the daily panel (the preprocessing notebook as one plan).

raw panel (with +Inf / NaN in px) -> left join macro -> drop columns ->
non-finite to null -> forward fill per ticker + drop incomplete rows ->
exact 1 % / 99 % trim of the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepool.operators.clean import drop_columns, ffill_dropna, inf_to_null, left_join_macro, quantile_trim
from tidepool.plans import fixtures as fx
from tidepool.session import materialize

# fixed values: columns dropped after the join (absent names are ignored)
MACRO_ROWS = 100_000        # days; beyond it the join is a shuffle
DROP = ["tax", "open", "high", "low", "close", "volume"]


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.with_specials(fx.labeled_panel(spark, sf_dir))


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return left_join_macro(raw(spark, sf_dir), fx.macro_table(spark, sf_dir), on="date",
                           broadcast_max_rows=MACRO_ROWS)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inf_to_null(drop_columns(joined(spark, sf_dir), DROP))


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ffill_dropna(cleaned(spark, sf_dir), ["ticker"], "date", tiebreak=["row_id"])


def filled_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled panel written once: the exact quantiles read it several times."""
    return materialize(filled(spark, sf_dir), "filled")


def final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantile_trim(filled_table(spark, sf_dir), fx.TARGET, 0.01, 0.99)
