"""Date split into train / val / test (three independent predicates)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def _lit_like(df: DataFrame, time_col: str, value: str) -> Column:
    return F.lit(value).cast(df.schema[time_col].dataType)


def split_predicates(df: DataFrame, time_col: str, train_end: str, val_end: str,
                     test_start: str) -> dict[str, Column]:
    """train: t < a;  val: a <= t < b;  test: t >= c.

    The three are independent: with c < b a row is in val and test, with
    c > b a row is in neither (as in the reference).
    """
    t = F.col(time_col)
    a, b, c = (_lit_like(df, time_col, x) for x in (train_end, val_end, test_start))
    return {"train": t < a, "val": (t >= a) & (t < b), "test": t >= c}


def temporal_split(df: DataFrame, time_col: str, train_end: str, val_end: str,
                   test_start: str, split_col: str = "split") -> DataFrame:
    """Long form: one row per (row, split it belongs to). A row in two splits
    appears twice; a row in none disappears. No shuffle (a generator)."""
    preds = split_predicates(df, time_col, train_end, val_end, test_start)
    names = F.array(*[F.when(p, F.lit(k)) for k, p in preds.items()])
    return (df.withColumn(split_col, F.explode(F.filter(names, lambda x: x.isNotNull()))))


def split_report(split_df: DataFrame, time_col: str, split_col: str = "split") -> DataFrame:
    """count, min and max time per split (partial aggregation, 3 groups)."""
    return (split_df.groupBy(split_col)
                    .agg(F.count(F.lit(1)).alias("n_rows"),
                         F.min(time_col).alias("min_time"),
                         F.max(time_col).alias("max_time")))
