"""Run log: one row per training / evaluation run with parameter and metric maps.

A run record is (run_name, model, params map<string,string>,
metrics map<string,double>, logged_at). It is appended to a table; the best
run is a query over ``element_at(metrics, ...)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_records(metrics: DataFrame, params: dict[str, str], model_col: str = "model",
                split_col: str = "split", scale: str = "original") -> DataFrame:
    """From long metrics (split, model, mae, mse) to one run per model with
    metrics ``<split>_mae`` / ``<split>_mse``. Each group holds at most
    2 x splits entries. ``scale`` records whether the errors are in original
    units or in standardised space (the same metric name is used for both)."""
    entries = F.array(F.struct(F.concat(F.col(split_col), F.lit("_mae")).alias("k"), F.col("mae").alias("v")),
                      F.struct(F.concat(F.col(split_col), F.lit("_mse")).alias("k"), F.col("mse").alias("v")))
    p = F.create_map(*[x for k, v in params.items() for x in (F.lit(k), F.lit(str(v)))])
    return (metrics.select(model_col, F.explode(entries).alias("e"))
                   .groupBy(model_col)
                   .agg(F.map_from_entries(F.collect_list(F.struct("e.k", "e.v"))).alias("metrics"))
                   .select(F.concat(F.col(model_col), F.lit("_run")).alias("run_name"), model_col,
                           p.alias("params"), "metrics", F.lit(scale).alias("scale"),
                           F.current_timestamp().alias("logged_at")))


def global_rank(df: DataFrame, order: Sequence[Column], rank_col: str = "rank") -> DataFrame:
    """``df`` with the rank of each row (1, 2, ... without gaps) in the given
    order, in two levels: rows are dealt to ranges of the order (Spark samples
    their bounds) and sorted there, and each range starts where the one before
    ends. No task sees more than a range; rows that are equal in ``order`` stand
    in any order of their own. The ranges are written once, so that their rows
    keep their places."""
    from tidepool.session import materialize

    spark = df.sparkSession
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = materialize(ranges.withColumn("_nth", F.monotonically_increasing_id()), "ranked")
    part, nth = F.shiftright("_nth", 33), F.col("_nth").bitwiseAND((1 << 33) - 1)
    offsets, total = [], 0
    for p, n in sorted(map(tuple, ranges.groupBy(part).agg(F.count(F.lit(1))).collect())):      # a row for each range
        offsets.append((p, total))
        total += n
    offsets = spark.createDataFrame(offsets, "_part long, _before long")
    out = ranges.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + nth + 1).alias(rank_col))


def best_runs(runs: DataFrame, metric: str, model_col: str = "model", top: int | None = None) -> DataFrame:
    """(run_name, model, <metric>, rank): all runs ranked by a metric, 1 = best;
    runs without the metric come last, ties by name. ``top`` (opt-in) reports
    that many runs only."""
    v = F.element_at("metrics", F.lit(metric))
    order = [F.col(metric).asc_nulls_last(), F.col("run_name").asc_nulls_last()]
    named = runs.select("run_name", model_col, v.alias(metric))
    return global_rank(named.orderBy(*order).limit(top) if top is not None else named, order)
