"""Stand-in inputs built from the driver's tables (see FIXTURES.md).

* daily panel: ``lineitem`` by (supplier, ship day) -> one row per (ticker, date)
* macro table: all ``orders`` by order day; its values are missing before
  1996-01-01, so the panel has leading gaps
* event features: ``events`` with the JSON ``k`` property as a second feature

Every table is derived by Spark from the given parquet files, so its size
grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators.sequence import lead_lag
from tidepool.session import materialize

# fixed values of the stand-in pipeline
PANEL_FEATURES = ["qty", "px", "disc", "tax", "n"]
TARGET = "future_5_pct"
LABEL_HORIZON = 5
MACRO_START = "1996-01-01"
SPLIT_TRAIN = "1999-07-01"
SPLIT_VAL = "2000-07-01"
SPLIT_TEST = "2000-07-01"
DRIFT_CUT = "2024-01-16"
ROW_ID_EPOCH = "1990-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_suppkey, date, row_id, qty, px, disc, tax, n): one row for each
    supplier and day, so a supplier has no more rows than the calendar has days."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy("l_suppkey", F.to_date("l_shipdate").alias("date"))
              .agg(F.sum("l_quantity").alias("qty"),
                   F.avg("l_extendedprice").alias("px"),
                   F.avg("l_discount").alias("disc"),
                   F.avg("l_tax").alias("tax"),
                   F.count(F.lit(1)).cast("double").alias("n"))
              .select("l_suppkey", "date",
                      (F.col("l_suppkey") * 100000
                       + F.datediff("date", F.lit(ROW_ID_EPOCH).cast("date"))).cast("long").alias("row_id"),
                      *PANEL_FEATURES))


def with_ticker(p: DataFrame) -> DataFrame:
    """The supplier key as the panel's ``ticker``, first column."""
    rest = [c for c in p.columns if c != "l_suppkey"]
    return p.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), *rest)


def daily_panel(spark: SparkSession, sf_dir: str, with_label: bool = True) -> DataFrame:
    """(ticker, date, row_id, qty, px, disc, tax, n[, future_5_pct])."""
    p = supplier_days(spark, sf_dir)
    return with_ticker(add_label(p, "l_suppkey") if with_label else p)


def label(px_fwd: Column) -> Column:
    """Change of the price to that of ``LABEL_HORIZON`` rows later, in percent."""
    return (px_fwd / F.col("px") - 1.0) * 100.0


def add_label(p: DataFrame, key: str = "ticker") -> DataFrame:
    """future_5_pct = (lead(px, 5) / px - 1) * 100 per entity by (date, row_id)."""
    p = lead_lag(p, [key], "date", {"_px_fwd": ("px", LABEL_HORIZON)}, tiebreak=["row_id"], whole=True)
    return p.withColumn(TARGET, label(F.col("_px_fwd"))).drop("_px_fwd")


def labeled_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel + label, written once (the one write of a query over the panel)."""
    return materialize(daily_panel(spark, sf_dir), "labeled-panel")


PANEL_SQL = f"""
  SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS ticker,
         CAST(l_shipdate AS DATE) AS date,
         CAST(l_suppkey * 100000 + date_diff('day', DATE '{ROW_ID_EPOCH}', CAST(l_shipdate AS DATE)) AS BIGINT) AS row_id,
         sum(l_quantity) AS qty, avg(l_extendedprice) AS px, avg(l_discount) AS disc,
         avg(l_tax) AS tax, CAST(count(*) AS DOUBLE) AS n
  FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)"""

PANEL_LABEL_SQL = f"""
  SELECT *, (lead(px, {LABEL_HORIZON}) OVER (PARTITION BY ticker ORDER BY date, row_id) / px - 1.0) * 100.0
            AS {TARGET}
  FROM ({PANEL_SQL}) p"""


def with_specials(panel: DataFrame) -> DataFrame:
    """Deterministic +Inf / NaN in ``px`` so the cleaning path has work to do."""
    rid = F.col("row_id")
    return panel.withColumn(
        "px", F.when(rid % 97 == 0, F.lit(float("inf")))
               .when(rid % 89 == 0, F.lit(float("nan")))
               .otherwise(F.col("px")))


SPECIALS_SQL_PX = ("CASE WHEN row_id % 97 = 0 THEN 'Infinity'::DOUBLE "
                   "WHEN row_id % 89 = 0 THEN 'NaN'::DOUBLE ELSE px END")


def macro_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    known = F.col("date") >= F.lit(MACRO_START).cast("date")
    return (o.groupBy(F.to_date("o_orderdate").alias("date"))
             .agg(F.avg("o_totalprice").alias("macro_px"),
                  F.count(F.lit(1)).cast("double").alias("macro_n"))
             .withColumn("macro_px", F.when(known, F.col("macro_px"))))


MACRO_SQL = f"""
  SELECT CAST(o_orderdate AS DATE) AS date,
         CASE WHEN CAST(o_orderdate AS DATE) >= DATE '{MACRO_START}' THEN avg(o_totalprice) END AS macro_px,
         CAST(count(*) AS DOUBLE) AS macro_n
  FROM orders GROUP BY CAST(o_orderdate AS DATE)"""


def event_features(spark: SparkSession, sf_dir: str, before: str | None = None,
                   since: str | None = None) -> DataFrame:
    """events with the integer JSON property ``k`` as a double feature.
    ``before`` / ``since`` filter the raw timestamp, so they reach the scan."""
    e = table(spark, sf_dir, "events")
    if before is not None:
        e = e.filter(F.col("ts") < F.lit(before).cast("timestamp_ntz"))
    if since is not None:
        e = e.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type",
                    "value", F.get_json_object("props", "$.k").cast("double").alias("k"))


EVENTS_SQL = """
  SELECT event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events"""
