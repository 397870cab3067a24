"""File sources and sinks: CSV / Parquet / JSON scans and appends.

Scans take an explicit schema (no inference job over the data); a missing
path raises ``AnalysisException`` from Spark itself, like the reference's
FileNotFoundError.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# request batches: sequence[timestep][feature]
REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("sequence", T.ArrayType(T.ArrayType(T.DoubleType()))),
])


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header row. With ``schema`` the types are fixed; without it
    they are inferred (one extra pass; avoid on large inputs)."""
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Parquet sink; the row id is an explicit column (no hidden index)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_reference(spark: SparkSession, path: str | None, fmt: str = "parquet",
                   schema: T.StructType | None = None) -> DataFrame | None:
    """Reference sample for drift checks; None when missing or unreadable
    (the drift status then becomes ``insufficient_data``)."""
    if not path:
        return None
    try:
        if fmt == "csv":
            df = scan_csv(spark, path, schema)
        else:
            df = spark.read.format(fmt).load(path) if schema is None else spark.read.schema(schema).format(fmt).load(path)
        df.schema  # noqa: B018 - resolves the path now
        return df
    except AnalysisException:
        return None


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of prediction requests ``{"request_id", "ts", "sequence": [[...]]}``.
    Values that are not numbers become NULL and are rejected by validation."""
    return spark.read.schema(REQUEST_SCHEMA).json(path)


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append-only log sink (prediction log, run log)."""
    df.write.mode("append").format(fmt).save(path)
