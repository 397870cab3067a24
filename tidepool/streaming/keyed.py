"""The newest N records of every key, kept in the state store.

The state is a list for each (key, salt): a record's salt is a hash of its
order columns, so a key with a third of the stream is spread over ``salts``
tasks, and the newest N of a key are among the newest N of its salts. The lists
live in the streaming checkpoint; the view reads them from there, so nothing is
rewritten by batch and nothing has to be compacted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidepool.streaming.jobs import file_stream

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LOWEST = -(1 << 63)
STATE = "o0 long, o1 long, payload string"
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class NewestN(StatefulProcessor):
    """Keeps the n largest (o0, o1) of a group; emits how many it holds."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getListState("newest", STATE)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import heapq

        import pandas as pd

        held = [tuple(r) for r in self.newest.get()] if self.newest.exists() else []
        for batch in rows:
            # of a batch the n newest at most can stay
            top = batch.nlargest(self.n, ["o0", "o1"], keep="all") if len(batch) > self.n else batch
            held.extend(zip(top["o0"].tolist(), top["o1"].tolist(), top["payload"].tolist()))
            if len(held) > 4 * self.n:
                held = heapq.nlargest(self.n, held)
        held = heapq.nlargest(self.n, held)
        self.newest.put(held)
        yield pd.DataFrame({"size": [len(held)]})

    def close(self) -> None:
        pass


def _order(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType
    value = F.unix_micros(F.col(c).cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else \
        F.col(c).cast("long")
    return F.coalesce(value, F.lit(LOWEST))


def newest_per_key_stream(spark: SparkSession, source: str, checkpoint: str, schema: T.StructType, key: str, n: int,
                          order: Sequence[str] = ("ts", "id"), salts: int = 16, files_per_batch: int = 8) -> DataFrame:
    """Keep the newest ``n`` records of every value of ``key`` by two ``order``
    columns (times, dates or integers; null is oldest); returns them with a
    ``rank`` (1 is the newest; equal records in the order of their contents).

    The state has as many partitions as there are salts or cores, not more than
    the session's shuffle has: every one costs a Python worker and a commit in
    every batch, whether it has rows or not.

    A null key is a key of its own. The result does not depend on how the
    records are split into batches or on when they come; a restart over the
    same checkpoint goes on where the last run ended.
    """
    stream = file_stream(spark, source, schema, files_per_batch)
    first, second = (_order(stream, c) for c in order)
    rows = stream.select(F.col(key).cast("string").alias("key"), first.alias("o0"), second.alias("o1"),
                         F.to_json(F.struct(*schema.fieldNames()), JSON).alias("payload"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("o0", "o1"), F.lit(salts)))
    before = {c: spark.conf.get(c) for c in (PROVIDER, PARTITIONS)}
    spark.conf.set(PROVIDER, ROCKSDB)           # list state needs it
    spark.conf.set(PARTITIONS, min(int(before[PARTITIONS]), max(salts, spark.sparkContext.defaultParallelism)))
    try:
        state = rows.groupBy("key", "salt").transformWithStateInPandas(
            NewestN(n), T.StructType([T.StructField("size", T.LongType())]), "Update", "None")
        q = state.writeStream.format("noop").outputMode("update").option(
            "checkpointLocation", f"{checkpoint}/newest").trigger(availableNow=True).start()
        q.awaitTermination()
        if q.exception() is not None:  # pragma: no cover - surfaced to caller
            raise RuntimeError(str(q.exception()))
        held = spark.read.format("statestore").option("path", f"{checkpoint}/newest").option("stateVarName", "newest").load()
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    held = held.select("key.key", "list_element.*")
    newest = Window.partitionBy("key").orderBy(F.desc("o0"), F.desc("o1"), F.desc("payload"))     # salts * n rows at most
    held = held.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= n)
    return held.select(F.from_json("payload", schema, JSON).alias("r"), "rank").select("r.*", "rank")
