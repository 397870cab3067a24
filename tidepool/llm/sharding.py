"""Sharding by sampled splitters: shards of nearly equal bytes.

Records are ordered by (hash of the text, id). A size-weighted sample of keys
gives quantile boundaries, and records are dealt to the ranges between them; a
range that turns out overfull (one text held by many documents, say) is
subdivided by a sample of its own, by id within the text if need be. Then each
range counts its bytes in key order, the ranges' totals become offsets, and a
record's place in the whole order says its shard. So shard borders are exact,
and no task holds more than a few range shares.

Equal texts stand next to each other. A group of them stays in one shard unless
it is larger than a hundredth of a shard; then it is cut where the bytes say.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import order_id
from tidepool.session import materialize

RANGES = 8          # ranges for each shard
SAMPLE = 24         # sampled keys for each range
FULL = 3            # a range of so many shares is subdivided
FIRST = -(1 << 63)  # below every id


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("_id"), (F.octet_length(text) + 16).cast("long").alias("_size"),
                       F.crc32(text).alias("_crc"), F.xxhash64(text).alias("_k1"),
                       order_id(F.col(f"`{id_col}`")).alias("_k2"))


def sample_keys(rows: DataFrame, n: int, seed: int) -> list[tuple[int, int]]:
    """n keys drawn without replacement with chances by size (exponential
    races; the hash makes the draw repeatable), in key order."""
    u = (F.shiftrightunsigned(F.xxhash64("_k1", "_k2", F.lit(seed)), 11) + 1) / F.lit(float((1 << 53) + 1))
    race = -F.ln(u) / F.col("_size")
    got = rows.select(race.alias("r"), "_k1", "_k2").orderBy("r", "_k1", "_k2").limit(n).collect()
    return sorted((r["_k1"], r["_k2"]) for r in got)


def boundaries(keys: list[tuple[int, int]], parts: int, after: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """At most parts - 1 quantiles of the sampled keys. A boundary stands before
    all documents of its text, unless that place is taken: then before its id."""
    out: list[tuple[int, int]] = []
    for i in range(1, parts):
        k1, k2 = keys[min(len(keys) - 1, i * len(keys) // parts)]
        cut = (k1, FIRST)
        if (out and out[-1] >= cut) or (after is not None and after >= cut):
            cut = (k1, k2)
        if not out or cut > out[-1]:
            out.append(cut)
    return out


def range_of(k1: np.ndarray, k2: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Number of boundaries at or below each key; ``cuts`` (n, 2), sorted."""
    lo, hi = (np.searchsorted(cuts[:, 0], k1, side) for side in ("left", "right"))
    out = lo.copy()
    for at in np.unique(lo[hi > lo]):
        here = (lo == at) & (hi > lo)
        end = int(hi[here][0])
        out[here] = at + np.searchsorted(cuts[at:end, 1], k2[here], "right")
    return out


def _ranged(rows: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    table = np.array(cuts, np.int64).reshape(-1, 2)

    @F.pandas_udf("int")
    def at(k1: pd.Series, k2: pd.Series) -> pd.Series:
        return pd.Series(range_of(k1.to_numpy(), k2.to_numpy(), table).astype(np.int32))

    return rows.withColumn("_r", at("_k1", "_k2"))


def split_ranges(rows: DataFrame, parts: int, rounds: int = 5) -> tuple[list[tuple[int, int]], list]:
    """Boundaries, and (range, bytes, rows) of every range that has records.
    Only records that agree in text and id can leave a range overfull."""
    cuts = boundaries(sample_keys(rows, parts * SAMPLE, 1), parts)
    for turn in range(rounds + 1):
        stats = (_ranged(rows, cuts).groupBy("_r").agg(
            F.sum("_size").alias("bytes"), F.count("*").alias("n"), F.min(F.struct("_k1", "_k2")).alias("lo"),
            F.max(F.struct("_k1", "_k2")).alias("hi")).orderBy("_r").collect())
        share = sum(s["bytes"] for s in stats) / parts
        full = {s["_r"]: s for s in stats if s["bytes"] > FULL * share and s["lo"] != s["hi"]}
        if not full or turn == rounds:
            return cuts, stats
        want = {r: math.ceil(s["bytes"] / share) for r, s in full.items()}
        inside = _ranged(rows, cuts).filter(F.col("_r").isin(list(full)))
        keys = np.array(sample_keys(inside, SAMPLE * sum(want.values()), turn + 2), np.int64).reshape(-1, 2)
        owner = range_of(keys[:, 0], keys[:, 1], np.array(cuts, np.int64).reshape(-1, 2))
        more = [c for r, n in want.items() if (owner == r).any()
                for c in boundaries([tuple(map(int, k)) for k in keys[owner == r]], n, cuts[r - 1] if r else None)]
        cuts = sorted({*cuts, *more})
    raise AssertionError


def shard(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, shard, slot), one row for each input row.

    size is the text's UTF-8 bytes plus 16 (null text: 16, crc32 0); slot counts
    from 0 in every shard, without gaps. Null ids come last among equal texts.
    Repeated rows get slots of their own. With few rows some shards stay empty;
    an empty table gives no rows. Other columns are not read.
    """
    rows = materialize(keyed(docs, id_col, text_col), "shard-keys")
    final = lambda df: df.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
                                 F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))
    if rows.isEmpty():
        return final(rows.withColumn("_shard", F.lit(0)).withColumn("_slot", F.lit(0).cast("long")))
    cuts, stats = split_ranges(rows, shards * RANGES)
    total = sum(s["bytes"] for s in stats)
    offsets, at_bytes, at_rows = [], 0, 0
    for s in stats:          # at most a few for each of shards * RANGES
        offsets.append((s["_r"], at_bytes, at_rows))
        at_bytes, at_rows = at_bytes + s["bytes"], at_rows + s["n"]
    spark = docs.sparkSession
    offset = F.broadcast(spark.createDataFrame(offsets, "_r int, _b long, _n long"))
    order = Window.partitionBy("_r").orderBy("_k1", "_k2", "_size", "_crc")
    group = Window.partitionBy("_r", "_k1")
    placed = (_ranged(rows, cuts)
              .withColumn("_start", F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
              .withColumn("_row", F.row_number().over(order))
              .withColumn("_gb", F.sum("_size").over(group)).withColumn("_gs", F.min("_start").over(group))
              .join(offset, "_r"))
    whole = F.col("_gb") * shards * 100 <= total
    place = F.col("_b") + F.when(whole, F.col("_gs")).otherwise(F.col("_start"))
    number = F.least(F.floor(place * shards / total).cast("int"), F.lit(shards - 1))
    placed = materialize(placed.select("_id", "_size", "_crc", number.alias("_shard"),
                                       (F.col("_n") + F.col("_row") - 1).alias("_row")), "shard-placed")
    first = placed.groupBy("_shard").agg(F.min("_row").alias("_first"))      # one row for each shard
    return final(placed.join(F.broadcast(first), "_shard").withColumn("_slot", F.col("_row") - F.col("_first")))
