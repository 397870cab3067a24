"""Helpers shared by the training-data operators: reading the tables, slicing
Arrow batches by bytes, word hashes."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Java regular expressions: white space as the contracts define it, and the
# separators of lower-cased alphanumeric words (all of them ASCII).
SPACE = r"[\x20\x09-\x0D]+"
ALNUM_SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MAX_ID = (1 << 63) - 1
SLICE_BYTES = 12 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def small_batches(spark: SparkSession, rows: int = 2_000, mb: int = 64) -> None:
    """Fewer rows in an Arrow batch, for queries that pass whole texts through
    several Python stages: each stage of each task holds a batch. A batch of
    ``mb`` MB takes no further row (64 is Spark's own bound)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", mb << 20)


def words(text: Column, separators: str = SPACE) -> Column:
    """Words of a text as an array (null text: empty array)."""
    return F.coalesce(F.array_remove(F.split(text, separators), ""), F.array().cast("array<string>"))


def order_id(doc_id: Column) -> Column:
    """doc_id as a total order; a null id sorts after every other id."""
    return F.coalesce(doc_id.cast("long"), F.lit(MAX_ID))


def numbered(docs: DataFrame, without: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns renamed to _c0, _c1, ..., so that they cannot
    clash with working columns, and the new name of each; columns named in
    ``without`` (a result will replace them) are left out."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c not in without}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def most_frequent(counts: DataFrame, n: int, col: str) -> DataFrame:
    """The rows with the largest counts, n at most: whole frequency classes (a
    sixteenth of a doubling each) from the top, as many as fit. Sizes of the
    classes are all that is gathered; there is no ordering in one task."""
    cls = F.floor(F.log2(F.greatest(F.col(col), F.lit(1))) * 16).cast("int")
    sizes = counts.groupBy(cls.alias("cls")).agg(F.count("*").alias("n")).collect()     # 1,024 at most
    lowest, held = 1 << 20, 0
    for r in sorted(sizes, key=lambda r: -r["cls"]):
        held += r["n"]
        if held > n:
            break
        lowest = r["cls"]
    return counts.filter(cls >= lowest)


def hash_sample(rows: DataFrame, n: int, key: Column) -> DataFrame:
    """About n rows (all, if there are no more), the same ones whatever the
    partitioning: those whose hash falls into the share n / count."""
    total = rows.count()
    share = 1 << 30 if total <= n else max(1, (n << 30) // total)
    return rows.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < share)


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds about ``limit`` bytes of
    ``column`` (a single longer text stays whole, in a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        kind = pa.large_binary() if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else col.type
        sizes = pa.compute.fill_null(pa.compute.binary_length(col.cast(kind)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(int(lo), int(hi - lo))


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """64-bit hash of each ``[^\\x20\\x09-\\x0D]+`` word, in order."""
    from xxhash import xxh64_intdigest

    data = (text or "").encode("utf-8", "surrogatepass")
    return np.array([xxh64_intdigest(w) for w in (data.lower() if lower else data).split()], np.uint64)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit combination of two hash arrays."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(30))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k consecutive entries, by doubling: windows of
    1, 2, 4 ... are combined, and the binary digits of k say which to chain."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out, at, power, size = None, 0, h, 1
    while True:
        if k & size:
            part = power[at:at + n]
            out = part if out is None else mix(out, part)
            at += size
        if size * 2 > k:
            return out if k > 1 else h
        power = mix(power[:-size], power[size:])
        size *= 2
