"""SimHash near-duplicates by multi-index hashing.

Fingerprints have 64 bits, in two segments of 32. Two fingerprints that differ
in at most two bits differ in at most one bit of the high segment, or not at
all in the low one. So one table is probed with the Hamming ball of radius 1
around the high segment, the other with the low segment itself; every table
match is verified by its complete distance. A ball of radius 1 is enumerated
from the side whose bit is zero, so each pair comes up once.

A segment value that many different fingerprints share would pair them all.
Beyond ``hot`` fingerprints in one table slot, the rest of the distance is
enumerated as well, and the probe meets the other fingerprint by its full 64
bits: at most 33 (or 497) keys for each fingerprint, however full the slot is.
Both ways find the same pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import numbered
from tidepool.session import materialize

LOW = 0xFFFFFFFF


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half of the shingle
    hashes (XXH64, seed 42). Fewer words than a shingle: the whole sequence;
    no word: 0."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*[w[i:] for i in range(shingle)])) if len(w) >= shingle else [b" ".join(w)]
    h = np.array([xxh64_intdigest(g, 42) for g in grams], "<u8")
    ones = np.zeros(64, np.int64)
    for part in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[part:part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, *, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` with ``_fp`` (the fingerprint as a signed long)."""

    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in text], np.uint64).view(np.int64), dtype="int64")

    return docs.withColumn("_fp", fp(F.col(text_col)))


def _bits(n: int, at: int) -> list[int]:
    return [(1 << (at + i)) - (1 << 64 if at + i == 63 else 0) for i in range(n)]


def links(fps: DataFrame, *, hot: int = 512) -> DataFrame:
    """(a, b), a < b: distinct fingerprints ``_fp`` that differ in one or two bits."""
    fps = fps.select("_fp").distinct()
    hi, lo = F.shiftrightunsigned("_fp", 32), F.col("_fp").bitwiseAND(LOW)
    table_hi, table_lo = fps.withColumn("_k", hi), fps.withColumn("_k", lo)
    hi_bits, lo_bits = _bits(32, 32), _bits(32, 0)

    def full(t: DataFrame) -> DataFrame:
        return t.groupBy("_k").count().filter(F.col("count") > hot).select("_k", F.lit(True).alias("_hot"))

    ball = F.array(F.struct(hi.alias("k"), F.lit(0).alias("f")),
                   *[F.struct(hi.bitwiseOR(1 << i).alias("k"), F.lit(1).alias("f")) for i in range(32)])
    ball = F.filter(ball, lambda x: (x["f"] == 0) | (x["k"] != hi))
    probe = fps.withColumn("_x", F.explode(ball)).select("_fp", F.col("_x.k").alias("_k"), F.col("_x.f").alias("_f"))
    probe = probe.join(full(table_hi), "_k", "left")
    far = F.bit_count(F.col("_fp").bitwiseXOR(F.col("_other")))

    def near(p: DataFrame, t: DataFrame, fits: Column) -> DataFrame:
        return p.join(t.withColumnRenamed("_fp", "_other"), "_k").filter(fits).select("_fp", "_other")

    def enumerated(p: DataFrame, flips: Column) -> DataFrame:
        p = p.select("_fp", F.explode(flips).alias("_other"))
        return p.join(fps.withColumnRenamed("_fp", "_other"), "_other", "left_semi")

    # high segment: equal (pairs in order, distance 1 or 2) or one bit apart (0 -> 1 from this side)
    cold = near(probe.filter("_hot is null"), table_hi,
                F.when(F.col("_f") == 0, (F.col("_fp") < F.col("_other")) & (far <= 2)).otherwise(far <= 2))
    moved = F.shiftleft("_k", 32).bitwiseOR(lo)
    one = [moved.bitwiseXOR(x) for x in lo_bits]
    two = [moved.bitwiseXOR(x ^ y) for i, x in enumerate(lo_bits) for y in lo_bits[:i]]
    dense = probe.filter("_hot is not null").withColumn("_m", moved)
    flips = F.when(F.col("_f") == 0, F.filter(F.array(*one, *two), lambda o: o > F.col("_fp"))).otherwise(
        F.array(F.col("_m"), *one))
    hot_hi = enumerated(dense, flips)
    # low segment equal, exactly two bits of the high segment apart
    probe_lo = table_lo.join(full(table_lo), "_k", "left")
    cold_lo = near(probe_lo.filter("_hot is null"), table_lo, (F.col("_fp") < F.col("_other")) & (far == 2))
    pairs = [F.col("_fp").bitwiseXOR(x ^ y) for i, x in enumerate(hi_bits) for y in hi_bits[:i]]
    hot_lo = enumerated(probe_lo.filter("_hot is not null"), F.filter(F.array(*pairs), lambda o: o > F.col("_fp")))
    every = cold.unionAll(hot_hi).unionAll(cold_lo).unionAll(hot_lo)
    return every.select(F.least("_fp", "_other").alias("a"), F.greatest("_fp", "_other").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b): root is the smallest
    vertex reachable. Alternating large-star and small-star rounds; each round
    is written to the shared folder, so lineage stays short. Raises if the
    rounds do not settle (they settle in O(log^2) of the vertices)."""
    cur = materialize(edges.select("a", "b"), "simhash-edges")
    seen = None
    for _ in range(max_rounds):
        both = cur.select("a", "b").unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = materialize(large.distinct(), "simhash-large")          # a > b
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionAll(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        cur = materialize(small, "simhash-small")                       # a > b
        now = (*cur.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first(),)
        if now == seen:
            return cur.select(F.col("a").alias("v"), F.col("b").alias("root")).unionAll(
                cur.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
        seen = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    carry: list[str] | None = None) -> DataFrame:
    """One row per input row: ``id_col``, the columns in ``carry``, fingerprint
    (16 hex digits) and component_id, the smallest id reachable over links of
    at most two bits.

    Texts without words have fingerprint zero and link like any other. Null
    ids are never a component_id while the component has another; a component
    of null ids alone has a null component_id. Repeated rows share a
    fingerprint and so a component. Other columns are not read.
    """
    carry = [c for c in (carry or []) if c != id_col]
    narrow = with_fingerprint(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_t"),
                                          *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)]), text_col="_t", shingle=shingle).drop("_t")
    narrow = materialize(narrow, "simhash-docs")
    out = narrow.join(_members(narrow), "_fp")
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
                      F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def _members(rows: DataFrame) -> DataFrame:
    """(_fp, _root, component_id) for the fingerprints of ``rows`` (_fp, _id)."""
    by_fp = materialize(rows.groupBy("_fp").agg(F.min("_id").alias("_first")), "simhash-fps")
    comp = components(links(by_fp))
    member = by_fp.join(comp, by_fp._fp == comp.v, "left").select(
        "_fp", F.coalesce("root", "_fp").alias("_root"), "_first")
    roots = member.groupBy("_root").agg(F.min("_first").alias("component_id"))
    return materialize(member.join(roots, "_root").select("_fp", "_root", "component_id"), "simhash-members")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the one with the
    smallest id (null ids last). Of rows that agree in it, one stays."""
    plain, names = numbered(docs)
    full = materialize(with_fingerprint(plain, text_col=names[text_col], shingle=shingle)
                       .withColumn("_row", F.monotonically_increasing_id()), "simhash-rows")
    rows = full.select("_fp", "_row", F.col(names[id_col]).alias("_id"))
    first = rows.join(_members(rows), "_fp").groupBy("_root").agg(
        F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_row")).alias("m"))
    kept = full.join(first.select(F.col("m._row").alias("_row")), "_row", "left_semi")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
