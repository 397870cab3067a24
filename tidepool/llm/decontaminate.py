"""Benchmark decontamination with DataFrame functions only.

Method: a hash set of normalised benchmark n-grams is shipped to the tasks, the
training token windows are scanned against it, and every hit is verified word
by word before it counts.

A window is ``n`` consecutive words of an item (the whole item if it has
fewer). Any window of k words in a document contains a complete block of
``b = (k + 1) // 2`` words whose start is a multiple of b. So the set holds the
b-grams of the benchmark at every offset, and a document hashes its aligned
blocks only: one b-th of its positions. The set is exact as a filter: a missed
block means there is no window. Its size is checked; beyond
``max_broadcast_grams`` the blocks are joined by shuffle instead, with the same
result.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import ALNUM_SEP, numbered, words
from tidepool.session import materialize

RESULT = ("n_words", "n_hit", "hit_items", "hit_spans")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def _block(ws: Column, start: Column, b: int) -> Column:
    """Hash of b words from 1-based ``start``. ``lower`` maps more letters than
    A-Z, the same in every context of a word, so equal words stay equal here;
    the exact comparison follows."""
    return F.xxhash64(F.lower(F.array_join(F.slice(ws, start, b), " ")))


def benchmark_windows(benchmark: DataFrame, n: int, item_col: str, text_col: str) -> DataFrame:
    """(_item, _bw: normalised words, _k: window length); items without words are left out."""
    b = benchmark.select(F.col(item_col).cast("string").alias("_item"),
                         words(_ascii_lower(F.col(text_col)), ALNUM_SEP).alias("_bw"))
    return b.filter("size(_bw) > 0").withColumn("_k", F.least(F.lit(n), F.size("_bw")))


def find_hits(docs: DataFrame, benchmark: DataFrame, *, n: int = 13, text_col: str = "text",
              item_col: str = "item_id", bench_text_col: str = "text",
              max_broadcast_grams: int = 200_000) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_items (sorted strings), hit_spans
    (sorted 0-based word positions that are hit).

    Null or word-less texts have zero counts and empty lists. Items without
    words match nothing; an item whose id is null counts as a hit but has no
    entry in hit_items. Repeated rows are judged one by one; repeated items
    count once per id. Input columns keep their names; the four result columns
    replace input columns of the same name.
    """
    bench = benchmark_windows(benchmark, n, item_col, bench_text_col).persist(StorageLevel.MEMORY_AND_DISK)
    shortest = bench.agg(F.min("_k")).first()[0]
    docs, names = numbered(docs, RESULT)
    keep, back = list(names.values()), [F.col(n).alias(c) for c, n in names.items()]
    base = docs.select(*keep, words(F.col(names[text_col]), ALNUM_SEP).alias("_w"))
    empty = {"hit_items": F.array().cast("array<string>"), "hit_spans": F.array().cast("array<int>")}
    if shortest is None:
        return base.select(*back, F.size("_w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
                           *[v.alias(k) for k, v in empty.items()])
    b = (int(shortest) + 1) // 2
    grams = (bench.withColumn("_q", F.explode(F.sequence(F.lit(1), F.size("_bw") - (b - 1))))
             .withColumn("_g", _block(F.col("_bw"), F.col("_q"), b)))
    known = grams.select("_g").distinct().limit(max_broadcast_grams + 1).collect()
    starts = F.expr(f"if(size(_w) >= {b}, sequence(1, size(_w) - {b - 1}, {b}), cast(array() as array<int>))")
    blocks = F.transform(starts, lambda i: F.struct(i.alias("p"), _block(F.col("_w"), i, b).alias("g")))
    small = len(known) <= max_broadcast_grams
    if small:
        hashes = [r[0] for r in known]
        blocks = F.filter(blocks, lambda x: x["g"].isin(hashes))
    scanned = base.withColumn("_c", blocks)
    # one pass over the texts; words stay only where a block may match
    scanned = materialize(
        scanned.select(*keep, F.size("_w").cast("long").alias("n_words"), F.monotonically_increasing_id().alias("_uid"),
                       F.when(F.size("_c") > 0, F.col("_w")).alias("_w"),
                       F.when(F.size("_c") > 0, F.col("_c")).alias("_c")), "decontaminate")
    cand = (scanned.filter("_c is not null")
            .select("_uid", "_w", F.explode("_c").alias("_c"))
            .select("_uid", "_w", F.col("_c.p").alias("_p"), F.col("_c.g").alias("_g")))
    right = grams.select("_g", "_q", "_k", "_bw", "_item")
    pairs = cand.join(F.broadcast(right) if small else right, "_g")
    # every window that contains the block, compared word by word
    win = (pairs.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - b)))
           .filter("_p - _o >= 1 and _q - _o >= 1 and _q - _o + _k - 1 <= size(_bw) and _p - _o + _k - 1 <= size(_w)")
           .filter(F.transform(F.slice("_w", F.col("_p") - F.col("_o"), F.col("_k")), _ascii_lower)
                   == F.slice("_bw", F.col("_q") - F.col("_o"), F.col("_k")))
           .select("_uid", "_item", (F.col("_p") - F.col("_o") - 1).alias("_s"), "_k"))
    hits = win.groupBy("_uid").agg(
        F.array_sort(F.collect_set("_item")).alias("_items"),
        F.collect_set(F.struct("_s", "_k")).alias("_win"))
    spans = F.array_sort(F.array_distinct(F.flatten(F.transform(
        "_win", lambda x: F.sequence(x["_s"], x["_s"] + x["_k"] - 1)))))
    hits = hits.select("_uid", F.col("_items"), spans.alias("_spans"))
    out = scanned.drop("_w", "_c").join(hits, "_uid", "left")
    return out.select(*back, "n_words", F.coalesce(F.size("_spans"), F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("_items", empty["hit_items"]).alias("hit_items"),
                      F.coalesce("_spans", empty["hit_spans"]).alias("hit_spans"))


def contaminated(n_words: Column, n_hit: Column, share: int = 20) -> Column:
    """A document is contaminated if at least one ``share``-th of its words is hit."""
    return (n_hit > 0) & (n_hit * share >= n_words)


def remove_spans(hits: DataFrame, text_col: str = "text") -> DataFrame:
    """Cut the hit words out of the text; what is kept is joined by one space.
    Texts without a hit stay as they are."""
    ws = words(F.col(text_col), ALNUM_SEP)
    kept = F.array_join(F.filter(F.transform(ws, lambda w, i: F.when(F.array_contains("hit_spans", i), F.lit(None))
                                             .otherwise(w)), lambda w: w.isNotNull()), " ")
    return hits.withColumn(text_col, F.when(F.col("n_hit") > 0, kept).otherwise(F.col(text_col)))
