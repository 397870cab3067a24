"""One query for each operator, over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import (bpe, decontaminate, html_extract, interpolation, periodic_runs, prefix_trie, quality, sharding, simhash, substring, token_counts,
                          toxicity, url_filter)
from tidepool.llm.common import small_batches, table, words
from tidepool.llm.sql import ORACLE
from tidepool.session import materialize


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = quality.judge(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept")


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter.judge(pages, table(spark, sf_dir, "documents"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "score")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
                       decontaminate.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring.remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed",
                      F.sha2(F.array_join(words(F.col("text")), " "), 256).alias("kept_sha256"))


def rank_file(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    @F.arrow_udf("string")          # as bpe.decode is, so one worker runs both
    def ids_sha256(ids: pa.Array) -> pa.Array:
        from hashlib import sha256

        at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        return pa.array([sha256(flat[lo:hi]).hexdigest() for lo, hi in zip(at, at[1:])], pa.string())

    small_batches(spark, mb=2)      # the workers that encode and decode live at a time, however long the texts
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = bpe.load_ranks(rank_file())
    ids = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_sha256("ids").alias("ids_sha256"),
                      F.sha2(bpe.decode(F.col("ids"), ranks), 256).alias("decoded_sha256"))


def fold_of(doc_id, n: int):
    """crc32 of the id as text, modulo n (null: the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(n))


def toxicity_lexicon(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Lexicon:
    """Learned from the labelled documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(fold_of(F.col("doc_id"), 3) != 1)
    chosen = toxicity.choose(labels)                        # some 24,000 ids and labels at most
    return toxicity.learn(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity_lexicon(spark, sf_dir, docs))
    return out.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                      (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = fold_of(F.col("doc_id"), 5)
    out = interpolation.score(docs, fold != 1, fold == 0)
    return out.select("doc_id", (fold == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = html_extract.main_text(pages, html_extract.train(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialize(prefix_trie.ordered_turns(table(spark, sf_dir, "conversations")), "trie-turns")
    rebuilt, convs = prefix_trie.share_heads(turns, lambda c: fold_of(c, 6), lambda c: c - c % 100, 5)
    return prefix_trie.trie(rebuilt, convs)


def planted_order(doc_id, n: int) -> np.ndarray:
    """The indices of the words that op12 reads: of a tenth of the documents
    the words from some place on repeat with some period."""
    import zlib

    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    i, g = np.arange(n), h // 10
    if h % 10 or not n:
        return i
    a = g % n
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = periodic_runs.collapse_runs(docs, order=planted_order, order_col="doc_id")
    runs = F.col("runs")
    # the first of the runs with the greatest exact length / period; they lie by start, then period
    best = F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.try_element_at(runs, F.lit(1)),
                       lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    lines = F.transform(runs, lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    return out.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"),
                      F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
                      F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    out = token_counts.prefix_counts(docs, token_counts.load(rank_file("word_bpe_49k.json")), keep_text=False)
    counts = F.col("prefix_tokens")
    return out.select("doc_id", "n_bytes", token_counts.n_tokens(counts).alias("n_tokens"),
                      (~token_counts.fits(counts, F.lit(2048))).alias("over_limit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_urls": op2_urls,
    "op3_decontaminate": op3_decontaminate,
    "op4_simhash": op4_simhash,
    "op5_sharding": op5_sharding,
    "op6_substring": op6_substring,
    "op7_bpe": op7_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_interpolation": op9_interpolation,
    "op10_html": op10_html,
    "op11_trie": op11_trie,
    "op12_runs": op12_runs,
    "op13_tokens": op13_tokens,
}
