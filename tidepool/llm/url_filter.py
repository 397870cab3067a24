"""URL filters: rules first, then a classifier over the words of the URL.

Concatenated host names are split into words by a unigram Viterbi: the counts
of all words of a corpus give every piece of a name a probability, and the best
chain of pieces wins. Multinomial naive Bayes over the words of host and path
then decides for URLs that no rule covers; it is trained on all URLs that a
rule does cover. Words are counted in ``buckets`` hash buckets, which bounds
the model, whatever the number of hosts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import by_bytes
from tidepool.session import materialize

LONGEST = 20        # letters of a word in a host name
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; null or no "://": both empty."""
    rest = F.when(F.contains(url, F.lit("://")), F.element_at(F.split(url, "://", 2), 2)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def match_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. Rules
    are (verdict, host, path) and few: they become a literal."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(ordered):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def unigrams(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """(piece, n): counts of the a-z words, of at most LONGEST letters, of the
    whole corpus (host names have no others)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(r"[^\W\d_]+").findall
        for part in by_bytes(batches, "t"):
            seen: Counter = Counter()
            for text in part.column("t").to_pylist():
                if text:
                    seen.update(text.lower().split())
            n: Counter = Counter()
            for chunk, k in seen.items():
                for w in find(chunk):
                    if len(w) <= LONGEST and w.isascii():
                        n[w] += k
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())],
                                             names=["piece", "n"])

    rows = corpus.select(F.col(text_col).alias("t")).mapInArrow(run, "piece string, n long")
    return rows.groupBy("piece").agg(F.sum("n").alias("n"))


def viterbi(name: str, counts: dict[tuple[int, int], int], total: int) -> list[str]:
    """Best split of a name; counts are by (start, length) of a piece. A piece
    that is no word has probability 10 / (total * 10 ** length), total 10 at least."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for size in range(1, min(end, LONGEST) + 1):
            n = counts.get((end - size, size))
            p = math.log10(n / total) if n else 1 - math.log10(max(total, 10)) - size
            options.append((best[end - size][0] + p, size))
        best.append(max(options))
    out, end = [], len(name)
    while end:
        size = best[end][1]
        out.append(name[end - size:end])
        end -= size
    return out[::-1]


def segment(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, words) for the distinct a-z names in ``names``; ``words`` holds
    (piece, n). Names' pieces meet their counts by a join, so neither side has
    to fit in memory; a name's own pieces are at most LONGEST per letter."""
    total = words.agg(F.sum("n")).first()[0] or 0
    names = names.select("name").filter("name <> ''").distinct()
    sizes = F.sequence(F.lit(1), F.least(F.length("name") - F.col("at"), F.lit(LONGEST)))
    pieces = (names.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("name") - 1)))
              .withColumn("size", F.explode(sizes))
              .withColumn("piece", F.expr("substring(name, at + 1, size)")))
    known = (pieces.join(words, "piece").groupBy("name")
             .agg(F.collect_list(F.struct("at", "size", "n")).alias("known")))

    @F.pandas_udf("array<string>")
    def run(name: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([viterbi(w, {(k["at"], k["size"]): k["n"] for k in (ks if ks is not None else ())}, total)
                          for w, ks in zip(name, known)])

    return names.join(known, "name", "left").select("name", run("name", "known").alias("words"))


def with_tokens(urls: DataFrame, words: DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with ``tokens``: segmented host words and path
    words; a run of digits is one token, "#"."""
    hosts = materialize(urls.select("host").distinct(), "url-hosts")
    names = hosts.select("host", F.posexplode(F.expr("regexp_extract_all(host, '[a-z]+|[0-9]+', 0)")).alias("i", "name"))
    split = segment(names.filter("name rlike '^[a-z]'"), words)
    parts = names.join(split, "name", "left").select(
        "host", F.struct("i", F.coalesce("words", F.array(F.lit("#"))).alias("w")).alias("p"))
    known = parts.groupBy("host").agg(F.array_sort(F.collect_list("p")).alias("p"))
    known = materialize(known.select("host", F.flatten("p.w").alias("hw")), "url-host-words")
    out = urls.join(known, "host", "left")
    path = F.expr(r"regexp_extract_all(lower(path), '[\\p{L}]+|[0-9]+', 0)")
    tokens = F.concat(
        F.transform(F.coalesce("hw", F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w)),
        F.transform(path, lambda w: F.concat(F.lit("p:"), F.when(F.rlike(w, F.lit("^[0-9]")), "#").otherwise(w))))
    return out.withColumn("tokens", tokens).drop("hw")


def train(rows: DataFrame, buckets: int) -> tuple[float, np.ndarray]:
    """Prior log odds and token log odds (block against allow) by bucket, from
    all rows with a ``verdict``. One class only: that class always wins."""
    known = rows.filter("verdict is not null")
    n = {r["verdict"]: r["n"] for r in known.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    prior = math.log((n.get("block", 0) + 1) / (n.get("allow", 0) + 1))
    got = (known.select("verdict", F.explode("buckets").alias("b")).groupBy("b", "verdict").agg(F.count("*").alias("n"))
           .toPandas())          # at most two rows for each bucket
    count = {c: np.ones(buckets) for c in ("block", "allow")}
    for c in count:
        here = got[got["verdict"] == c]
        np.add.at(count[c], here["b"].to_numpy(np.int64), here["n"].to_numpy(np.float64))
    # add one over the tokens that occur, and one for all others
    size = {c: v.sum() - buckets + got["b"].nunique() + 1 for c, v in count.items()}
    return prior, np.log(count["block"] / size["block"]) - np.log(count["allow"] / size["allow"])


def judge(urls: DataFrame, corpus: DataFrame, rules: list[tuple[str, str, str]], *, url_col: str = "url",
          carry: list[str] = ("page_id",), buckets: int = 1 << 16) -> DataFrame:
    """One row for each row of ``urls``: the columns in ``carry``, host, path,
    rule, verdict, tokens, score (log odds of block; rules do not change it).

    Null and unusable URLs have an empty host and path and are scored by the
    prior alone. Repeated rows are judged one by one. Without a single URL
    under a rule, or with an empty corpus, scores rest on what is left: the
    uniform prior allows. Other columns are not read.
    """
    host, path = split_url(F.col(f"`{url_col}`"))
    rows = urls.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)],
                       host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_m", match_rules(F.col("host"), F.col("path"), rules))
    rows = with_tokens(rows, materialize(unigrams(corpus), "url-unigrams"))
    rows = materialize(rows.select("*", F.col("_m.rule").alias("rule"), F.col("_m.verdict").alias("verdict"),
                                   F.transform("tokens", lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))
                                   .alias("buckets")).drop("_m"), "url-tokens")
    prior, odds = train(rows, buckets)

    @F.pandas_udf("double")
    def score(bs: pd.Series) -> pd.Series:
        return pd.Series([prior + float(odds[b].sum()) if len(b) else prior for b in bs], dtype="float64")

    out = rows.withColumn("score", score("buckets"))
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], "host", "path", "rule",
                      F.coalesce("verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"),
                      "tokens", "score")
