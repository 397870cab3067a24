"""Quality rules with adaptive thresholds.

Every text gets a few counts and from them metrics. The distribution of each
metric is sketched per language and source, and thresholds come from the
sketches' quartiles and tails instead of fixed cutoffs; then the thresholds are
joined to the documents and decide. Only documents that pass the base rules are
sketched: a group full of junk does not raise its own thresholds.

A value is an outlier if it lies beyond the quartile by REACH quartile distances
and beyond the outer twentieth of its group too. Most metrics are zero for most
documents, so there the twentieth decides; it also bounds what one metric can
reject by a twentieth of a group.

The sketch is a histogram over logarithmic buckets (relative error ``ALPHA``):
counts per bucket, so merging is addition, which the shuffle's partial
aggregation does. A group's quantiles are read from its own buckets plus
``PRIOR`` documents' worth of its language's buckets, so a small source leans
on its language without a size switch. All weights are integers, so results do
not depend on the order of the sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import numbered
from tidepool.session import materialize

ALPHA = 0.01
GAMMA = (1 + ALPHA) / (1 - ALPHA)
PRIOR = 10
REACH = 3           # quartile distances
TAIL = 20           # the outer 1 / TAIL of the documents
GUARD = 0.01        # width that a threshold has beyond its quantiles, for rounded and zero ones
# metric: (numerator, lower side too)
METRICS = {
    "word_length": ("word_chars", True),
    "symbols": ("n_symbols", False),
    "dup_lines": ("n_dup_lines", False),
    "repeats": ("n_repeat_words", False),
    "capitals": ("n_upper", False),
}
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper"]
WINDOW = 8


def text_counts(text: str | None) -> tuple[int, ...]:
    """FEATURES of one text; all zero for a null or empty one."""
    if not text:
        return (0,) * len(FEATURES)
    ws = text.encode("utf-8", "surrogatepass").split()
    space = sum(map(text.count, " \t\n\v\f\r"))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            dup += line in seen
            seen.add(line)
    upper = sum(map(str.isupper, text))
    return len(ws), len(text) - space, sum(map(text.count, "#*$%&|<>")), dup, repeated_words(ws), upper


def repeated_words(ws: list) -> int:
    """Words covered by WINDOW-word windows that occur at least twice in the
    text. Windows are named exactly: pairs, then pairs of pairs, get numbers."""
    n = len(ws) - WINDOW + 1
    if n < 2:
        return 0
    names: dict = {}
    ids = np.array([names.setdefault(w, len(names)) for w in ws], np.int64)
    if len(names) > len(ws) - WINDOW:       # a repeated window repeats at least WINDOW words
        return 0
    size = 1
    while size < WINDOW:
        ids = np.unique(ids[:-size] * (len(ws) + 1) + ids[size:], return_inverse=True)[1]
        size *= 2
    twice = np.flatnonzero(np.bincount(ids)[ids] > 1)
    cover = np.zeros(len(ws) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with FEATURES in place of its text."""
    @F.pandas_udf(", ".join(f"{c} long" for c in FEATURES))
    def counts(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_counts(t) for t in text], columns=FEATURES, dtype="int64")

    return docs.withColumn("_counts", counts(F.col(text_col))).select("*", "_counts.*").drop("_counts", text_col)


def _bucket(x: Column) -> Column:
    """Bucket of a value; zero has a bucket below all others."""
    return F.when(x <= 0, -100000).otherwise(F.ceil(F.ln(x) / F.lit(float(np.log(GAMMA)))).cast("int"))


def _value(bucket: Column) -> Column:
    return F.when(bucket == -100000, 0.0).otherwise(F.lit(2.0) * F.pow(F.lit(GAMMA), bucket) / F.lit(GAMMA + 1))


def _base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): the sketch of every group."""
    cols = [F.struct(F.lit(m).alias("metric"), _bucket(F.col(num) / F.col("n_words")).alias("bucket"))
            for m, (num, _) in METRICS.items()]
    return (counts.filter(~_base_failed()).select("lang", "source", F.explode(F.array(*cols)).alias("m"))
            .groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count("*").alias("n")))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source) with ``<metric>_lo`` and ``<metric>_hi``, from the merged
    sketch of the group and its language."""
    big = lambda c: c.cast("decimal(38,0)")
    lang = sketch.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("ln"))
    group = sketch.groupBy("lang", "source", "metric").agg(F.sum("n").alias("gt"))
    total = lang.groupBy("lang", "metric").agg(F.sum("ln").alias("lt"))
    grid = (group.join(lang, F.expr("1=1") & group.lang.eqNullSafe(lang.lang) & (group.metric == lang.metric))
            .select(group.lang, "source", group.metric, "gt", "bucket", "ln"))
    s = sketch.withColumnRenamed("n", "gn")
    grid = (grid.alias("g").join(s.alias("s"), F.expr(
        "g.lang <=> s.lang and g.source <=> s.source and g.metric = s.metric and g.bucket = s.bucket"), "left")
        .join(total.alias("t"), F.expr("g.lang <=> t.lang and g.metric = t.metric"))
        .select("g.lang", "g.source", "g.metric", "g.bucket", "gt", "lt",
                (big(F.coalesce("gn", F.lit(0))) * big(F.col("lt")) + big(F.col("ln")) * PRIOR).cast("decimal(38,0)").alias("w")))
    cum = F.sum("w").over(Window.partitionBy("lang", "source", "metric").orderBy("bucket")
                          .rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(38,0)")
    whole = big(F.col("lt")) * big(F.col("gt") + PRIOR)
    grid = grid.withColumn("cum", cum).withColumn("whole", whole.cast("decimal(38,0)"))
    quantile = lambda num, den: _value(F.min(F.when(F.col("cum") * den >= F.col("whole") * num, F.col("bucket"))))
    q = grid.groupBy("lang", "source", "metric").agg(
        quantile(1, TAIL).alias("low"), quantile(1, 4).alias("q1"), quantile(3, 4).alias("q3"),
        quantile(TAIL - 1, TAIL).alias("high"))
    reach = (F.col("q3") - F.col("q1")) * REACH
    out = []
    for m, (_, both) in METRICS.items():
        here = F.col("metric") == m
        out.append(F.max(F.when(here, F.greatest(F.col("q3") + reach, F.col("high")) + GUARD)).alias(f"{m}_hi"))
        if both:
            out.append(F.max(F.when(here, F.least(F.col("q1") - reach, F.col("low")) - GUARD)).alias(f"{m}_lo"))
    return q.groupBy("lang", "source").agg(*out)


def judge(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` (with lang and source) without its text, with FEATURES,
    base_failed and kept.

    Null and empty texts have zero counts and fail the base rules. Null lang or
    source is a group like any other. Repeated rows are counted and judged one
    by one. Other columns pass through, but columns named like a result are
    replaced.
    """
    docs, names = numbered(docs, (*FEATURES, "base_failed", "kept"))
    group = {names["lang"]: "lang", names["source"]: "source"}
    counts = materialize(with_counts(docs, names[text_col]), "quality-counts")
    limit = thresholds(sketches(counts.withColumnsRenamed(group)))
    failed = _base_failed()
    ok = F.lit(True)
    for m, (num, both) in METRICS.items():
        x = F.col(num) / F.nullif(F.col("n_words"), F.lit(0))
        ok = ok & (x <= F.col(f"{m}_hi"))
        if both:
            ok = ok & (x >= F.col(f"{m}_lo"))
    out = counts.join(limit, F.expr(f"{names['lang']} <=> lang and {names['source']} <=> source"), "left")
    return out.select(*[F.col(n).alias(c) for c, n in names.items() if c != text_col], *FEATURES,
                      failed.alias("base_failed"), (~failed & F.coalesce(ok, F.lit(False))).alias("kept"))
