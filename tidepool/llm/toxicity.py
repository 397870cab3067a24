"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding: compatibility forms and case are normalised, look-alike letters of
other scripts become Latin ones, and digits or signs that stand for letters
become those letters. The lexicon holds word beginnings with weights (log odds
of toxic against clean documents), learned from labelled documents; phrases in
which a term stays harmless are exceptions, learned or given. A score sums the
best weight of every word that begins with a term, outside exception phrases,
sets it against the length, and passes it through a logistic curve fitted on
labelled documents that the lexicon has not seen.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import by_bytes, hash_sample

# Look-alikes and letter substitutions: fixed values.
HOMOGLYPHS = dict(zip("асеорхуіјѕһԁԛԝαβεικνορτυχ", "aceopxyijshdqwabeiknoptux"))
DIGITS = dict(zip("0134579@$!", "oieastgasi"))
FOLD = str.maketrans(HOMOGLYPHS | DIGITS)
SHORTEST, LONGEST = 3, 10     # letters of a term


def fold(text: str | None) -> list[str]:
    """Folded words of a text."""
    low = unicodedata.normalize("NFKC", text or "").lower()
    return ["".join(c for c in w if c.isalpha()) if not w.isalpha() else w
            for w in low.translate(FOLD).split()]


@dataclass
class Lexicon:
    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            a.add_word(" " + t, (len(t) + 1, w))
        for p in self.exceptions:
            a.add_word(f" {p} ", (len(p) + 2, None))
        a.make_automaton()
        return a


def matches(ws: list[str], automaton) -> dict[int, float]:
    """Best weight by the start of each word that begins with a term, without
    those inside an exception phrase."""
    if not ws or not len(automaton):
        return {}
    text = f" {' '.join(ws)} "
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(text):
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        else:
            best[start] = max(weight, best.get(start, weight))
    for lo, hi in spared:
        for at in [s for s in best if lo <= s < hi]:
            del best[at]
    return best


def signals(ws: list[str], automaton) -> tuple[float, float, float]:
    """Total weight, weight against the length of the text, matched words."""
    found = matches(ws, automaton)
    total = sum(found.values())
    return total / 10, total / math.sqrt(len(ws) + 25), math.log1p(len(found))


def _terms(ws: list[str]) -> set[str]:
    return {w[:k] for w in set(ws) for k in range(SHORTEST, min(len(w), LONGEST) + 1)}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in by_bytes(batches, "text", 4 << 20):
        n = (Counter(), Counter())
        for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist()):
            n[label].update(_terms(fold(text)))
        names = list(n[0].keys() | n[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *[pa.array([c[t] for t in names], pa.int64()) for c in n]],
            names=["term", "clean", "toxic"])


def choose(labels: DataFrame, *, rows: int = 12_000, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """The labels that ``learn`` would use, chosen from the narrow table of
    labels alone: about ``rows`` of each label, so they may be broadcast and the
    texts of the others need not be read. Null ids match no document; labels
    that repeat an id count as often as they are there."""
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit("toxicity"))
    some = [hash_sample(labels.filter(F.col(label_col).cast("int") == label), rows, h) for label in (0, 1)]
    return some[0].unionAll(some[1])


def learn(labelled: DataFrame, *, rows: int = 12_000, max_terms: int = 2_000, evidence: float = 18.0,
          exceptions: list[str] = (), id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Lexicon:
    """Lexicon and curve from labelled rows (label 0 or 1; others are left out).

    About ``rows`` rows of each label are used (all, if there are fewer),
    chosen by a hash of the id. Two thirds of them make the lexicon, the rest fits the
    curve. A term needs a log likelihood ratio of ``evidence`` and must be three
    times as frequent in toxic documents; at most ``max_terms`` are kept. With no
    label, or one class only, every score is 0.
    """
    pool = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"),
                           F.xxhash64(F.col(id_col).cast("string"), F.lit("toxicity")).alias("h"))
    sample = None
    for label in (0, 1):
        some = hash_sample(pool.filter(F.col("label") == label), rows, F.col("h"))
        sample = some if sample is None else sample.unionAll(some)
    sample = sample.repartition(16, "h").persist()
    part = F.pmod("h", F.lit(3))
    first, second = sample.filter(part != 0), sample.filter(part == 0)
    sizes = {r["label"]: r["n"] for r in first.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Lexicon({})
    counts = first.select("text", "label").mapInArrow(_count_terms, "term string, clean long, toxic long")
    counts = counts.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = lambda k, n: (F.col(k) + 0.5) / (n + 1.0)
    odds = F.ln(share("toxic", n1) / share("clean", n0))
    all_ = F.col("toxic") + F.col("clean")
    x = lambda k, p: F.when(F.col(k) > 0, F.col(k) * F.ln(F.col(k) / (all_ * p))).otherwise(0.0)
    ratio = 2 * (x("toxic", n1 / (n0 + n1)) + x("clean", n0 / (n0 + n1)))
    rows_ = (counts.withColumn("weight", odds).withColumn("g", ratio)
             .filter((F.col("g") >= evidence) & (F.col("toxic") * n0 >= 3 * F.col("clean") * n1) & (F.col("weight") > 0))
             .orderBy(F.desc("g"), "term").limit(max_terms).collect())
    lex = Lexicon({r["term"]: float(r["weight"]) for r in rows_}, list(exceptions))
    lex.exceptions += _harmless(first, lex)
    lex.curve = _curve(second, lex)
    sample.unpersist()
    return lex


def _harmless(sample: DataFrame, lex: Lexicon, least: int = 3, most: int = 500) -> list[str]:
    """Two-word phrases with a term, found in ``least`` or more clean documents
    and ten times as often there as in toxic ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Lexicon(lex.terms).automaton()
        for part in by_bytes(batches, "text"):
            n: Counter = Counter()
            for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist()):
                ws = fold(text)
                starts, at = {}, 0
                for i, w in enumerate(ws):
                    starts[at] = i
                    at += len(w) + 1
                hit = [starts[s] for s in matches(ws, a) if s in starts]
                n.update({(" ".join(ws[i + d:i + d + 2]), label) for i in hit for d in (-1, 0)
                          if 0 <= i + d and i + d + 2 <= len(ws)})
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in n], pa.string()), pa.array([b for _, b in n], pa.int32()),
                                              pa.array(list(n.values()), pa.int64())], names=["phrase", "label", "n"])

    found = sample.select("text", "label").mapInArrow(run, "phrase string, label int, n long")
    found = found.groupBy("phrase").agg(F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("c"),
                                        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("t"))
    return [r["phrase"] for r in found.filter((F.col("c") >= least) & (F.col("c") >= 10 * F.col("t")))
            .orderBy(F.desc("c"), "phrase").limit(most).collect()]


def _curve(sample: DataFrame, lex: Lexicon) -> tuple[float, ...]:
    """Logistic curve over the three signals, by Newton steps with a small ridge."""
    @F.pandas_udf("a double, b double, c double")
    def three(text: pd.Series) -> pd.DataFrame:
        automaton = lex.automaton()
        return pd.DataFrame([signals(fold(t), automaton) for t in text], columns=["a", "b", "c"])

    rows = sample.select(three("text").alias("s"), "label").select("s.*", "label").toPandas()
    if rows["label"].nunique() < 2:
        return (-4.0, 1.0, 1.0, 0.0)
    x = np.column_stack([np.ones(len(rows)), rows[["a", "b", "c"]].to_numpy()])
    y, beta, ridge = rows["label"].to_numpy(), np.zeros(4), np.diag([0.01, 0.1, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def score(docs: DataFrame, lex: Lexicon, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out`` (double, 0 to 1). Null and empty texts are scored
    as texts without a match. A column of the same name is replaced."""
    @F.pandas_udf("double")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton, (base, *slopes) = lex.automaton(), lex.curve
        for text in parts:
            z = [base + sum(k * x for k, x in zip(slopes, signals(fold(t), automaton))) for t in text]
            yield pd.Series([1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) if lex.terms else 0.0 for v in z],
                            dtype="float64")

    return docs.withColumn(out, udf(F.col(f"`{text_col}`")))
