"""Substring dedup by level-wise doubling.

A word is removed if a window of ``min_words`` consecutive words covers it and
the same window also starts in a document with a smaller id. The search climbs
levels of doubled length (k = 200: 7, 13, 25, 50, 100, 200 words): only windows
that are repeated across documents at one length are extended to the next, and it
ends at k or when no candidate is left. Levels find candidates by a hash of 64
bits; a word is removed only where a second hash of 32 bits, of other word hashes, is equal too.

The first level need not test every position. Each k-window is represented by
one of its short windows, the one with the smallest hash (its minimizer), which
depends on the words of the k-window alone; so two equal k-windows have equal
representatives, and a k-window whose representative is not repeated cannot be
repeated itself. On later levels the representative is the longer window that
starts at the minimizer, or ends with it where that would leave the k-window.

Equal windows inside one slice of documents are resolved before the shuffle:
only the occurrences in the smallest document (and, below level k, in one other
document) go to the hash of the window; the others are decided already and
travel under a spread key. So a passage that a third of all documents share
sends a few rows per slice to its task, and the task reads them as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import by_bytes, mix, numbered, order_id, window_hashes
from tidepool.session import materialize

# A window's row: its hash, its document, and packed the start (31 bits), whether
# it is decided already, and a number that tells the texts of one id apart (31
# bits). Narrow rows, because the first level writes one for every few words. On
# the last level the second hash is added.
ROWS = "h long, _id long, at long"
SHORTEST = 8


def levels(min_words: int) -> list[int]:
    """Lengths of the levels: halves of ``min_words``, rounded up, down to
    SHORTEST words or less. Shorter windows are repeated in nearly every document
    (of 51,282, 96 % have a repeated pair of words, 81 % four in a row, 58 % seven)."""
    out = [min_words]
    while out[0] > SHORTEST or (len(out) == 1 and min_words > 1):
        out.insert(0, (out[0] + 1) // 2)
    return out


def hashed(words: list[bytes], digest) -> np.ndarray:
    """64-bit hash of each word."""
    return np.frombuffer(b"".join(map(digest, words)), ">u8").astype(np.uint64)


def minimizers(h: np.ndarray, w: int) -> np.ndarray:
    """Leftmost position of the smallest of each w consecutive entries."""
    n = len(h) - w + 1
    best, at = h[:n].copy(), np.arange(n)
    for j in range(1, w):
        less = h[j:j + n] < best
        best[less] = h[j:j + n][less]
        at[less] = np.flatnonzero(less) + j
    return at


def _chosen(at: np.ndarray, k: int, ladder: list[int], level: int) -> np.ndarray:
    """For each k-window, the start of its representative on a level; ``at`` are
    the places of the minimizers."""
    i = np.arange(len(at))
    return np.where(at + ladder[level] <= i + k, at, np.maximum(i, at + ladder[0] - ladder[level]))


def _windows(texts, survivors, k: int, ladder: list[int], level: int, bits: int):
    """(document number, starts, hashes, second hashes on the last level) of the
    level's candidate windows."""
    from xxhash import xxh3_64_digest, xxh64_digest

    last = level == len(ladder) - 1
    for d, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if len(words) < k:
            continue
        h = hashed(words, xxh64_digest)
        at = minimizers(window_hashes(h, ladder[0]), k - ladder[0] + 1)
        start = _chosen(at, k, ladder, level)
        if level:
            start = start[np.isin(_chosen(at, k, ladder, level - 1), np.asarray(survivors[d], np.int64))]
        start = np.unique(start)
        if not len(start):
            continue
        got = window_hashes(h, ladder[level])[start] & np.uint64((1 << bits) - 1)
        second = None       # 32 bits: with the first hash 96
        if last:
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + k, -1)
            used = np.flatnonzero(np.cumsum(cover)[:-1])
            v = np.zeros(len(words), np.uint64)
            v[used] = hashed([words[i] for i in used], xxh3_64_digest)
            second = window_hashes(v, k)[start] >> np.uint64(32)
        yield d, start, got, second


def _resolve(doc: np.ndarray, ids: np.ndarray, nth: np.ndarray, start: np.ndarray, h: np.ndarray, v: np.ndarray | None):
    """Decide what this slice knows. Rows to send under their hash, and rows
    known to be repeated (below the last level) or to be removed (on it, where
    there are second hashes ``v``)."""
    last = v is not None
    o = np.lexsort((ids[doc], v, h) if last else (ids[doc], h))
    doc, start, h = doc[o], start[o], h[o]
    rid = ids[doc]
    first = np.r_[True, h[1:] != h[:-1]]
    if last:
        first[1:] |= v[o][1:] != v[o][:-1]
    group = np.cumsum(first) - 1
    smallest = rid == rid[first][group]
    if last:
        known = ~smallest
    else:
        other = np.zeros(len(h), bool)          # the first row beyond the smallest id of each group
        beyond = np.flatnonzero(~smallest)
        other[beyond[np.unique(group[beyond], return_index=True)[1]]] = True
        several = np.bincount(group[other], minlength=group[-1] + 1 if len(group) else 0)[group] > 0
        # of a group seen in several documents two rows are sent; all its rows are candidates
        sent = np.zeros(len(h), bool)
        sent[np.flatnonzero(first)] = True
        known = several & ~(sent | other)
    at = start.astype(np.int64) | nth[doc].astype(np.int64) << 32
    spread = mix(mix(rid.view(np.uint64), at.view(np.uint64)), h)
    back = np.empty_like(o)                 # in the documents' order: neighbours share an id, so less is shuffled
    back[o] = np.arange(len(o))
    out = [pa.array(np.where(known, spread, h)[back].view(np.int64)), pa.array(rid[back]),
           pa.array((at | known.astype(np.int64) << 31)[back])]
    if last:
        v = np.where(known[back], np.uint64(0), v)      # decided rows are not compared any more
        return pa.RecordBatch.from_arrays([*out, pa.array(v.view(np.int64))], names=["h", "_id", "at", "v"])
    return pa.RecordBatch.from_arrays(out, names=["h", "_id", "at"])


def _scan(k: int, ladder: list[int], level: int, bits: int, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, text):
            ids = part.column("_id").to_numpy()
            nth = part.column("_nth").to_numpy()
            survivors = part.column("_s").to_pylist() if level else None
            found = list(_windows(part.column(text).to_pylist(), survivors, k, ladder, level, bits))
            if found:
                doc, start, h, v = zip(*found)
                yield _resolve(np.concatenate([np.full(len(s), d) for d, s in zip(doc, start)]), ids, nth,
                               np.concatenate(start), np.concatenate(h),
                               np.concatenate(v) if level == len(ladder) - 1 else None)
    return run


def _repeated(rows: DataFrame, last: bool) -> DataFrame:
    """Windows that occur in another document too; on the last level those
    that start in a document with a smaller id."""
    w = Window.partitionBy("h", "v").orderBy("_id") if last else Window.partitionBy("h").orderBy("_id")
    known = F.getbit("at", F.lit(31)) == 1
    if last:
        rows = rows.withColumn("_f", F.first("_id").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return rows.filter(known | (F.col("_id") > F.col("_f")))
    return rows.withColumn("_n", F.lead("h").over(w)).withColumn("_l", F.lag("h").over(w)).filter(
        known | F.col("_n").isNotNull() | F.col("_l").isNotNull())


def _told_apart(base: DataFrame, text: Column) -> DataFrame:
    """``base`` with _nth (int): 0 where the id has one row, else a number from
    1 that each different text of the id has for itself. It follows from the
    rows alone, so ``base`` may be read again and again."""
    several = materialize(base.groupBy("_id").agg(F.count("*").alias("n")).filter("n > 1").select("_id"), "substring-ids")
    if several.isEmpty():
        return base.withColumn("_nth", F.lit(0))
    base = base.withColumn("_sha", F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)))
    rows = materialize(base.select("_id", "_sha").join(several, "_id", "left_semi")
                       .withColumn("_n", F.monotonically_increasing_id()), "substring-rows")
    part, offsets, total = F.shiftright("_n", 33), [], 1
    for p, n in sorted(map(tuple, rows.groupBy(part).agg(F.count("*")).collect())):     # one row for each partition
        offsets.append((p, total))
        total += n
    if total > 1 << 31:
        raise ValueError(f"{total - 1} rows share their ids with others; more than 31 bits can number")
    offsets = rows.sparkSession.createDataFrame(offsets, "_p long, _o long")
    number = F.col("_o") + F.col("_n").bitwiseAND((1 << 33) - 1)
    keys = rows.join(F.broadcast(offsets), part == F.col("_p")).groupBy("_id", "_sha").agg(
        F.min(number).cast("int").alias("_nth"))
    return base.join(materialize(keys, "substring-keys"), ["_id", "_sha"], "left").drop("_sha").withColumn(
        "_nth", F.coalesce("_nth", F.lit(0)))


def remove_repeats(docs: DataFrame, *, min_words: int = 13, id_col: str = "doc_id",
                   text_col: str = "text", bits: int = 64) -> DataFrame:
    """``docs`` with its text cut, and n_words, n_removed (long).

    Windows are judged on the input texts. A removed word goes with the white
    space after it; a text that loses nothing is left as it is, and texts
    shorter than ``min_words`` (null and empty ones too) never lose a word. A
    null text stays null. Rows with a null id count as the largest id. Rows
    that repeat an id are judged separately, each text by itself, and none of
    them is the smaller document of the other. Other columns pass
    through; n_words and n_removed replace columns of the same name. If all of
    them are read, one shuffle of ``docs`` serves the last level and the cut; a
    column that is not read costs a second one. The first hash has ``bits`` bits; fewer make more candidates, never another result.
    """
    ladder = levels(min_words)
    docs, names = numbered(docs, ("n_words", "n_removed"))
    text = F.col(names[text_col])
    base = _told_apart(docs.withColumn("_id", order_id(F.col(names[id_col]))), text)
    found = None
    for level in range(len(ladder)):
        last = level == len(ladder) - 1
        at = base.select("_id", "_nth", text)
        if level:
            # on the last level with every column: the texts are shuffled once for it and for the cut below
            at = (base if last else at).join(found, ["_id", "_nth"])
        rows = at.mapInArrow(_scan(min_words, ladder, level, bits, names[text_col]), ROWS + ", v long" * last)
        found = _repeated(rows, last).groupBy(
            "_id", F.shiftright("at", 32).cast("int").alias("_nth")).agg(
            F.collect_set(F.col("at").bitwiseAND(0x7FFFFFFF).cast("int")).alias("_s"))
        if not last:
            found = materialize(found, "substring-level")
            if found.isEmpty():
                break

    @F.pandas_udf("text string, n_words long, n_removed long")
    def cut(text: pd.Series, starts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_cut(t, s, min_words) for t, s in zip(text, starts)],
                            columns=["text", "n_words", "n_removed"])

    out = base.join(found, ["_id", "_nth"], "left").withColumn("_c", cut(text, F.col("_s")))
    return out.select(*[F.col("_c.text" if c == text_col else n).alias(c) for c, n in names.items()],
                      "_c.n_words", "_c.n_removed")


def _cut(text: str | None, starts, k: int) -> tuple[str | None, int, int]:
    import re

    if text is None:
        return None, 0, 0
    if starts is None or not len(starts):
        return text, len(text.encode("utf-8", "surrogatepass").split()), 0
    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    gone = np.zeros(len(spans) + 1, np.int64)
    at = np.asarray(starts, np.int64)
    np.add.at(gone, at, 1)
    np.add.at(gone, np.minimum(at + k, len(spans)), -1)
    gone = np.cumsum(gone)[:-1] > 0
    cuts = np.flatnonzero(np.diff(np.r_[False, gone, False]))
    out, last = [], 0
    for lo, hi in cuts.reshape(-1, 2):       # words lo .. hi - 1, with the white space up to the next word
        out.append(text[last:spans[lo][0]])
        last = spans[hi][0] if hi < len(spans) else len(text)
    return "".join(out) + text[last:], len(spans), int(gone.sum())
