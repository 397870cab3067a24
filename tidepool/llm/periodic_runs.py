"""Periodic runs of words, found on a grammar.

A run is a maximal stretch of words with smallest period q that is at least
``min_periods`` periods and ``min_length`` words long ("a b a b a b a b").

The words of a slice of documents are numbered and compressed by Re-Pair: the
most frequent pair of neighbours becomes a nonterminal, again and again, until
no pair repeats. (A round replaces all pairs at once that are the more frequent
one of each two that overlap.) What is left of a document is halved into a
balanced tree, so that every word of a document hangs in one binary derivation.
The words of a run have a lowest common ancestor, whose boundary (between its
two children) the run crosses; so it is enough to look at the runs that cross
each nonterminal's boundary, once for each nonterminal however often it is
derived. One side of the boundary holds two whole periods: the candidates are
the distances to equal words there, kept if a hash says that the two periods
are equal, extended by binary search on hashes to the whole run inside the
nonterminal, and compared word by word. Then the runs are translated to all
positions where their nonterminal is derived, and intervals of one period that
overlap by a period are merged into the maximal ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import by_bytes, numbered

SLICE = 2 << 20         # bytes of text that share a grammar
CHUNK = 1 << 20         # candidates looked at together
PRIME = (1 << 31) - 1

RUNS = "array<struct<start:long,length:long,period:long>>"


def collapse_runs(docs: DataFrame, *, min_length: int = 6, min_periods: int = 4, text_col: str = "text",
                  order: Callable[[object, int], np.ndarray] | None = None, order_col: str | None = None) -> DataFrame:
    """``docs`` with n_words (long), runs (array of start, length, period, by
    start, then period; words numbered from 0) and collapsed (string): its words
    joined by one space, without those that some run contains after that run's
    first period.

    ``order(value of order_col, n)`` may give the indices of the n words that
    are read instead of 0 .. n - 1 (as many as it returns). Null and empty texts
    and those of white space have no words, no runs and an empty collapsed text.
    Ids play no part: null ids, ties and repeated rows are judged row by row.
    Other columns pass through; n_words, runs and collapsed replace columns of
    those names. A task holds some 200 bytes for each word of its largest text.
    """
    if min_periods < 4:
        raise ValueError("min_periods must be 4 or more: a boundary must leave two periods on one side")
    src, names = numbered(docs, ("n_words", "runs", "collapsed"))
    text = names[text_col]
    keep = list(names.values())
    schema = "".join(f"{n} {src.schema[n].dataType.simpleString()}, " for n in keep)
    task = _task(text, keep, names[order_col] if order_col else None, order, min_length, min_periods)
    out = src.mapInArrow(task, f"{schema}n_words long, runs {RUNS}, collapsed string")
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], "n_words", "runs", "collapsed")


# --- inside tasks -------------------------------------------------------------

def _task(text: str, keep: list[str], order_col: str | None, order, min_length: int, min_periods: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, text, SLICE):
            data = [(t or "").encode("utf-8", "surrogatepass").split() for t in part.column(text).to_pylist()]
            sizes = np.array([len(d) for d in data], np.int64)
            words = [w for d in data for w in d]
            ids = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
            if order is not None:
                keys = part.column(order_col).to_pylist() if order_col else [None] * len(data)
                cuts = np.r_[0, np.cumsum(sizes)]
                read = [lo + np.asarray(order(k, n), np.int64) for k, lo, n in zip(keys, cuts[:-1], sizes.tolist())]
                sizes = np.array([len(r) for r in read], np.int64)
                at = np.concatenate(read)
                ids, words = ids[at], [words[i] for i in at.tolist()]
            start, length, period = find_runs(ids, sizes, min_length, min_periods)
            cuts = np.r_[0, np.cumsum(sizes)]
            doc = np.searchsorted(cuts, start, "right") - 1
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, start + period, 1)
            np.add.at(gone, start + length, -1)
            gone = np.cumsum(gone)[:-1] > 0
            per = np.bincount(doc, minlength=len(data))
            lists = pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(per)].astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(start - cuts[doc]), pa.array(length), pa.array(period)],
                                           fields=list(kind.value_type)))
            texts = []
            for d, (lo, hi) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
                kept = words[lo:hi] if not per[d] else [words[i] for i in (lo + np.flatnonzero(~gone[lo:hi])).tolist()]
                texts.append(b" ".join(kept))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), pa.array(sizes), lists, pa.array(texts, pa.binary()).cast(pa.string())],
                names=[*keep, "n_words", "runs", "collapsed"])
    return run


class Grammar:
    """Rules of a slice by Re-Pair: symbol ``first + r`` derives left[r] right[r].
    sequence, document: what is left of the documents."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        n = len(ids)
        self.first = int(ids.max()) + 1 if n else 0
        document = np.repeat(np.arange(len(sizes)), sizes)
        # symbols stay at the position of their first word; n stands for "none"
        symbol = np.r_[ids, -1]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        edge = np.flatnonzero(np.r_[document[1:] != document[:-1], True]) if n else np.empty(0, np.int64)
        after[edge], before[np.r_[0, edge + 1]] = n, n
        weight = np.zeros(n + 1, np.int64)
        left, right, made = [], [], 0
        self.rounds: list[tuple[int, int]] = []
        at = np.flatnonzero(after[:n] < n)                  # pairs that may repeat, by their first symbol
        while len(at):
            kind, _ = pd.factorize(symbol[at] * (self.first + made) + symbol[after[at]])
            count = np.bincount(kind)
            many = count[kind] > 1                          # a pair that occurs once goes on to do so
            at, kind = at[many], kind[many]
            # the more frequent one of overlapping pairs wins (ties: the kind met first)
            own = count[kind] * (len(count) + 1) + (len(count) - kind)
            weight[at] = own
            win = (own >= weight[before[at]]) & (own >= weight[after[at]])
            weight[at] = 0
            p, k = at[win], kind[win]
            if not len(p):
                break
            # of a stretch of equal overlapping pairs (a a a a) every other one
            head = np.r_[True, after[p[:-1]] != p[1:]]
            where = np.arange(len(p))
            odd = (where - np.maximum.accumulate(np.where(head, where, 0))) % 2 == 1
            p, k = p[~odd], k[~odd]
            used = np.bincount(k, minlength=len(count))
            twice = used > 1
            p, k = p[twice[k]], k[twice[k]]
            if not len(p):
                break
            number = np.cumsum(twice) - 1
            new = int(number[-1]) + 1
            gone, beyond = after[p], after[after[p]]
            pair = np.empty((2, new), np.int64)
            pair[0, number[k]], pair[1, number[k]] = symbol[p], symbol[gone]
            left.append(pair[0])
            right.append(pair[1])
            symbol[p] = self.first + made + number[k]
            symbol[gone] = -1
            after[p] = beyond
            before[beyond] = p
            before[n] = n
            self.rounds.append((made, made + new))
            made += new
            at = np.unique(np.concatenate([at[symbol[at] >= 0], p, before[p]]))
            at = at[after[at] < n]
        self.left = np.concatenate(left) if left else np.empty(0, np.int64)
        self.right = np.concatenate(right) if right else np.empty(0, np.int64)
        rest = np.flatnonzero(symbol[:n] >= 0)
        self.sequence, self.document = symbol[rest], document[rest]
        self.length = np.ones(self.first + len(self.left), np.int64)
        for lo, hi in self.rounds:
            self.length[self.first + lo:self.first + hi] = self.length[self.left[lo:hi]] + self.length[self.right[lo:hi]]
        self.starts = np.r_[0, np.cumsum(self.length[self.sequence])][:-1] if len(self.sequence) else np.empty(0, np.int64)

    def one_place(self) -> np.ndarray:
        """A position where each rule is derived."""
        place = np.zeros(len(self.length), np.int64)
        place[self.sequence] = self.starts
        for lo, hi in reversed(self.rounds):
            own = place[self.first + lo:self.first + hi]
            place[self.left[lo:hi]] = own
            place[self.right[lo:hi]] = own + self.length[self.left[lo:hi]]
        return place[self.first:]

    def all_places(self, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rule, position) for every derivation of the given rules."""
        wanted = np.zeros(len(self.length), bool)
        wanted[self.first + rules] = True
        inside = wanted.copy()                  # a wanted rule at or below the symbol
        for lo, hi in self.rounds:
            inside[self.first + lo:self.first + hi] |= inside[self.left[lo:hi]] | inside[self.right[lo:hi]]
        out_r, out_p = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        go = inside[self.sequence]
        symbol, at = self.sequence[go], self.starts[go]
        while len(symbol):
            hit = wanted[symbol]
            out_r.append(symbol[hit] - self.first)
            out_p.append(at[hit])
            r = symbol - self.first
            symbol, at = np.r_[self.left[r], self.right[r]], np.r_[at, at + self.length[self.left[r]]]
            go = inside[symbol]
            symbol, at = symbol[go], at[go]
        return np.concatenate(out_r), np.concatenate(out_p)

    def halves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, boundary, end) of the nodes of the balanced trees over the documents' sequences."""
        start, end, doc = self.starts, self.starts + self.length[self.sequence], self.document
        out = [np.empty((3, 0), np.int64)]
        while len(start):
            n = np.arange(len(start))
            head = np.r_[True, doc[1:] != doc[:-1]]
            nth = n - np.maximum.accumulate(np.where(head, n, 0))
            a = np.flatnonzero((nth[:-1] % 2 == 0) & ~head[1:])
            if not len(a):
                break
            out.append(np.stack([start[a], start[a + 1], end[a + 1]]))
            stay = np.ones(len(start), bool)
            stay[a + 1] = False
            end = end.copy()
            end[a] = end[a + 1]
            start, end, doc = start[stay], end[stay], doc[stay]
        return tuple(np.concatenate(out, axis=1))


class Stretches:
    """Equality of stretches of words by two hashes."""

    def __init__(self, ids: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        n = len(ids)
        value = rng.integers(1, 1 << 62, int(ids.max()) + 1, np.uint64)[ids]
        base = np.uint64(int(rng.integers(1 << 61, 1 << 62)) | 1)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.r_[np.uint64(1), np.full(n, base)])
            self.wide = np.r_[np.uint64(0), np.cumsum(value * self.power[:-1])]
        self.small_power = np.ones(1, np.int64)
        step = int(rng.integers(1 << 20, PRIME))
        while len(self.small_power) <= n:
            self.small_power = np.r_[self.small_power, self.small_power * step % PRIME]
            step = step * step % PRIME
        self.small = np.r_[0, np.cumsum((value % np.uint64(PRIME)).astype(np.int64) * self.small_power[:n] % PRIME)]

    def equal(self, a: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words from a on and from a + q on are equal."""
        b = a + q
        with np.errstate(over="ignore"):
            same = (self.wide[a + size] - self.wide[a]) * self.power[q] == self.wide[b + size] - self.wide[b]
        i = np.flatnonzero(same)
        if len(i):
            a, b, q, size = a[i], b[i], q[i], size[i]
            same[i] = ((self.small[a + size] - self.small[a]) % PRIME * self.small_power[q] % PRIME
                       == (self.small[b + size] - self.small[b]) % PRIME)
        return same

    def forward(self, a: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from a + q on, ``most`` at most."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            ok = self.equal(a, q, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low

    def backward(self, a: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before a equal those before a + q, ``most`` at most."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            ok = self.equal(a - mid, q, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low


def crossing_runs(ids: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray, min_length: int,
                  min_periods: int, seed: int = 0) -> np.ndarray | None:
    """Rows (node, start, end, period): the runs of each node [start, end) that
    have two periods on one side of its boundary ``mid``. None if a hash has
    misled (the words disagree): to be repeated with another seed."""
    nodes = np.flatnonzero(end - start >= max(min_length, min_periods))
    out = [np.empty((4, 0), np.int64)]
    if len(nodes):
        n = len(ids)
        place = np.argsort(ids, kind="stable")
        keys = ids[place] * (n + 1) + place                 # positions of each word, ascending
        hashed = Stretches(ids, seed)
    for side in (1, -1) if len(nodes) else ():
        s, m, e = start[nodes], mid[nodes], end[nodes]
        most = np.minimum((e - m if side > 0 else m - s) // 2, (e - s) // min_periods)
        at = m if side > 0 else m - 1                       # q is the distance to an equal word on this side
        word = ids[at] * (n + 1)
        lo = np.searchsorted(keys, word + (at + 1 if side > 0 else at - most))
        hi = np.searchsorted(keys, word + (at + most + 1 if side > 0 else at))
        total = np.r_[0, np.cumsum(hi - lo)]
        done = 0
        while done < total[-1]:                             # CHUNK candidates, also out of one node's
            stop = min(done + CHUNK, int(total[-1]))
            c = np.arange(done, stop)
            k = np.searchsorted(total, c, "right") - 1
            q = np.abs(place[lo[k] + c - total[k]] - at[k])
            done = stop
            first = m[k] if side > 0 else m[k] - 2 * q
            ok = hashed.equal(first, q, q)
            k, q, first = k[ok], q[ok], first[ok]
            a = m[k] if side > 0 else m[k] - q
            right = hashed.forward(a, q, e[k] - a - q)
            left = hashed.backward(a, q, a - s[k])
            size = left + q + right
            ok = size >= np.maximum(min_length, min_periods * q)
            out.append(np.stack([nodes[k[ok]], (a - left)[ok], (a + q + right)[ok], q[ok]]))
    found = np.concatenate(out, axis=1)
    found = found[:, np.lexsort(found[[3, 2, 1, 0]])]
    if found.shape[1]:                                      # multiples of a period span the same words
        same = (found[:3, 1:] == found[:3, :-1]).all(0)
        found = found[:, np.r_[True, ~same]]
    for _, a, b, q in found.T.tolist():
        if not np.array_equal(ids[a:b - q], ids[a + q:b]):
            return None
    return found


def find_runs(ids: np.ndarray, sizes: np.ndarray, min_length: int = 6,
              min_periods: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of documents that lie one after the
    other in ``ids``, by start, then period."""
    if not len(ids):
        return (np.empty(0, np.int64),) * 3
    g = Grammar(ids, sizes)
    place = g.one_place()
    size = g.length[g.first:]
    tops = g.halves()
    node = [np.r_[place, tops[0]], np.r_[place + g.length[g.left], tops[1]], np.r_[place + size, tops[2]]]
    seed, found = 0, None
    while found is None:
        found = crossing_runs(ids, *node, min_length, min_periods, seed)
        seed += 1
    # rules: to every position where they are derived; nodes of the trees stand at one
    by_rule = found[:, found[0] < len(place)]
    once = found[1:, found[0] >= len(place)]
    rule, at = g.all_places(np.unique(by_rule[0]))
    lo, hi = np.searchsorted(by_rule[0], rule), np.searchsorted(by_rule[0], rule, "right")
    own = np.repeat(np.arange(len(rule)), hi - lo)
    which = np.arange(len(own)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[own]
    shift = at[own] - place[rule[own]]
    every = np.concatenate([once, by_rule[1:, which] + np.stack([shift, shift, np.zeros_like(shift)])], axis=1)
    if not every.shape[1]:
        return (np.empty(0, np.int64),) * 3
    # merge: intervals of one period that share a period of words
    start, end, period = every[:, np.lexsort(every[[1, 0, 2]])]
    new_period = np.r_[True, period[1:] != period[:-1]]
    group = np.cumsum(new_period)
    reach = np.maximum.accumulate(group * (len(ids) + 1) + end) - group * (len(ids) + 1)
    head = new_period | np.r_[True, start[1:] + period[1:] > reach[:-1]]
    first = np.flatnonzero(head)
    last = np.r_[first[1:], len(start)] - 1
    start, end, period = start[first], reach[last], period[first]
    o = np.lexsort((period, end, start))                    # a run keeps its smallest period
    start, end, period = start[o], end[o], period[o]
    keep = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])]
    start, end, period = start[keep], end[keep], period[keep]
    o = np.lexsort((period, start))
    return start[o], (end - start)[o], period[o]
