"""LM scoring by deleted interpolation of word bigrams.

P(w | h) = l2 * c(h, w) / c(h) + l1 * c(w) / N + l0 / (V + 1): maximum-likelihood
estimates of two orders and a uniform floor, mixed with weights that depend on
how often the context h was seen (buckets of doubling frequency). The weights
are learned by expectation-maximisation: a fold of the training documents is
deleted from the counts and its own bigrams, under the counts that remain, are
the held-out events. Final scores use the counts of all training documents.

How the counts meet the texts: the counts of the ``known`` most frequent words
are shipped (a bounded table), and all bigrams are dealt once to buckets: by
their rare word if one of the two is rare, else by the pair. A bucket then sees
every occurrence of its pairs and of its rare words and can count both. Bigrams
of two rare words go to the bucket of the second, with a copy to that of the
first for its count, and meet the first word's count in a join; they are few.
Buckets travel as packed columns: sorted codes as differences, in byte planes,
a few bytes for each bigram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import by_bytes, most_frequent, word_hashes
from tidepool.session import materialize

END, START = np.uint64(1), np.uint64(2)     # codes of the end token and of the first context
KNOWN = 1 << 20
DOC_BITS, CODE_BITS = 14, 23
BUCKET_ROWS = 500_000
MOST = 24                                   # largest frequency bucket
STEP = 20                                   # histogram bins for each factor of ten
TRAIN, DELETED = 1, 2                       # flags of a document

UNIGRAM = "w long, c long, e long"
EVENT = "kind int, " + ", ".join(f"x{i} long" for i in range(8))
PART = "slice long, own boolean, blob binary"
SUMS = "id long, n_tokens long, n_known long, base double, score double"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes."""
    import zstandard

    head = np.array([len(arrays), *[x for a in arrays for x in (a.itemsize, len(a))]], np.int64).tobytes()
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(head + planes)


def unpack(blob: bytes) -> list[np.ndarray]:
    """Unsigned integers of the packed widths."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, 2 * n, 8).reshape(n, 2)
    at, out = 8 + 16 * n, []
    for width, size in sizes.tolist():
        flat = np.frombuffer(data, np.uint8, width * size, at).reshape(width, size)
        out.append(np.ascontiguousarray(flat.T).reshape(-1).view(f"<u{width}"))
        at += width * size
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of codes (modulo their width): sorted ones become small."""
    return np.diff(x, prepend=x.dtype.type(0))


def restored(x: np.ndarray) -> np.ndarray:
    """The codes that ``steps`` came from."""
    return np.cumsum(x, dtype=x.dtype)


def slices(batches) -> Iterator[pa.RecordBatch]:
    for part in by_bytes(batches, "_t"):
        for lo in range(0, part.num_rows, 1 << DOC_BITS):
            yield part.slice(lo, 1 << DOC_BITS)


def tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a slice, an end token after every document, and the
    document number of each."""
    hs = [np.append(word_hashes(t, lower=True), END) for t in part.column("_t").to_pylist()]
    return np.concatenate(hs), np.repeat(np.arange(len(hs)), [len(h) for h in hs])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        w, doc = tokens(part)
        flag = part.column("_f").to_numpy()[doc]
        names, at = np.unique(w[flag > 0], return_inverse=True)
        c = np.bincount(at, minlength=len(names)).astype(np.int64)
        e = np.bincount(at[flag[flag > 0] == TRAIN | DELETED], minlength=len(names)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(c), pa.array(e)], names=["w", "c", "e"])


def _spread(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def _base(c, total: int, types: int):
    return np.log10((c + 0.5) / (total + 0.5 * (types + 1)))


def _distinct(code: np.ndarray, h: np.ndarray, doc: np.ndarray, codes: int):
    """Different (word, context, document) rows in order, and how often each
    occurs. They are packed in one number, unless a slice has too many codes."""
    if codes <= 1 << CODE_BITS:
        key = (code << np.uint64(CODE_BITS) | h) << np.uint64(DOC_BITS) | doc
        key, n = np.unique(key, return_counts=True)
        pair = key >> np.uint64(DOC_BITS)
        low = lambda x, bits: x & np.uint64((1 << bits) - 1)
        return pair >> np.uint64(CODE_BITS), low(pair, CODE_BITS), low(key, DOC_BITS), n
    o = np.lexsort((doc, h, code))
    rows = code[o], h[o], doc[o]
    first = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in rows], axis=0)])
    return *(x[first] for x in rows), np.diff(np.r_[first, len(o)])


def _deal(buckets: int, shared, total: int, types: int):
    """Bigrams of each slice, packed by bucket, and one row of the slice's own
    (negative bucket) with the ids and what known words alone say. Codes below
    the size of the known table are ranks in it, codes beyond it point to the
    rare words that the pack carries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, counts, _ = shared.value
        size, task = len(known), TaskContext.get().partitionId()
        start = np.uint64(np.searchsorted(known, START))         # both are always known
        for number, part in enumerate(slices(batches)):
            name = np.array([task << 40 | number << DOC_BITS], np.uint64)
            w, doc = tokens(part)
            at = np.minimum(np.searchsorted(known, w), size - 1)
            rare = known[at] != w
            names, local = np.unique(w[rare], return_inverse=True)
            code = at.astype(np.uint64)
            code[rare] = np.uint64(size) + local.astype(np.uint64)
            h = np.r_[start, code[:-1]]
            h[np.r_[True, doc[1:] != doc[:-1]]] = start
            word, ctx, d, n = _distinct(code, h, doc.astype(np.uint64), size + len(names))
            flag = part.column("_f").to_numpy().astype(np.uint64)
            d |= flag[d.astype(np.int64)] << np.uint64(DOC_BITS)
            hashed = lambda c: names[(c - np.uint64(size)).astype(np.int64)]
            route, copy = word << np.uint64(CODE_BITS) | ctx, np.zeros(len(word), np.uint8)    # kept where both are known
            far_h, far_w = ctx >= size, word >= size
            route[far_h] = hashed(ctx[far_h])
            route[far_w] = hashed(word[far_w])
            twice = np.flatnonzero(far_h & far_w)
            word, ctx, d, n, route, copy = (np.r_[x, x[twice]] for x in (word, ctx, d, n, route, copy))
            if len(twice):
                copy[-len(twice):] = 1
                route[-len(twice):] = hashed(ctx[-len(twice):])
            bucket = (_spread(route) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(cuts))
            blobs = []
            for b in used:
                o = order[cuts[b]:cuts[b + 1]]
                ww, hh = word[o], ctx[o]
                mine, both = np.unique(np.r_[ww[ww >= size], hh[hh >= size]], return_inverse=True)
                k = int((ww >= size).sum())
                ww[ww >= size] = np.uint64(size) + both[:k].astype(np.uint64)
                hh[hh >= size] = np.uint64(size) + both[k:].astype(np.uint64)
                blobs.append(pack(name, hashed(mine), steps(ww.astype(np.uint32)), hh.astype(np.uint32), d[o].astype(np.uint16),
                                  n[o].astype(np.uint32), copy[o]))
            docs = part.num_rows
            c = np.where(rare, 0, counts[at])
            base = np.bincount(doc, np.where(rare, 0.0, _base(c, total, types)), docs)
            ids = part.column("_id")
            blobs.append(pack(name, pa.compute.fill_null(ids, 0).to_numpy(zero_copy_only=False),
                              pa.compute.is_null(ids).to_numpy(zero_copy_only=False).astype(np.uint8),
                              np.bincount(doc, minlength=docs).astype(np.uint32),
                              np.bincount(doc, (c > 0).astype(float), docs).astype(np.uint32), base))
            own = -1 - int(_spread(name)[0] % np.uint64(buckets))
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[used, own].astype(np.int32)), pa.array(blobs, pa.binary())],
                                             names=["bucket", "blob"])
    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list[bytes]]]:
    """Packs of one bucket at a time (the rows come sorted by bucket), and
    whether they are the slices' own."""
    now, blobs = None, []
    for batch in batches:
        for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
            if b != now and blobs:
                yield now < 0, blobs
                blobs = []
            now = b
            blobs.append(blob)
    if blobs:
        yield now < 0, blobs


def _either(table: np.ndarray, rest: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Entries of a table, and of what follows it, without putting the two together."""
    out, far = np.empty(len(code), table.dtype), code >= len(table)
    out[~far] = table[code[~far]]
    out[far] = rest[code[far] - len(table)]
    return out


def _counted(blobs: list[bytes], shared) -> dict[str, np.ndarray]:
    """All bigrams of a bucket with the counts that a bucket can know."""
    known, kc, ke = shared.value
    size = len(known)
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]
    names_at = 0
    for blob in blobs:
        name, names, w, h, d, n, copy = unpack(blob)
        w, h, d = restored(w).astype(np.int64), h.astype(np.int64), d.astype(np.int64)
        w[w >= size] += names_at
        h[h >= size] += names_at
        key = int(name[0]) | d & (1 << DOC_BITS) - 1
        for c, x in zip(cols, (names, w, h, key | d >> DOC_BITS << 62, n.astype(np.int64), copy)):
            c.append(x)
        names_at += len(names)
    names, w, h, key, n, copy = (np.concatenate(c) for c in cols)
    flag, key = key >> 62 & 3, key & (1 << 62) - 1
    rare, same = np.unique(names, return_inverse=True)
    for x in (w, h):
        far = x >= size
        x[far] = size + same[x[far] - size]
    far_w, far_h, own = w >= size, h >= size, copy == 0
    train, deleted = n * (flag & TRAIN > 0), n * (flag & DELETED > 0)
    total = lambda at, v, m: np.bincount(at, v, m).astype(np.int64)
    _, pair = np.unique(w << 32 | h, return_inverse=True)
    out = {"key": key, "flag": flag, "n": n, "tail": far_w & far_h, "rare_w": far_w,
           "chw": total(pair, train * own, 0)[pair], "ehw": total(pair, deleted * own, 0)[pair],
           "h": _either(known, rare, h).view(np.int64)}
    of_w, of_h = far_w & own, far_h & (~far_w | ~own)
    for k, table, v in (("cw", kc, train), ("ew", ke, deleted)):
        out[k] = _either(table, total(w[of_w] - size, v[of_w], len(rare)), w)
    for k, table, v in (("ch", kc, train), ("eh", ke, deleted)):
        out[k] = _either(table, total(h[of_h] - size, v[of_h], len(rare)), h)
    return {k: v[own] for k, v in out.items()}


def frequency(c: np.ndarray) -> np.ndarray:
    """Bucket of a context count: 0, 1, 2-3, 4-7, ..."""
    return np.minimum(np.frexp(c.astype(np.float64))[1], MOST)


def estimates(chw, ch, cw, total):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(ch > 0, chw / np.maximum(ch, 1), 0.0), cw / max(total, 1)


def histogram(x: dict, retained: int) -> list[np.ndarray]:
    """Held-out events binned by context bucket and both estimates."""
    p2, p1 = estimates(x["chw"] - x["ehw"], x["ch"] - x["eh"], x["cw"] - x["ew"], retained)
    with np.errstate(divide="ignore"):
        bins = [np.where(p > 0, np.round(np.log10(np.maximum(p, 1e-300)) * STEP), 1).astype(np.int64) for p in (p2, p1)]
    cell = (frequency(x["ch"] - x["eh"]).astype(np.int64) << 40) | (bins[0] + 100_000) << 20 | (bins[1] + 100_000)
    names, at = np.unique(cell, return_inverse=True)
    n = np.bincount(at, x["n"], len(names)).astype(np.int64)
    return [names >> 40, (names >> 20 & 0xFFFFF) - 100_000, (names & 0xFFFFF) - 100_000, n]


def learn_weights(hist: np.ndarray, types: int, rounds: int = 100) -> np.ndarray:
    """(MOST + 1, 3) mixture weights by EM over rows (bucket, bin of the bigram
    estimate, bin of the unigram estimate, events). A bucket without events
    takes the weights of all of them."""
    value = lambda b: np.where(b == 1, 0.0, 10.0 ** (b / STEP))
    out = np.zeros((MOST + 1, 3))
    every = np.ones(len(hist), bool)
    for bucket in [None, *range(MOST + 1)]:
        rows = hist[every if bucket is None else hist[:, 0] == bucket]
        if len(rows):
            p = np.column_stack([value(rows[:, 1]), value(rows[:, 2]), np.full(len(rows), 1.0 / (types + 1))])
            n, mix = rows[:, 3].astype(float), np.full(3, 1 / 3)
            for _ in range(rounds):
                part = p * mix
                mix = (part / part.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
            # the floor keeps unseen words possible
            mix = np.maximum(mix, [0.0, 0.0, 1e-6])
            mix /= mix.sum()
        elif bucket is None:
            mix = np.array([0.0, 0.5, 0.5])
        else:
            mix = out[-1] if bucket == 0 else whole
        if bucket is None:
            whole = mix
            out[:] = mix
        else:
            out[bucket] = mix
    return out


def log_probability(x: dict, weights: np.ndarray, total: int, types: int) -> np.ndarray:
    p2, p1 = estimates(x["chw"], x["ch"], x["cw"], total)
    m = weights[frequency(x["ch"])]
    return x["n"] * np.log10(m[:, 0] * p2 + m[:, 1] * p1 + m[:, 2] / (types + 1))


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(c).cast(kinds[k.split()[1]]) for c, k in zip(columns, schema.split(", "))],
                                      names=names)


def _events(shared, retained: int):
    """Histogram rows (kind 0) of the held-out events, and the bigrams of two
    rare words (kind 1) with the counts they have so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, blobs in _gathered(batches):
            if own:
                continue
            x = _counted(blobs, shared)
            held = ~x["tail"] & (x["flag"] & DELETED > 0)
            cells = histogram({k: v[held] for k, v in x.items()}, retained)
            zero = np.zeros(len(cells[0]), np.int64)
            yield _batch(EVENT, [zero, *cells, *[zero] * 4])
            t = x["tail"]
            yield _batch(EVENT, [np.ones(int(t.sum()), np.int64), *[x[k][t] for k in RARE[:8]]])
    return run


def _parts(key: np.ndarray, seen: np.ndarray, base: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    """Sums by document, packed by slice: they travel back the way they came."""
    keys, doc = np.unique(key, return_inverse=True)
    size = len(keys)
    sums = [np.bincount(doc, x, size) for x in (seen, base, score)]
    cuts = np.flatnonzero(np.r_[True, np.diff(keys >> DOC_BITS) > 0]).tolist() if size else []
    blobs = [pack((keys[lo:hi] & (1 << DOC_BITS) - 1).astype(np.uint16), sums[0][lo:hi].astype(np.uint32),
                  sums[1][lo:hi], sums[2][lo:hi]) for lo, hi in zip(cuts, [*cuts[1:], size])]
    return pa.RecordBatch.from_arrays([pa.array([int(keys[c] >> DOC_BITS) for c in cuts], pa.int64()),
                                       pa.array([False] * len(cuts), pa.bool_()), pa.array(blobs, pa.binary())],
                                      names=["slice", "own", "blob"])


def _scores(shared, weights: np.ndarray, total: int, types: int):
    """Sums by document of rare words and of the model, from the buckets; the
    slices' own rows pass on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, blobs in _gathered(batches):
            if own:
                at = [int(unpack(blob)[0][0]) >> DOC_BITS for blob in blobs]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([True] * len(at)),
                                                  pa.array(blobs, pa.binary())], names=["slice", "own", "blob"])
                continue
            x = _counted(blobs, shared)
            p = np.where(x["tail"], 0.0, log_probability(x, weights, total, types))
            base = np.where(x["rare_w"], x["n"] * _base(x["cw"], total, types), 0.0)
            yield _parts(x["key"], x["n"] * (x["rare_w"] & (x["cw"] > 0)), base, p)
    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of a slice (the rows come sorted by slice,
    its own row first)."""
    ids, sums = None, None

    def rows():
        name, value, null, n, seen, base = ids
        return _batch(SUMS, [pa.array(value.view(np.int64), mask=null > 0), n, seen + sums[0].astype(np.int64),
                             base.view(np.float64) + sums[1], sums[2]])

    for batch in batches:
        for own, blob in zip(batch.column("own").to_pylist(), batch.column("blob").to_pylist()):
            if own:
                if ids is not None:
                    yield rows()
                ids = unpack(blob)
                sums = [np.zeros(len(ids[1])) for _ in range(3)]
            else:
                d, seen, base, score = unpack(blob)
                for total, x in zip(sums, (seen, base.view(np.float64), score.view(np.float64))):
                    total[d] += x
    if ids is not None:
        yield rows()


RARE = ["h", "key", "flag", "n", "chw", "ehw", "cw", "ew", "ch", "eh"]


def _rare(mode: str, *args):
    """The same for bigrams of two rare words, after the join with the first one's count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {k: batch.column(k).to_numpy() for k in RARE}
            if mode == "events":
                yield _batch(", ".join(f"x{i} long" for i in range(4)), histogram(x, *args))
            else:
                p = log_probability(x, *args)
                yield _parts(x["key"], np.zeros(len(p)), np.zeros(len(p)), p)
    return run


def known_words(counts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """At most n words, the most frequent ones (sorted hashes), with their
    counts. The start context and the end token are always added."""
    top = most_frequent(counts, n, "c").toArrow()
    w, c, e = (top.column(k).to_numpy() for k in ("w", "c", "e"))
    w = w.view(np.uint64)
    ends = counts.filter(F.col("w") == int(END)).first()
    rest = ~np.isin(w, [END, START])
    c_end, e_end = (ends["c"], ends["e"]) if ends else (0, 0)
    w = np.r_[w[rest], END, START]
    c, e = (np.r_[v[rest], [x, x]].astype(np.int64) for v, x in ((c, c_end), (e, e_end)))
    o = np.argsort(w)
    return w[o], c[o], e[o]


def score(docs: DataFrame, train: Column, deleted: Column, *, id_col: str = "doc_id", text_col: str = "text",
          known: int = KNOWN) -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score), one row for
    each input row.

    ``train`` says which rows are learned from, ``deleted`` which of them are
    the held-out fold of the weights (null: no). Null and empty texts have one
    token, the end. Ids only pass through, so null and repeated ones do no harm.
    Without training rows every word has the uniform probability of the floor. Other
    columns are not read.
    """
    flag = (F.when(F.coalesce(train, F.lit(False)), F.when(F.coalesce(deleted, F.lit(False)), TRAIN | DELETED)
                   .otherwise(TRAIN)).otherwise(0))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), flag.cast("int").alias("_f"),
                       F.col(f"`{text_col}`").alias("_t"))
    spark = docs.sparkSession
    counts = rows.mapInArrow(_count_words, UNIGRAM).groupBy("w").agg(F.sum("c").alias("c"), F.sum("e").alias("e"))
    counts = materialize(counts, "lm-unigrams")
    s = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("e"), F.lit(0)), F.count("*")).first()
    total, gone, types = int(s[0]), int(s[1]), int(s[2])
    shared = spark.sparkContext.broadcast(known_words(counts, known))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, 1 + total // BUCKET_ROWS)
    dealt = (rows.mapInArrow(_deal(buckets, shared, total, types), "bucket int, blob binary")
             .repartition(F.col("bucket")).sortWithinPartitions("bucket").persist(StorageLevel.DISK_ONLY))
    events = materialize(dealt.mapInArrow(_events(shared, total - gone), EVENT), "lm-events")
    rare = events.filter("kind = 1").select(*[F.col(f"x{i}").alias(k) for i, k in enumerate(RARE[:8])])
    rare = rare.join(counts.select(F.col("w").alias("h"), F.col("c").alias("ch"), F.col("e").alias("eh")), "h", "left")
    rare = rare.fillna(0, ["ch", "eh"]).select(*RARE)
    held = rare.filter(F.col("flag").bitwiseAND(DELETED) > 0).mapInArrow(
        _rare("events", total - gone), ", ".join(f"x{i} long" for i in range(4)))
    hist = (events.filter("kind = 0").select("x0", "x1", "x2", "x3").unionAll(held)
            .groupBy("x0", "x1", "x2").agg(F.sum("x3").alias("x3")).toPandas())       # bounded by the bins
    weights = learn_weights(hist.to_numpy(np.int64).reshape(-1, 4), types)
    sums = dealt.mapInArrow(_scores(shared, weights, total, types), PART).unionAll(
        rare.mapInArrow(_rare("scores", weights, total, types), PART))
    sums = sums.repartition(F.col("slice")).sortWithinPartitions("slice", F.desc("own"))
    out = materialize(sums.mapInArrow(_summed, SUMS), "lm-scores")
    dealt.unpersist()
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                      F.col("base").alias("base_score"), "score")
