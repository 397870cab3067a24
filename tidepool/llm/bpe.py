"""Byte-level BPE: encoding folds ranked merges with higher-order functions,
decoding concatenates the binary pieces of the ids.

Every match of the split pattern is one word. The words of all documents are
counted, the ``dictionary`` most frequent ones are folded once and shipped to
the tasks (their number is the bound of what is shipped), and the words beyond
them are folded where they stand, inside the row of their document. So the
result does not depend on the dictionary's size, and no word is ever shuffled
back to its document.

The fold runs in the JVM: its state is the array of the word's cuts, each with
the rank of the pair around it; each step removes the leftmost cut of lowest
rank and looks up the two pairs that change, and it ends when no pair has a
rank. Ranks come from a literal of small maps, indexed by a checksum of the
piece, because a lookup in one literal map walks through its keys.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import SLICE_BYTES, by_bytes, most_frequent
from tidepool.session import materialize

SLOTS = 8192          # small maps of the literal, about six ranks each
NONE = 2147483647     # rank of a pair that is no token


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 piece and id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once for ``body`` (expressions have no local names)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rank_table(ranks: dict[bytes, int]) -> Column:
    """The literal rank map: SLOTS small maps from piece (in hex digits) to
    rank. It is written as one JSON text, which the optimizer folds to a
    literal once."""
    import json
    import zlib

    slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for piece, rank in ranks.items():
        slots[zlib.crc32(piece) % SLOTS][piece.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(slots)), "array<map<string,int>>")


def encode_words(ws: Column, table: Column) -> Column:
    """Ids (array<array<int>>) of an array of words (binary, none empty)."""
    return _let(table, lambda t: F.transform(ws, lambda w: _encode_word(w, t)))


def _encode_word(word: Column, table: Column) -> Column:
    # A cut is a long: the rank of the piece that it divides, and its place. So the
    # least of them is the leftmost of lowest rank. The places around the word are
    # such that a piece which would reach beyond it is empty, and has no rank.
    def rank(piece: Column) -> Column:
        slot = F.get(table, F.crc32(piece).bitwiseAND(SLOTS - 1).cast("int"))
        return F.coalesce(F.element_at(slot, F.hex(piece)), F.lit(NONE))

    cut = lambda r, place: F.shiftleft(r.cast("long"), 32).bitwiseOR(place.cast("long"))
    piece = lambda lo, hi: F.substring(word, lo + 1, hi - lo)
    place = lambda s, i: F.get(s, i).bitwiseAND(0xFFFFFFFF).cast("int")
    outer = lambda x: F.lit(NONE << 32 | x)
    size = F.octet_length(word)
    inner = F.transform(F.sequence(F.lit(1), size - 1), lambda i: cut(_let(F.substring(word, i, 2), rank), i))
    start = F.concat(F.array(outer(1 << 30), outer(0)), inner, F.array(cut(F.lit(NONE), size), outer(0)))

    def without(s: Column, i: Column) -> Column:
        """s without its i-th cut (from 1)."""
        a, b, c, d = (place(s, i + k) for k in (-3, -2, 0, 1))
        return F.concat(F.slice(s, F.lit(1), i - 2),
                        F.array(cut(_let(piece(a, c), rank), b), cut(_let(piece(b, d), rank), c)),
                        F.slice(s, i + 2, F.size(s)))

    def step(s: Column, _: Column) -> Column:
        return _let(F.array_min(s), lambda low: F.when(low >= NONE << 32, s).otherwise(
            _let(F.array_position(s, low).cast("int"), lambda i: without(s, i))))

    ids = lambda s: F.transform(F.sequence(F.lit(1), F.size(s) - 3), lambda i: _let(piece(place(s, i), place(s, i + 1)), rank))
    folded = F.aggregate(F.sequence(F.lit(1), size - 1), start, step, ids)
    return _let(rank(word), lambda whole: F.when((whole != NONE) | (size == 1), F.array(whole)).otherwise(folded))


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """Bytes of an array of ids, its pieces one after the other (null: null).
    Ids must be of the vocabulary."""
    pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    vocabulary = pa.array(pieces, pa.binary())

    @F.arrow_udf("binary")          # no pandas: the workers of a task's three Python steps live at a time
    def joined(batch: pa.Array) -> pa.Array:
        at = batch.offsets.to_numpy()
        parts = vocabulary.take(batch.values.slice(at[0], at[-1] - at[0]))
        _, ends, data = parts.buffers()         # pieces lie one after the other, so only the cuts change
        cuts = np.frombuffer(ends, np.int32)[at - at[0]] if len(parts) else np.zeros(len(at), np.int32)
        texts = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(cuts.astype(np.int32)), data])
        return pc.if_else(batch.is_valid(), texts, pa.scalar(None, pa.binary()))

    return joined(ids)


# --- inside tasks -------------------------------------------------------------

# Of patterns that begin with contractions and are these runs otherwise, letters and
# ASCII marks after a space are two words (letters that every Unicode version has), a
# line's end between marks or letters and letters is one, and the line begins anew.
RUNS = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTERS, MARKS = "[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]+", "[!-/:-@\\[-`{-~]*"
PLAIN = f"(?P<a>{LETTERS})(?P<b>{MARKS})(?:\n(?P<c>{LETTERS})(?P<d>{MARKS}))?"
# What any library takes for white space, written out because Arrow's \s is ASCII's.
WHITE = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
RISKY = f" {WHITE}|{WHITE} |\\A{WHITE}|{WHITE}\\z"


class _Splitter:
    """Words of a text, in order. A space between two characters that are not
    white space always starts a new word, so most texts are cut there first and
    a repeated part is matched once."""

    def __init__(self, pattern: str):
        import re

        import regex

        self.find = regex.compile(pattern).findall
        head, runs, tail = pattern.partition(RUNS)
        self.known_form = bool(runs and not tail and re.fullmatch(r"('\w+\|)*", head))
        self.plain = re.compile(PLAIN if self.known_form else r"(?!)").fullmatch

    def cut(self, texts: pa.Array) -> tuple[list[list[str]], pa.Array, np.ndarray]:
        """Words of each text's beginning (of all of it, if it is not safe to cut
        it at its spaces), the parts that follow spaces, and where each text
        begins among beginnings and parts together."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        risky = pc.match_substring_regex(texts, RISKY)
        cut = pc.split_pattern(pc.if_else(risky, "", texts), " ")
        at = cut.offsets.to_numpy()
        after = np.ones(len(cut.values), bool)
        after[at[:-1]] = False
        begin = pc.if_else(risky, texts, cut.values.take(pa.array(at[:-1])))
        return list(map(self.find, begin.to_pylist())), cut.values.filter(pa.array(after)), at

    def after_space(self, part: str) -> list[str]:
        """Words of a part and the space before it."""
        m = self.plain(part)
        if m is None:
            return self.find(" " + part)
        return [x for x in (" " + m["a"], m["b"], "\n" if m["c"] else "", m["c"], m["d"]) if x]

    def after_spaces(self, parts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """``after_space`` of all parts: distinct words, the numbers of those of
        every part one after the other, and the cuts between parts."""
        plain, groups, there = np.zeros(len(parts), bool), [], []
        if self.known_form:
            m = pc.extract_regex(parts, f"\\A{PLAIN}\\z")
            plain = m.is_valid().to_numpy(zero_copy_only=False)
            a, b, c, d = map(m.field, "abcd")
            groups = [pc.binary_join_element_wise(" ", a, ""), b, pa.repeat("\n", len(parts)), c, d]
            there = [plain & (pc.binary_length(g).to_numpy(zero_copy_only=False) > 0) for g in (a, b, c, c, d)]
        odd = list(map(self.after_space, parts.filter(pa.array(~plain)).to_pylist()))
        n = np.sum(there, 0, np.int64) if there else np.zeros(len(parts), np.int64)
        n[~plain] = list(map(len, odd))
        cuts = np.r_[0, np.cumsum(n)]
        pool = [g.filter(pa.array(ok)) for g, ok in zip(groups, there)]
        at = np.empty(cuts[-1], np.int64)
        place, done = cuts[:-1].copy(), 0
        for ok in there:
            at[place[ok]] = done + np.arange(ok.sum())
            place += ok
            done += ok.sum()
        rest = np.repeat(~plain, n)
        at[rest] = done + np.arange(rest.sum())
        pool = pa.concat_arrays([*pool, pa.array(chain.from_iterable(odd), pa.string())]).dictionary_encode()
        return pool.dictionary, pool.indices.to_numpy()[at], cuts


def _count(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _Splitter(pattern)
        for batch in by_bytes(batches, "_t"):
            begin, parts, _ = split.cut(batch.column("_t"))
            first = Counter(chain.from_iterable(begin))
            parts = parts.dictionary_encode()
            words, codes, cuts = split.after_spaces(parts.dictionary)
            n = np.bincount(parts.indices.to_numpy(), minlength=len(parts.dictionary))
            n = np.bincount(codes, np.repeat(n, np.diff(cuts)), len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array(first.keys(), pa.string())]),
                                              pa.array(np.r_[n, np.fromiter(first.values(), np.int64, len(first))])],
                                             names=["w", "n"])
    return run


def frequent_words(docs: DataFrame, text_col: str, pattern: str, n: int) -> DataFrame:
    """(w, n): at most n words, the most frequent ones."""
    counts = docs.select(F.col(f"`{text_col}`").alias("_t")).mapInArrow(_count(pattern), "w string, n long")
    counts = materialize(counts.groupBy("w").agg(F.sum("n").alias("n")), "bpe-words")
    return most_frequent(counts, n, "n")


def _packed(words: pa.Table) -> bytes:
    """The dictionary as it travels: compressed columns, so neither the driver
    nor a task holds a Python object for each word."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, words.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for part in words.to_batches():
            out.write_batch(part)
    return sink.getvalue().to_pybytes()


class _Known:
    """The shipped dictionary."""

    def __init__(self, data: bytes):
        words = pa.ipc.open_stream(data).read_all().combine_chunks()
        self.b, self.ids = (words.column(name).combine_chunks() for name in ("b", "ids"))

    def find(self, words: pa.Array) -> pa.Array:
        """Place of each word in the dictionary; null: not in it."""
        words = words.cast(pa.binary()).dictionary_encode()
        # the fewer are hashed: the dictionary's words are looked for among these
        among = pc.index_in(self.b, words.dictionary)
        at = np.full(len(words.dictionary), -1, np.int32)
        at[among.drop_null().to_numpy()] = np.flatnonzero(among.is_valid().to_numpy(zero_copy_only=False))
        return pc.if_else(at < 0, pa.scalar(None, pa.int32()), at).take(words.indices)

    def ids_of(self, words: list[str]) -> list[bytes | None]:
        """Ids of each word; None: not in the dictionary."""
        found = self.ids.take(self.find(pa.array(words, pa.string())))
        return [None if x is None else np.array(x, "<i4").tobytes() for x in found.to_pylist()]


def _lists(cuts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values)


def _word_ids(known: _Known, words: pa.Array) -> tuple[pa.ListArray, pa.Array]:
    """Ids of each word, and the words that are not known; the k-th of these
    (from 0) has the one id -1 - k."""
    found = known.find(words)
    lost = found.is_null().to_numpy(zero_copy_only=False)
    ids = known.ids.take(found)
    n = np.diff(ids.offsets.to_numpy())
    n[lost] = 1
    flat = np.empty(n.sum(), np.int32)
    of_lost = np.repeat(lost, n)
    flat[~of_lost] = ids.flatten().to_numpy()
    flat[of_lost] = -1 - np.arange(lost.sum())
    return _lists(np.r_[0, np.cumsum(n)], pa.array(flat)), words.filter(pa.array(lost))


def _lookup(pattern: str, shared, limit: int = SLICE_BYTES):
    """Replace known words by ids: segments of ids around the words left over.
    Distinct parts of ``limit`` bytes of texts are split and looked up together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _Splitter(pattern)
        known = _Known(shared.value)
        for batch in by_bytes(batches, "_t", limit):
            col = batch.schema.get_field_index("_t")
            begin, parts, at = split.cut(batch.column(col))
            parts = parts.dictionary_encode()
            words, codes, cuts = split.after_spaces(parts.dictionary)
            first = pa.array(chain.from_iterable(begin), pa.string())
            ids, lost = _word_ids(known, pa.concat_arrays([words, first]))
            # ids of every part, then those of every beginning
            codes = np.r_[codes, len(words) + np.arange(len(first))]
            cuts = np.r_[cuts, cuts[-1] + np.cumsum(list(map(len, begin)), dtype=np.int64)]
            ids = ids.take(pa.array(codes))
            ids = _lists(ids.offsets.to_numpy()[cuts], ids.values)
            order = np.empty(at[-1], np.int64)
            follows = np.ones(at[-1], bool)
            follows[at[:-1]] = False
            order[at[:-1]] = len(parts.dictionary) + np.arange(len(begin))
            order[follows] = parts.indices.to_numpy()
            ids = ids.take(pa.array(order))
            ends, ids = ids.offsets.to_numpy()[at], ids.values.to_numpy()
            # segments end at a lost word and at the end of a text
            gaps = np.flatnonzero(ids < 0)
            n_rest = np.diff(np.searchsorted(gaps, ends))
            seg_ends = np.insert(gaps, np.searchsorted(gaps, ends[1:]), ends[1:])
            seg_ends -= np.searchsorted(gaps, seg_ends)
            rest = lost.take(pa.array(-1 - ids[gaps]))
            flat = _lists(np.r_[0, seg_ends], pa.array(ids[ids >= 0]))
            yield pa.RecordBatch.from_arrays(
                [c for i, c in enumerate(batch.columns) if i != col]
                + [_lists(np.r_[0, np.cumsum(n_rest + 1)], flat), _lists(np.r_[0, np.cumsum(n_rest)], rest)],
                names=[n for i, n in enumerate(batch.schema.names) if i != col] + ["_segs", "_rest"])
    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, text_col: str = "text",
           dictionary: int = 800_000) -> DataFrame:
    """``docs`` with ids (array<int>) in place of its text column.

    Null and empty texts have no ids. Texts must be valid Unicode. The columns
    other than the text pass through; a column named ids is replaced. Special
    tokens are never produced. The cost of one word grows with the square of
    its length.
    """
    spark: SparkSession = docs.sparkSession
    # the literal stands in the descriptions of plans and of their nodes, which the driver keeps of each run
    spark.conf.set("spark.sql.maxPlanStringLength", 100_000)
    spark.conf.set("spark.sql.debug.maxToStringFields", 1)
    table = rank_table(ranks)
    top = frequent_words(docs, text_col, pattern, dictionary)
    top = top.select(F.encode("w", "utf-8").alias("b")).repartition(48, "b")
    folded = top.select("b", F.element_at(encode_words(F.array("b"), table), 1).alias("ids"))
    shared = spark.sparkContext.broadcast(_packed(folded.toArrow()))
    pa.default_memory_pool().release_unused()       # the driver's
    keep = [c for c in docs.columns if c not in (text_col, "ids")]
    src = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("_t"))
    schema = [f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    looked = src.mapInArrow(_lookup(pattern, shared), ", ".join([*schema, "_segs array<array<int>>, _rest array<string>"]))
    rest = encode_words(F.transform("_rest", lambda w: F.encode(w, "utf-8")), table)
    none = F.array().cast("array<int>")
    # the ids of the words left over go between the segments
    ids = F.when(F.size("_rest") == 0, F.get("_segs", F.lit(0))).otherwise(
        F.flatten(F.zip_with("_segs", rest, lambda known, word: F.concat(known, F.coalesce(word, none)))))
    return looked.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], ids.alias("ids"))
