"""Token counts at every prefix of a text, for a BPE vocabulary with word ends
(a ``tokenizers`` JSON file).

Prefix dynamic programming: the encoding of the first i bytes of a word ends
with some token t, and what stands before t is the encoding of those first
i - len(t) bytes. So the last token and the count of every prefix follow from
shorter prefixes: t is the one token that ends there and may follow the last
token before it. Two tokens may follow each other if merging their bytes gives
the two back, which holds for a whole encoding if it holds for each pair of
neighbours. Each prefix has two states: open (the word goes on) and closed (the
word ends there, so its last symbol carries the word end).

The counts of a text are the sums over its words, so a text's table is put
together from those of its words. A task computes the words that are new in an
Arrow batch together, length after length and equal prefixes once, and keeps
their tables (a bounded number).
With the table, truncation and budget questions need no encoding: see
``longest_prefix`` and ``fits``.
"""

from __future__ import annotations

import gc
import json
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from copy import copy
from itertools import accumulate
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import by_bytes, numbered

SHORT = 24              # prefixes up to this many bytes are kept across words
KEEP = 400_000          # entries of each table that a task keeps
BATCH_BYTES = 2 << 20


def load(path: str) -> str:
    """The vocabulary as it travels: the JSON text of a ``tokenizers`` file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def prefix_counts(docs: DataFrame, vocabulary: str, *, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with prefix_tokens (array<int>): entry i is the number of
    tokens that the vocabulary's library gives for the first i code points
    (entry 1 of Spark's numbering is the empty prefix, 0 tokens), without
    begin, end or added special tokens; special strings inside a text count as
    the library counts them by default.

    Null and empty texts have the one entry 0. Texts must be valid Unicode.
    Ids play no part, so null ids, repeated rows and ties change nothing.
    Other columns pass through, the text too unless ``keep_text`` is false;
    prefix_tokens replaces a column of that name.
    Time grows with the length of a text, also of one without spaces; only a
    letter with many combining marks costs the square of their number.
    """
    src, names = numbered(docs, ("prefix_tokens",))
    text = names[text_col]
    if not keep_text:
        names = {c: n for c, n in names.items() if c != text_col}
    schema = "".join(f"{n} {src.schema[n].dataType.simpleString()}, " for n in names.values())
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)       # one vocabulary file
    out = src.mapInArrow(_tables(shared, text, list(names.values())), f"{schema}prefix_tokens array<int>")
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], "prefix_tokens")


def n_tokens(prefix_tokens: Column) -> Column:
    """Tokens of the whole text."""
    return F.element_at(prefix_tokens, -1).cast("long")


def tokens_of_prefix(prefix_tokens: Column, n_chars: Column) -> Column:
    """Tokens of the first ``n_chars`` code points (of the whole text, if it has fewer)."""
    return F.element_at(prefix_tokens, F.least(n_chars.cast("int") + 1, F.size(prefix_tokens))).cast("long")


def fits(prefix_tokens: Column, budget: Column) -> Column:
    """Whether the whole text has ``budget`` tokens or fewer."""
    return n_tokens(prefix_tokens) <= budget


def longest_prefix(prefix_tokens: Column, budget: Column) -> Column:
    """Code points of the longest prefix of ``budget`` tokens or fewer. Counts
    can fall from one prefix to the next, so the last entry that fits decides."""
    fit = F.when(fits(prefix_tokens, budget), F.size(prefix_tokens)).otherwise(
        F.aggregate(prefix_tokens, F.struct(F.lit(0).alias("i"), F.lit(0).alias("at")),
                    lambda s, n: F.struct((s["i"] + 1).alias("i"), F.when(n <= budget, s["i"] + 1).otherwise(s["at"]).alias("at")),
                    lambda s: s["at"]))
    return (fit - 1).cast("long")


# --- inside tasks -------------------------------------------------------------

def _tables(shared, text: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        gc.disable()        # the tables hold no cycles, and walking them is a third of the time
        try:
            for batch in by_bytes(batches, text, BATCH_BYTES):
                steps = counter.texts(batch.column(text).to_pylist())
                sizes = np.array([len(s) // 2 + 1 for s in steps])
                flat = np.cumsum(np.frombuffer(b"\0\0" + b"\0\0".join(steps), "<i2"), dtype=np.int64)
                cuts = np.r_[0, np.cumsum(sizes)]
                flat -= np.repeat(np.r_[0, flat[cuts[1:-1] - 1]], sizes)     # every text starts at 0
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], names=[*keep, "prefix_tokens"])
        finally:
            gc.enable()
    return run


class _Steps(dict):
    """Steps of words."""

    def __init__(self, counter: Counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> bytes:
        got = bytes(2 * len(word)) if word[0] in self.counter.spaces else self.counter.word_steps(word)
        if len(word) <= SHORT and len(self) < 2 * KEEP:
            self[word] = got
        return got


class _Prefix:
    """A prefix of a word: its open state (computed when the word goes on) and its tokens as a whole word."""

    __slots__ = ("count", "ended", "last", "next")

    def __init__(self, ended: int):
        self.count = self.last = None
        self.ended = ended
        self.next: dict[int, _Prefix] = {}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: visible
    Latin-1 characters stand for themselves, the others are numbered from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


class Counter:
    """Counts of the prefixes of texts, by the vocabulary of a JSON file."""

    def __init__(self, vocabulary: str):
        import re
        import unicodedata

        import regex
        from tokenizers import Tokenizer

        whole = json.loads(vocabulary)
        model = whole["model"]
        split = whole["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or not split["invert"]:
            raise ValueError("not a byte-level BPE vocabulary with word ends and a pattern of words")
        end = model["end_of_word_suffix"]
        back = {c: b for b, c in enumerate(_byte_letters())}
        raw = lambda token: bytes(back[c] for c in token)
        # symbols and tokens are numbers; an open and a closed token may have the same bytes
        self.open: dict[bytes, int] = {}
        self.closed: dict[bytes, int] = {}
        self.bytes_of: dict[int, bytes] = {}
        self.is_closed: dict[int, bool] = {}
        for token, i in model["vocab"].items():
            shut = token.endswith(end)
            data = raw(token[:-len(end)] if shut else token)
            (self.closed if shut else self.open)[data] = i
            self.bytes_of[i], self.is_closed[i] = data, shut
        vocab = model["vocab"]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        # suffixes of tokens: a longer suffix is tried only while it can be one
        self.tails = {d[i:] for t in (self.open, self.closed) for d in t for i in range(len(d))}
        self.longest = max(map(len, self.tails))
        self.rank = {new: rank for rank, new in self.merges.values()}
        self.halves = {new: pair for pair, (_, new) in self.merges.items()}
        # the short test of may_follow needs one merge for each token, later than those of its halves
        self.orderly = len(self.halves) == len(self.merges) and all(
            self.rank.get(x, -1) < self.rank[t] for t, pair in self.halves.items() for x in pair)
        self.size = max(vocab.values()) + 1
        self.ranks = np.full(self.size, -1)
        self.first, self.second = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        for token, (x, y) in self.halves.items():
            self.ranks[token], self.first[token], self.second[token] = self.rank[token], x, y
        pairs = sorted((x * self.size + y, rank) for (x, y), (rank, _) in self.merges.items())
        self.pair_keys, self.pair_ranks = np.array(pairs, np.int64).reshape(-1, 2).T.copy()
        self._endings()
        self.alone = np.full(self.size, -1, np.int8)        # whether a token encodes its own bytes; -1: not asked yet
        self.follows: dict[tuple[int, int], bool] = {}
        self.table = _Steps(self)
        self._forget()
        self.library = Tokenizer.from_str(vocabulary)
        self.words = regex.compile(split["pattern"]["Regex"])
        self.pieces = regex.compile(split["pattern"]["Regex"] + r"|\s+")
        # the same in classes of the faster module, for characters that both see alike
        quick = split["pattern"]["Regex"].replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\w\s]|_)+").replace(
            r"[\p{L}]", r"[^\W\d_]").replace(r"[\p{N}]", r"\d")
        self.quick = re.compile(quick + r"|\s+") if r"\p" not in quick else None
        self.alike: set[str] = set()
        self.spaces = {chr(n) for n in range(0x3001) if regex.match(r"\s", chr(n))}
        special = [t["content"] for t in whole["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.marks = {s[:2] for s in special}
        self.plain: set[str] = set()
        self.odd: set[str] = set()
        self.normal = lambda s: s.isascii() or unicodedata.is_normalized("NFC", s)

    # -- one word ---------------------------------------------------------------

    def merged(self, symbols: list[int]) -> list[int]:
        """Ranked merges, leftmost first (for pairs of tokens: a few symbols)."""
        while len(symbols) > 1:
            rank, at = min((self.merges.get(p, (1 << 30,))[0], i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 30:
                break
            symbols[at:at + 2] = [self.merges[symbols[at], symbols[at + 1]][1]]
        return symbols

    def symbols(self, token: int) -> list[int]:
        data = self.bytes_of[token]
        out = [self.open[data[i:i + 1]] for i in range(len(data))]
        if self.is_closed[token]:
            out[-1] = self.closed[data[-1:]]
        return out

    def pairs_hold(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether tokens x and y stand side by side in the encoding of their
        bytes, each being a token's encoding by itself: no merge across the
        border comes before those that build the two (orderly merges only).

        Both are taken apart, latest merge first, so that each step sees two
        pieces that stand at the border at one time. A merge of the two comes
        first if its rank is lower than that of x's next merge, and not higher
        than that of y's, which is further right."""
        never = 1 << 30
        good = np.ones(len(x), bool)
        at = np.arange(len(x))
        x_until = np.full(len(x), never)
        y_until = x_until.copy()
        while len(at):
            r = self.merge_rank(x, y)
            good[at[(r < x_until) & (r <= y_until)]] = False
            rx, ry = self.ranks[x], self.ranks[y]
            go = ((rx >= 0) | (ry >= 0)) & good[at]
            at, x, y, rx, ry, x_until, y_until = (v[go] for v in (at, x, y, rx, ry, x_until, y_until))
            right = ry >= rx
            x, y, x_until, y_until = (np.where(right, x, self.second[x]), np.where(right, self.first[y], y),
                                      np.where(right, x_until, rx), np.where(right, ry, y_until))
        return good

    def merge_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x.astype(np.int64) * self.size + y
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[i] == key, self.pair_ranks[i], 1 << 30)

    def may_follow(self, a: int, b: int) -> bool:
        """Whether b may stand after a in an encoding (a = -1: at its start)."""
        got = self.follows.get((a, b))
        if got is None:
            if len(self.follows) >= 2 * KEEP:
                self.follows.clear()
            if a < 0:
                got = self.merged(self.symbols(b)) == [b]
            elif self.orderly:
                got = (self.is_closed[a] or self.may_follow(-1, a)) and self.may_follow(-1, b) and bool(
                    self.pairs_hold(np.array([a]), np.array([b]))[0])
            else:
                got = self.merged(self.symbols(a) + self.symbols(b)) == [a, b]
            self.follows[a, b] = got
        return got

    def _endings(self) -> None:
        """The tree of all tokens read from their ends: (node, byte) -> node,
        and the open and the closed token that a node completes (-1: none)."""
        edges: dict[int, int] = {}
        tokens: list[list[int]] = [[-1, -1]]
        for kind, known in enumerate((self.open, self.closed)):
            for data, token in known.items():
                node = 0
                for byte in reversed(data):
                    node = edges.setdefault(node << 8 | byte, len(tokens))
                    if node == len(tokens):
                        tokens.append([-1, -1])
                tokens[node][kind] = token
        self.edge_keys = np.array(sorted(edges), np.int64)
        self.edge_to = np.array([edges[k] for k in self.edge_keys.tolist()], np.int64)
        self.token_of = np.array(tokens, np.int64)

    def learn(self, words: set[str]) -> None:
        """Fill the table for many short words at once: the recurrence of
        ``_last`` for all their prefixes of one length, length after length.
        Equal prefixes (neighbours, as the words are sorted) are computed once."""
        if len(self.table) + len(words) >= KEEP:
            self.table.clear()
        coded = sorted((e, w) for w, e in ((w, w.encode()) for w in words)
                       if len(e) <= SHORT and 0 not in e and not (e[0] == 39 and len(w) == 3))
        if not coded or not self.orderly:
            return
        n, sizes = len(coded), np.array([len(e) for e, _ in coded])
        width = int(sizes.max())
        letters = np.frombuffer(b"".join(e.ljust(width, b"\0") for e, _ in coded), np.uint8).reshape(n, width)
        differs = letters[1:] != letters[:-1]
        shared = np.r_[0, np.where(differs.any(1), differs.argmax(1), width)]      # bytes shared with the word before
        count, last = [np.zeros(1, np.int64)], [np.full(1, -1)]
        node = [np.zeros(n, np.int64)]
        ended = np.zeros((n, width + 1), np.int64)
        for i in range(1, width + 1):
            long = sizes >= i
            new = long & (shared < i)
            rep = np.flatnonzero(new)
            node.append(np.cumsum(new) - 1)
            own = [np.zeros(len(rep), np.int64), np.zeros(len(rep), np.int64)]      # counts, open and closed
            tokens = np.full(len(rep), -1)
            at, state, found = np.arange(len(rep)), np.zeros(len(rep), np.int64), ([], [])
            for j in range(i - 1, -1, -1):
                key = state << 8 | letters[rep[at], j]
                e = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
                hit = self.edge_keys[e] == key
                at, state = at[hit], self.edge_to[e[hit]]
                if not len(at):
                    break
                before = node[j][rep[at]]
                for kind in (0, 1):
                    token = self.token_of[state, kind]
                    has = token >= 0
                    found[kind].append((at[has], last[j][before[has]], token[has], count[j][before[has]] + 1))
            for kind in (0, 1):
                if found[kind]:
                    who, a, b, c = map(np.concatenate, zip(*found[kind]))
                    ok = self.hold(a, b)
                    own[kind][who[ok]] = c[ok]
                    if not kind:
                        tokens[who[ok]] = b[ok]
            count.append(own[0])
            last.append(tokens)
            ended[long, i] = own[1][node[i][long]]
        # counts at the ends of code points, word after word
        ends = np.zeros((n, width + 1), bool)
        ends[:, 0] = True
        ends[:, 1:-1] = (letters[:, 1:] & 0xC0) != 0x80
        ends[np.arange(n), sizes] = True
        ends &= np.arange(width + 1) <= sizes[:, None]
        flat, per = ended[ends], ends.sum(1)
        starts = np.r_[0, np.cumsum(per)[:-1]]
        steps = np.delete(np.diff(flat, prepend=0), starts).astype("<i2").tobytes()
        cuts = np.r_[0, 2 * np.cumsum(per - 1)].tolist()
        for (_, w), lo, hi in zip(coded, cuts, cuts[1:]):
            self.table[w] = steps[lo:hi]

    def hold(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``may_follow`` for arrays."""
        key, back = np.unique(a * self.size + b, return_inverse=True)       # a = -1 stays apart: its keys are negative
        a, b = key // self.size, key % self.size
        for t in np.unique(b[self.alone[b] < 0]).tolist():
            self.alone[t] = self.merged(self.symbols(t)) == [t]
        good = self.alone[b] == 1
        inner = np.flatnonzero(good & (a >= 0))
        good[inner] = self.pairs_hold(a[inner], b[inner])
        return good[back]

    def _forget(self) -> None:
        self.root = _Prefix(0)
        self.root.count, self.root.last = 0, -1
        self.known = 0

    def _last(self, data: bytes, i: int, path: list[_Prefix], tokens: dict[bytes, int]) -> tuple[int, int]:
        """(count, last token) of the first i bytes, its last token out of
        ``tokens``. path: the prefixes of 0 .. i - 1 bytes (or the last of them)."""
        found = []
        top = len(path) - 1
        for j in range(i - 1, max(-1, i - 1 - min(self.longest, top + 1)), -1):
            piece = data[j:i]
            if piece not in self.tails:
                break
            token = tokens.get(piece)
            if token is not None:
                found.append((path[top - (i - 1 - j)], token))
        for before, token in reversed(found):
            if self.may_follow(before.last, token):
                return before.count + 1, token
        raise ValueError(f"no encoding of {data[:i]!r}")

    def walk(self, data: bytes, path: list[_Prefix]) -> list[_Prefix]:
        """Prefixes of the word ``data``, the empty one first, as far as they
        are not in ``path``. Short ones are kept and shared by other words."""
        for i in range(len(path), len(data) + 1):
            node = path[-1]
            if node.last is None:
                node.count, node.last = self._last(data, i - 1, path[-2 - self.longest:-1], self.open)
            step = node.next.get(data[i - 1])
            if step is None:
                step = _Prefix(self._last(data, i, path, self.closed)[0])
                if i <= SHORT:
                    node.next[data[i - 1]] = step
                    self.known += 1
            path.append(step)
        return path

    def prefixes_of(self, data: bytes) -> list[_Prefix]:
        if self.known >= KEEP:
            self._forget()
        return self.walk(data, [self.root])

    def word(self, data: bytes) -> int:
        return self.prefixes_of(data)[-1].ended

    def word_steps(self, word: str) -> bytes:
        """Differences of the counts at every code point of a (normalised) word."""
        path = self.prefixes_of(word.encode())
        if word.isascii():
            counts = [p.ended for p in path]
        else:
            ends = accumulate(1 if c < "\x80" else len(c.encode()) for c in word)
            counts = [0, *(path[i].ended for i in ends)]
        if len(word) == 3 and word[0] == "'" and word[1].isalpha():      # 'r of 're: two words so far
            counts[2] = self.word(b"'") + self.word(word[1].encode())
        return array("h", map(sub, counts[1:], counts)).tobytes()

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """Steps of whole texts; the new words of regular ones are computed together."""
        split: list[list[str] | None] = []
        new: set[str] = set()
        for t in texts:
            found = None
            if t and self.regular(t) and not any(m in t for m in self.marks):
                pieces = self.quick if self.quick and self.alike.issuperset(t) else self.pieces
                found = pieces.findall(self.lowered(t))
                new.update(found)
            split.append(found)
        new.difference_update(self.table)
        self.learn({w for w in new if w[0] not in self.spaces})
        known = self.table.__getitem__
        return [b"" if not t else b"".join(map(known, found)) if found is not None else
                b"\0\0".join(map(self.steps, t.split(" "))) for t, found in zip(texts, split)]

    def prefixes(self, text: str) -> list[int]:
        """Tokens of the first 1, 2, ... code points of a text."""
        return np.cumsum(np.frombuffer(self.steps(text), "<i2"), dtype=np.int64).tolist()

    def steps(self, text: str) -> bytes:
        """Their differences, in 16 bits each."""
        if not any(m in text for m in self.marks):
            return self.ordinary(text)
        out: list[bytes] = []
        at = 0
        for m in self.special.finditer(text):
            # inside the special string it is ordinary text still
            inside = self.ordinary(text[at:m.end() - 1])
            before = sum(array("h", self.ordinary(text[at:m.start()])))
            out += [inside, array("h", [before + 1 - sum(array("h", inside))]).tobytes()]
            at = m.end()
        return b"".join([*out, self.ordinary(text[at:])])

    def is_plain(self, char: str) -> bool:
        """Whether a character becomes one character, of a class that the
        pattern and the library see alike."""
        if char in self.plain:
            return True
        if char in self.odd:
            return False
        small = char.lower()
        here = f"x{small}{small}x1{small}"      # tells letters, digits, white space and other characters apart
        there = self.library.normalizer.normalize_str(f"x{char}{char}x1{char}")
        space = small in self.spaces
        ok = len(small) == 1 and there == ("x x1 " if space else here)
        if ok:
            theirs = [len(p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(there)]
            ok = theirs == [len(p.encode()) for p in self.words.findall(here)]
            if ok and self.quick and space == small.isspace() and self.quick.findall(here) == self.pieces.findall(here):
                self.alike.add(char)
        (self.plain if ok else self.odd).add(char)
        return ok

    def regular(self, text: str) -> bool:
        """Whether normalisation takes each character to one character."""
        return self.normal(text) and (self.plain.issuperset(text) or all(map(self.is_plain, set(text))))

    def lowered(self, text: str) -> str:
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()      # no final sigma

    def ordinary(self, text: str) -> bytes:
        if self.regular(text):
            return b"".join(map(self.table.__getitem__, self.pieces.findall(self.lowered(text))))
        counts = self.irregular(text)
        return array("h", map(sub, counts, [0, *counts])).tobytes()

    def spans(self, small: str, spans) -> tuple[list[int], dict]:
        """Counts at every prefix of a normalised text with words at ``spans``,
        and each word by its start: (end, tokens before it, its bytes)."""
        out: list[int] = []
        base, words = 0, {}
        for lo, hi in spans:
            out += [base] * (lo - len(out))
            words[lo] = (hi, base, small[lo:hi].encode())
            out += accumulate(array("h", self.table[small[lo:hi]]), initial=base)
            del out[lo]                     # the initial value
            base = out[-1]
        return out + [base] * (len(small) - len(out)), words

    def irregular(self, text: str) -> list[int]:
        """The same for a text that normalisation changes in length or order.
        It is cut before every character that joins nothing before it; a prefix
        that ends at such a cut is a prefix of the normalised text, the others
        (inside a letter and its marks) differ from it in their last letter."""
        tidy, pre = self.library.normalizer.normalize_str, self.library.pre_tokenizer.pre_tokenize_str
        joins = _joining()
        cuts = [i for i, c in enumerate(text) if i == 0 or c not in joins] + [len(text)]
        units = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        normal = [tidy(u) for u in units]
        small = "".join(normal)
        at, words = self.spans(small, [s for _, s in pre(small)])
        starts, out, m, paths = sorted(words), [], 0, {}
        for unit, norm in zip(units, normal):
            for k in range(1, len(unit)):
                out.append(self._with_tail(small, m, tidy(unit[:k]), at, words, starts, pre, paths))
            m += len(norm)
            out.append(at[m - 1] if m else 0)
        return out

    def _with_tail(self, small: str, m: int, tail: str, at: list[int], words: dict, starts: list[int], pre, paths: dict) -> int:
        """Tokens of small[:m] + tail. paths: prefixes of the last long word met."""
        w = bisect_left(starts, m) - 1
        if w < 0 or words[starts[w]][0] < m:            # no word touches the tail
            return (at[m - 1] if m else 0) + sum(self.word(tail[a:b].encode()) for _, (a, b) in pre(tail))
        lo = starts[w]
        if m - lo <= 2 and w and starts[w - 1] == lo - 1 and small[lo - 1] == "'":
            lo -= 1                                     # 'r and a tail e are one word
        _, base, data = words[lo]
        seen = min(m - lo, 4 if m - lo > 8 else 8)      # enough to see how the word goes on
        near = small[m - seen:m] + tail
        got = [s for _, s in pre(near)]
        if seen == m - lo:
            return base + sum(self.word(near[a:b].encode()) for a, b in got)
        if got[0][1] <= seen:                           # it ends at m
            return at[m - 1] + sum(self.word(near[a:b].encode()) for a, b in got[1:])
        # the long word goes on: its prefixes up to m, then the tail's own
        if lo not in paths:
            paths.clear()
            path = self.prefixes_of(data)
            cuts = np.cumsum([0, *(len(c.encode()) for c in data.decode())])
            paths[lo] = path, cuts
        path, cuts = paths[lo]
        i = int(cuts[m - lo])
        back = max(0, i - self.longest - 1)
        more = data[back:i] + near[seen:got[0][1]].encode()
        own = [copy(p) for p in path[back:i + 1]]
        if own[-1].last is None:
            own[-1].count, own[-1].last = self._last(more, i - back, own[:-1], self.open)
        own[-1].next = {}
        return base + self._tail(more, own) + sum(self.word(near[a:b].encode()) for a, b in got[1:])

    def _tail(self, data: bytes, path: list[_Prefix]) -> int:
        """As ``walk``, from the middle of a word, keeping nothing."""
        for i in range(len(path), len(data) + 1):
            if path[-1].last is None:
                path[-1].count, path[-1].last = self._last(data, i - 1, path[:-1], self.open)
            path.append(_Prefix(self._last(data, i, path, self.closed)[0]))
        return path[-1].ended


_JOINING: set[str] = set()


def _joining() -> set[str]:
    """Characters that normalisation may join with, or move before, what stands before them."""
    import sys
    import unicodedata

    if not _JOINING:
        for n in range(sys.maxunicode + 1):
            c = chr(n)
            if unicodedata.combining(c):
                _JOINING.add(c)
            parts = unicodedata.decomposition(c)
            if parts and "<" not in parts and " " in parts:
                _JOINING.add(chr(int(parts.split(" ")[1], 16)))
        _JOINING.update(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
    return _JOINING
