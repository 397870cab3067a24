"""Conversation trie against a plain one, contraction against plain sums."""

import hashlib
import random
import zlib

from tests.llm.helpers import collect
from tidepool.llm import prefix_trie as pt
from tidepool.llm import queries as Q


def plain_trie(rows, head=lambda c: zlib.crc32(str(c).encode()) % 6):
    """rows: (conv, turn, role, text); turns of one number must be alike."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [t for _, _, t in sorted(v)] for c, v in own.items()}
    built = {c: own.get(c - c % 100, [])[:head(c)] + v[head(c):] for c, v in own.items()}
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        kids = sum(len(q) == len(p) + 1 for q in below)
        leaf = lambda q: not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in members)
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids, sum(map(leaf, below)),
                    sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows],
                                 "conv_id long, turn long, role string, text string, conv int, node string, depth int")


def run(spark, rows):
    turns = pt.ordered_turns(conversations(spark, rows))
    return collect(pt.trie(*pt.share_heads(turns, lambda c: Q.fold_of(c, 6), lambda c: c - c % 100, 5)))


def test_odd_conversations(spark):
    rng = random.Random(1)
    rows = []
    for c in [*range(0, 14), *range(100, 106), 203, 207, 399]:      # conversation 200 is absent
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "été " * 30, "yes"])))
    rows += [(c, t, "user", f"same {t}") for c in (500, 501, 502, 503) for t in range(8)]       # copies
    rows += [(600, None, "user", "first"), (600, -5, None, None), (600, 10**15, "user", "last")]
    rows += [(700, 1, "a", "b")] * 3                                                            # repeated rows
    rows += [(None, 0, "user", "nobody's"), (800, None, None, None)]
    assert run(spark, rows) == plain_trie(rows)


def test_empty_and_single(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "a", "b")]) == []
    # all turns are replaced by those of an absent conversation: only the root is left
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(c, 0, "user", "text")]
    got = run(spark, rows)
    assert got == plain_trie(rows) and len(got) == 1 and got[0][:3] == (c, 0, None)


def test_long_conversation_in_blocks(spark, monkeypatch):
    """Numbering and sums over several blocks; a chain is compressed in few rounds."""
    monkeypatch.setattr(pt, "BLOCK", 8)
    rows = [(0, t, "u", str(t % 5)) for t in range(60)] + [(0, None, "u", "x")] + [(100, t, "u", str(t % 5)) for t in range(30)]
    assert run(spark, rows) == plain_trie(rows)


def test_contraction(spark):
    rng = random.Random(2)
    parent = {0: None}
    for n in range(1, 150):
        parent[n] = rng.choice([n - 1, n - 1, n - 1, rng.randrange(n)])
    for n in range(150, 200):
        parent[n] = 7                                   # a hot parent
    value = {n: rng.randrange(100) for n in parent}
    kids = {n: sum(p == n for p in parent.values()) for n in parent}
    total = {n: [int(not kids[n]), value[n]] for n in parent}
    for n in sorted(parent, reverse=True):
        if parent[n] is not None:
            total[parent[n]] = [a + b for a, b in zip(total[parent[n]], total[n])]
    nodes = spark.createDataFrame([(n, p, kids[n], int(not kids[n]), value[n]) for n, p in parent.items()],
                                  "n long, p long, kids long, leaves long, saved long")
    got = {r.n: [r.leaves, r.saved] for r in pt.contract(nodes).collect()}
    assert got == total
    assert pt.contract(nodes.limit(0)).count() == 0


def test_digests_of_many_ends(spark, monkeypatch):
    monkeypatch.setattr(pt, "IDS", 16)
    rows = [(c, 0, "u", "all the same") for c in range(0, 20_000, 100)]
    assert run(spark, rows) == plain_trie(rows)
