"""Periodic runs against a plain search over all periods."""

import hashlib
import random

import numpy as np
import pytest

from tests.llm.helpers import SF, WORD, odd_documents, table
from tidepool.llm import periodic_runs as pr
from tidepool.llm import queries as Q


def plain_runs(x, min_length=6, min_periods=4):
    """(start, length, period) by start, then period."""
    out = {}
    for q in range(1, len(x) // min_periods + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_periods * q):
                out.setdefault((i, j + q), q)       # a multiple of a period spans the same words
            i = max(j, i) + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(x, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(x) if i not in gone]


def random_words(rng):
    k = rng.choice([1, 2, 3, 6, 40])
    x = [rng.randrange(k) for _ in range(rng.randint(0, 120))]
    for _ in range(rng.randint(0, 3)):
        p, at = rng.randint(1, 12), rng.randint(0, len(x))
        w = [rng.randrange(max(2, k)) for _ in range(p)]
        x[at:at] = (w * 9)[:rng.randint(2, 8 * p)]
    return x


@pytest.mark.parametrize("limits", [(6, 4), (1, 4), (12, 5)])
def test_runs_of_random_documents(limits):
    rng = random.Random(3)
    for _ in range(80):
        docs = [random_words(rng) for _ in range(rng.randint(1, 12))]
        docs += docs[:rng.randint(0, 3)]            # copies share the grammar
        ids = np.array([v for d in docs for v in d], np.int64)
        got = pr.find_runs(ids, np.array([len(d) for d in docs], np.int64), *limits)
        want, at = [], 0
        for d in docs:
            want += [(at + s, n, q) for s, n, q in plain_runs(d, *limits)]
            at += len(d)
        assert list(zip(*[v.tolist() for v in got])) == want, docs


def test_grammar_derives_its_documents():
    rng = random.Random(4)
    docs = [random_words(rng) for _ in range(20)]
    ids = np.array([v for d in docs for v in d], np.int64)
    g = pr.Grammar(ids, np.array([len(d) for d in docs]))

    def derive(s):
        return [s] if s < g.first else derive(g.left[s - g.first]) + derive(g.right[s - g.first])

    assert [w for s in g.sequence for w in derive(s)] == ids.tolist()
    assert len(g.sequence) < len(ids)
    rules, places = g.all_places(np.arange(len(g.left)))
    for r, p in zip(rules.tolist(), places.tolist()):
        assert derive(g.first + r) == ids[p:p + g.length[g.first + r]].tolist()
    assert set(zip(range(len(g.left)), g.one_place().tolist())) <= set(zip(rules.tolist(), places.tolist()))


def test_long_periodic_and_overlap_free_documents():
    x = np.array([bin(i).count("1") & 1 for i in range(1 << 13)])       # no run at all
    assert len(pr.find_runs(x, np.array([len(x)]))[0]) == 0
    for x, q in ((np.zeros(50_000, np.int64), 1), (np.tile(np.arange(977), 9), 977)):
        assert [v.tolist() for v in pr.find_runs(x, np.array([len(x)]))] == [[0], [len(x)], [q]]


def test_misled_hashes_are_noticed(monkeypatch):
    """With hashes that call everything equal the words themselves decide."""
    ids = np.array([1, 2] * 10 + list(range(3, 40)))
    n, m, e = np.array([0]), np.array([8]), np.array([len(ids)])
    right = pr.crossing_runs(ids, n, m, e, 6, 4)
    assert right[1:].T.tolist() == [[0, 20, 2]]
    monkeypatch.setattr(pr.Stretches, "equal", lambda self, a, q, size: np.ones(len(a), bool))
    assert pr.crossing_runs(ids, n, m, e, 6, 4) is None


def test_odd_rows(spark):
    docs = odd_documents(spark, "n_words int, runs string, collapsed string, _c0 string, shard int")
    extra = [(50, "a " * 40, "en", "a"), (51, "x " + "a b " * 9 + "a y\tz", "en", "a"), (None, "a b c " * 500, None, None)]
    docs = docs.unionByName(spark.createDataFrame([(*r, 7, "k", "c", "t", 9) for r in extra], docs.schema))
    out = pr.collapse_runs(docs)
    assert out.columns == [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")] + ["n_words", "runs", "collapsed"]
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        x = WORD.findall(r.text or "")
        want = plain_runs(x)
        assert (r.n_words, [tuple(v) for v in r.runs], r.collapsed) == (len(x), want, " ".join(collapsed(x, want)))
    assert pr.collapse_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pr.collapse_runs(docs, min_periods=3)


def test_query(spark):
    """Digests of the query against the plain search, with the planted order of words."""
    docs = table(spark, "documents").limit(60).collect()
    got = {r.doc_id: r for r in Q.op12_runs(spark, SF).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in docs:
        w = WORD.findall(d.text or "")
        x = [w[i] for i in Q.planted_order(d.doc_id, len(w))]
        runs = plain_runs(x) if len(x) < 1500 else None
        r = got[d.doc_id]
        if runs is None:
            continue
        best = min(runs, key=lambda v: (-v[1] / v[2], v[0], v[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs))
        assert r.collapsed_sha256 == sha(" ".join(collapsed(x, runs)))
