"""Decontamination, SimHash, substring dedup, quality, toxicity, sharding on
odd frames, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from tests.llm.helpers import SF, WORD, collect, lower, odd_documents, table
from tidepool.llm import decontaminate, quality, sharding, simhash, substring, toxicity
from tidepool.llm import queries as Q

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# --- benchmark decontamination ---------------------------------------------------

def plain_hits(docs, bench, n=13):
    wins = defaultdict(set)
    for item, text in bench:
        w = ALNUM.findall(lower(text))
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            wins[tuple(w[i:i + k])].add(item)
    out = []
    for doc, text in docs:
        w = ALNUM.findall(lower(text))
        hit, items = set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                found = wins.get(tuple(w[i:i + k]))
                if found:
                    hit |= set(range(i, i + k))
                    items |= {str(x) for x in found if x is not None}
        out.append((doc, len(w), len(hit), tuple(sorted(items))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontaminate_odd_rows(spark, limit):
    docs = odd_documents(spark, "n_words int, hit_items string, _uid int, _w string, shard int")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    texts = [r[1] for r in rows if r[1]]
    bench = [(1, texts[0]), (2, "one"), (3, None), (4, ""), (5, "two three FOUR"), (None, texts[1]), (6, texts[0]), (7, "absent here")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.find_hits(docs, b, max_broadcast_grams=limit)
    got = sorted([(r.doc_id, r.n_words, r.n_hit, tuple(r.hit_items)) for r in got.collect()], key=repr)
    assert got == plain_hits(rows, bench)


def test_decontaminate_empty(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.find_hits(docs, none).collect()} == {0}
    assert decontaminate.find_hits(docs.limit(0), none).count() == 0
    some = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontaminate.find_hits(docs.limit(0), some).count() == 0


def test_decontaminate_spans(spark):
    docs = spark.createDataFrame([(1, "x one two three y"), (2, "clean text!")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "ONE, two; three")], "item_id long, text string")
    out = decontaminate.remove_spans(decontaminate.find_hits(docs, b)).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["x y", "clean text!"]


def test_op3_tables(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    bench = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    want = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0 and 20 * h >= n)
            for d, n, h, i in plain_hits(docs, bench)]
    assert collect(Q.op3_decontaminate(spark, SF)) == sorted(want, key=repr)


# --- SimHash ---------------------------------------------------------------------

def plain_fingerprint(text):
    w = WORD.findall(lower(text))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    n = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(grams))


def plain_roots(fps):
    fps = sorted(set(fps))
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_simhash_odd_rows(spark):
    docs = odd_documents(spark, "fingerprint int, component_id string, _fp int, _id string, v int")
    rows = docs.collect()
    fp = [plain_fingerprint(r.text) for r in rows]
    root = plain_roots(fp)
    first = {}
    for r, f in zip(rows, fp):
        if r.doc_id is not None:
            first[root[f]] = min(first.get(root[f], r.doc_id), r.doc_id)
    want = sorted([(r.doc_id, f"{f:016x}", first.get(root[f])) for r, f in zip(rows, fp)], key=repr)
    assert collect(simhash.near_duplicates(docs)) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(root.values()))
    assert simhash.keep_one(docs.limit(0)).count() == 0 == simhash.near_duplicates(docs.limit(0)).count()


@pytest.mark.parametrize("hot", [512, 3])
def test_links_find_every_pair(spark, hot):
    rng = random.Random(3)
    fps = {0, 1 << 63, (1 << 64) - 1}
    for _ in range(60):
        at = rng.getrandbits(64)
        for _ in range(6):
            f = at
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3])):
                f ^= 1 << b
            fps.add(f)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << a) for a in range(64)} | {centre ^ (1 << a) ^ (1 << 40) for a in range(30)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "_fp long")
    want = sorted((min(signed(a), signed(b)), max(signed(a), signed(b)))
                  for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2)
    assert sorted(map(tuple, simhash.links(df, hot=hot).collect())) == want


def test_components_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [(min(a, b), max(a, b)) for a, b in zip(order, order[1:])] + [(1000, 1001)]
    got = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}


# --- substring dedup ---------------------------------------------------------------

def plain_repeats(rows, k=13):
    big = float("inf")
    first = {}
    for doc, text in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - k + 1):
            key = tuple(w[i:i + k])
            first[key] = min(first.get(key, big), big if doc is None else doc)
    out = []
    for doc, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i:i + k])] < (big if doc is None else doc):
                gone |= set(range(i, i + k))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("k", [13, 1, 2, 5, 30])
def test_substring_odd_rows(spark, k):
    docs = odd_documents(spark, "n_words int, n_removed string, _id int, _th string, _s int")
    got = substring.remove_repeats(docs, min_words=k)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted([(r.doc_id, r.n_words, r.n_removed, " ".join(WORD.findall(r.text or ""))) for r in got.collect()],
                  key=repr) == plain_repeats(rows, k)


def test_substring_keeps_clean_texts(spark):
    docs = spark.createDataFrame([(1, "a  b\n\nc " * 2), (2, None), (3, "")], "doc_id long, text string")
    assert collect(substring.remove_repeats(docs).select("doc_id", "text")) == collect(docs)
    assert substring.remove_repeats(docs.limit(0)).count() == 0
    assert substring.levels(13) == [7, 13] and substring.levels(50) == [7, 13, 25, 50] and substring.levels(1) == [1]


@pytest.mark.parametrize("k,bits", [(13, 3), (60, 64), (60, 4), (200, 64)])
def test_substring_levels_and_collisions(spark, k, bits):
    """Passages that are repeated for some lengths only; and a first hash of a
    few bits, under which nearly all windows look repeated, removes nothing more."""
    rng = random.Random(k)
    vocab = [f"w{i}" for i in range(400)]
    make = lambda n: rng.choices(vocab, k=n)
    shared = make(260)
    rows = []
    for i in range(60):
        n = rng.choice([5, 8, 14, 30, 59, 60, 61, 120, 199, 200, 230])
        at = rng.randrange(260 - n)
        rows.append((i, " ".join(make(rng.randrange(40)) + shared[at:at + n] + make(rng.randrange(40)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring.remove_repeats(docs, min_words=k, bits=bits)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, " ".join(WORD.findall(r.text))) for r in got.collect()],
                  key=repr) == plain_repeats(rows, k)


def test_substring_many_texts_of_one_id(spark):
    """Thousands of different texts without an id, and of one id: each is cut at its own words only."""
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(5000)]
    make = lambda n: " ".join(rng.choices(vocab, k=n))
    shared = [make(15) for _ in range(40)]
    rows = [(i, s) for i, s in enumerate(shared)]
    for i in range(6000):
        cut = f"{make(rng.randrange(20))} {rng.choice(shared)} " if i % 2 else ""
        rows.append((None if i % 3 else 7777, cut + make(40)))
    rows += rows[-50:] + [(None, None), (7777, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = substring.remove_repeats(docs)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, " ".join(WORD.findall(r.text or ""))) for r in got.collect()],
                  key=repr) == plain_repeats(rows)


@pytest.mark.parametrize("stage", [False, True])
def test_substring_shuffles_texts_once(spark, stage):
    """The last level and the cut read one shuffle of the texts."""
    import corpus_pipeline as C
    from tidepool.llm import queries as Q

    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = C.cut_repeats(spark, table(spark, "documents"), SF) if stage else Q.op6_substring(spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("ReusedExchange") == 1 and plan.count("documents.parquet") == 1


# --- quality -------------------------------------------------------------------------

def plain_counts(text):
    w = WORD.findall(text or "")
    wins = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    rep = set()
    for i in range(len(w) - 7):
        if wins[tuple(w[i:i + 8])] > 1:
            rep |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(rep))


def test_quality_counts(spark):
    texts = [None, "", " \n", "a b c d e f g h a b c d e f g h", "x " * 9, "x " * 8, "# a\n# a\n\n\nb*", "é ß |\vq",
             "p q r s t u v w p q r s t u v w p q r z p q r s t u v w"]
    for t in texts:
        assert quality.text_counts(t)[:5] == plain_counts(t)


def test_quality_odd_rows(spark):
    docs = odd_documents(spark)
    got = quality.judge(docs)
    rows = got.collect()
    assert len(rows) == docs.count() and got.columns.count("n_words") == 1 and got.columns.count("kept") == 1
    assert all(not r.kept for r in rows if r.base_failed)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in rows)
    assert quality.judge(docs.limit(0)).count() == 0


def test_quality_adapts(spark):
    """The same text is usual in one source and an outlier in another."""
    plain = [(i, " ".join(f"word{(i * 7 + j) % 97}" for j in range(60)), "en", "s1") for i in range(300)]
    table_ = [(1000 + i, " ".join(f"word{(i * 5 + j) % 89} |" for j in range(60)), "en", "s2") for i in range(300)]
    odd = [(5000, table_[0][1], "en", "s1")]
    docs = spark.createDataFrame(plain + table_ + odd, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert not kept.pop(5000) and all(kept.values())


def test_quality_bounds_differ_in_every_metric(spark):
    """No threshold is the same in both groups, and the one of repeats rejects
    a text that the base rules let pass."""
    def text(i, rough):
        ws = [f"word{(i * 7 + j * 3) % 97}" for j in range(60)]
        if not rough:
            return " ".join(ws)
        ws = [w.upper() + "xyzxyz" + " #" * (j % 4 == 0) for j, w in enumerate(ws)]
        return " ".join(ws + ws[:9]) + "\nend of it\nend of it" + "\nand so on" * (1 + i % 3)

    docs = [(i, text(i, False), "en", "s1") for i in range(400)] + [(1000 + i, text(i, True), "de", "s2") for i in range(400)]
    ws = text(1, False).split()
    docs.append((5000, " ".join(ws + ws[:8]), "en", "s1"))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    a, b = quality.thresholds(quality.sketches(quality.with_counts(df))).collect()
    assert all(a[f"{m}_hi"] != b[f"{m}_hi"] for m in quality.METRICS)
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert got[5000].n_repeat_words == 16 and not got[5000].base_failed and not got[5000].kept
    assert all(r.kept for i, r in got.items() if i != 5000)


# --- toxicity ---------------------------------------------------------------------------

def labelled(spark):
    rng = random.Random(2)
    plain = [f"word{i}" for i in range(80)]
    rows = []
    for i in range(600):
        w = [rng.choice(plain) for _ in range(40)]
        bad = i % 3 == 0
        if bad:
            for j in rng.sample(range(40), 3):
                w[j] = rng.choice(["grobbel", "Snarkle", "yuckom"])
        elif i % 7 == 0:
            w[5:7] = ["grobbel", "garden"]
        rows.append((i, " ".join(w), int(bad), "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string")


def test_toxicity(spark):
    data = labelled(spark)
    lex = toxicity.learn(data.filter("doc_id % 3 <> 0 or doc_id % 2 = 0"), exceptions=["snarkle day"])
    assert any("grobbel".startswith(t) for t in lex.terms) and "grobbel garden" in lex.exceptions
    probe = spark.createDataFrame(
        [(1, "word1 word2 gr0bbel and grоbbel " + "word3 " * 20, 0), (2, "word1 word2 " * 15, 0), (3, None, 0), (4, "", 0),
         (5, "a snarkle day " + "word5 " * 20, 0), (6, "ＳＮＡＲＫＬＥ yuck0m grobbel", 0), (6, "ＳＮＡＲＫＬＥ yuck0m grobbel", 0),
         (7, "word1 " * 30000, 0)], "doc_id long, text string, score int")
    got = {r.doc_id: r.score for r in toxicity.score(probe, lex).collect()}
    assert min(got[1], got[6]) > 0.5 and max(got[i] for i in (2, 3, 4, 5, 7)) < 0.5
    assert all(0 <= s <= 1 for s in got.values())


def test_toxicity_without_labels(spark):
    none = toxicity.learn(labelled(spark).limit(0))
    one = toxicity.learn(labelled(spark).filter("toxic = 0"))
    assert none.terms == one.terms == {}
    assert {r.score for r in toxicity.score(odd_documents(spark), none).collect()} == {0.0}


def test_folding():
    assert toxicity.fold("St0p Ｗide ѕһоw a$$ !") == ["stop", "wide", "show", "ass", "i"]


# --- sharding ------------------------------------------------------------------------------

def check_shards(rows, shards):
    size, slots, texts = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        texts[r["text_crc32"]].add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(size) <= set(range(shards))
    return size, texts


@pytest.mark.parametrize("heavy", [False, True])
def test_shards_are_even(spark, heavy):
    rng = random.Random(4)
    rows = [(i, "t" * rng.randrange(1, 400) + str(i)) for i in range(6000)]
    if heavy:
        rows += [(10_000 + i, "the same text " * 10) for i in range(9000)]
    rows += [(20_000 + i, f"copy {i // 3}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(docs, 8).collect()
    assert len(got) == len(rows)
    size, texts = check_shards(got, 8)
    mean = sum(size.values()) / 8
    assert max(size.values()) < 1.03 * mean and min(size.values()) > 0.97 * mean
    copies = {zlib.crc32(f"copy {i}".encode()) for i in range(10)}
    assert all(len(texts[c]) == 1 for c in copies)


def test_shard_odd_rows(spark):
    docs = odd_documents(spark, "size int, slot string, _k1 int, _r string, shard int")
    got = sharding.shard(docs, 5).collect()
    check_shards(got, 5)
    want = sorted([(r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()))
                   for r in docs.collect()], key=repr)
    assert sorted([(r["doc_id"], r["size"], r["text_crc32"]) for r in got], key=repr) == want
    assert sharding.shard(docs.limit(0), 5).count() == 0


def test_boundaries_cut_heavy_keys():
    import numpy as np
    keys = [(1, i) for i in range(90)] + [(2, i) for i in range(10)]
    cuts = sharding.boundaries(keys, 10)
    assert cuts[0] == (1, sharding.FIRST) and len(cuts) >= 8 and cuts == sorted(set(cuts))
    got = sharding.range_of(np.array([0, 1, 1, 2]), np.array([5, 0, 50, 3]), np.array(cuts))
    assert got[0] == 0 and got[1] == 1 and 1 < got[2] <= len(cuts) and got[3] >= got[2]


def test_toxicity_labels_chosen_alone_give_the_same_lexicon(spark):
    """Choosing from the labels before the join changes nothing, also when only some are used."""
    docs = [(i, f"awful{i % 3} word{i} thing" if i % 4 == 0 else f"kind word{i} thing") for i in range(400)]
    labels = [(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (9999, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    l = spark.createDataFrame(labels, "doc_id long, toxic int")
    chosen = toxicity.choose(l, rows=120)
    assert chosen.count() < 260 and chosen.exceptAll(l).count() == 0
    one = toxicity.learn(d.join(l, "doc_id"), evidence=2.0)
    two = toxicity.learn(d.join(toxicity.choose(l), "doc_id"), evidence=2.0)
    assert one.terms == two.terms and one.curve == two.curve and one.terms
