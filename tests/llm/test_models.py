"""BPE, HTML extraction, URL filter, language model and pipeline, against
plain versions and held-out labels."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SF, WORD, lower, odd_documents, table
from tidepool.llm import bpe, html_extract, interpolation, url_filter
from tidepool.llm import queries as Q

# --- BPE ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.load_ranks(Q.rank_file())
    return ranks, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("dictionary", [0, 40])
def test_bpe_round_trip(spark, encoding, dictionary):
    ranks, pattern, reference = encoding
    texts = [None, "", " ", "\n\n  a\n", "Hello  world's  end ", "a" * 700, "naïve Ünïcödé 漢字 🎉\u200b\u2028x", "x\x1c y\x85z",
             "12345 6,78 <|endoftext|>", "tab\tsep  \t two", "Hello  world's  end "]
    docs = spark.createDataFrame([(i, t, "e", 5) for i, t in enumerate(texts)], "doc_id long, text string, ids string, _0 int")
    got = bpe.encode(docs, ranks, pattern, dictionary=dictionary)
    assert got.columns.count("ids") == 1 and "_0" in got.columns
    for r in got.withColumn("b", bpe.decode(F.col("ids"), ranks)).collect():
        t = texts[r.doc_id] or ""
        assert list(r.ids) == reference.encode_ordinary(t) and bytes(r.b) == t.encode()
    assert bpe.encode(docs.limit(0), ranks, pattern, dictionary=dictionary).count() == 0


def test_op7_tables(spark, encoding):
    _, _, reference = encoding
    texts = {r.doc_id: r.text or "" for r in table(spark, "documents").collect()}
    for r in Q.op7_bpe(spark, SF).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# --- HTML -------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>Head &amp; tail</h1><p>First   paragraph of the\n story, long enough to look like text.<p>Second one, with <b>bold
words</b> and &eacute;t&eacute;.<br>Line.</p><p>Short.</p><div class="ad">Buy this now</div><p>Last paragraph, which ends here.</p>
<section id="comments"><p>I like this a lot, thank you for the article.</p></section></article>
<aside><p>Related stories that nobody wants.</p></aside><form><label>Mail</label><input><button>Go</button></form>
<script>var t="</p>";</script><footer>&copy; 2024 Site</footer></body></html>"""
MAIN = ("Head & tail\nFirst paragraph of the story, long enough to look like text.\nSecond one, with bold words and été. Line.\n"
        "Short.\nLast paragraph, which ends here.")


def test_extract_page():
    assert html_extract.extract(PAGE, html_extract.PLAIN) == MAIN


def test_extract_without_marks():
    """No tag or class name says what is content; the text has to."""
    body = "".join(f"<p>This is sentence {i}, which tells a part of the story. It goes on for a while, as stories do.</p>" for i in range(5))
    links = "".join(f"<li><a href=x>Link {i}</a></li>" for i in range(8))
    got = html_extract.extract(f"<body><ul>{links}</ul><div>{body}</div><ul>{links}</ul></body>", html_extract.PLAIN)
    assert got.count("sentence") == 5 and "Link" not in got


@pytest.mark.parametrize("page", [None, "", "<", "<p", "plain", "<div><p>a</div></p></b>", "<script>x", "&am", "<!-- x", "<p>" * 3000,
                                  "<article>" + "<p>word and more words.</p>" * 3000])
def test_extract_tolerates(page):
    assert isinstance(html_extract.extract(page, html_extract.PLAIN), str)


STORY = "".join(f"<p>This is sentence {i}, which tells a part of the story. It goes on for a while, as stories do.</p>" for i in range(5))


@pytest.fixture(scope="module")
def learned(spark):
    return html_extract.train(table(spark, "pages"))


@pytest.mark.parametrize("wrapper", ['div class="layout has-sidebar"', 'div class="content-with-ads"', 'div class="tags-2 post"',
                                     'div class="comment-page"', 'div id="story-header-wrapper"', "form", "div"])
def test_wrappers_keep_their_article(learned, wrapper):
    got = html_extract.extract(f"<body><{wrapper}><div>{STORY}</div></{wrapper.split()[0]}></body>", learned)
    assert got.count("sentence") == 5


def test_inner_article_beats_outer_names(learned):
    page = f'<body><div class="sidebar"><article>{STORY}</article><p>Advertise with us</p></div></body>'
    for model in (learned, html_extract.PLAIN):
        assert html_extract.extract(page, model).count("sentence") == 5


def test_cut_moves_blocks_against_their_cost():
    """A short line between paragraphs costs more as content than as
    boilerplate, and a link line in an article reads like boilerplate although
    its names say content; neighbours decide."""
    page = f"<body><div>{STORY}<p>Later that day</p>{STORY}</div></body>"
    bs = html_extract.blocks(page)
    kept = html_extract.label(bs, html_extract.PLAIN)
    cost = [html_extract.PLAIN.cost(b, html_extract.features(b, i, len(bs))) for i, b in enumerate(bs)]
    assert kept.all() and cost[5] < 0 and sum(c < 0 for c in cost) == 1
    named = html_extract.blocks(f'<body><div>{STORY}<p class="menu story post">Later that day</p>{STORY}</div></body>')[5]
    assert html_extract.PLAIN.cost(named, html_extract.features(named, 5, 11)) != cost[5]


def test_pages_without_marks(spark, learned):
    """The article is found on pages whose article and navigation are plain
    divisions; the prose of an advert or a footer is told by its name alone."""
    import re

    found = lost = wrong = 0
    for r in table(spark, "pages").collect():
        main = [b.text for b in html_extract.blocks(r.html) if b.inside == 1]
        bare = re.sub(r"<(/?)(article|nav)\b", r"<\1div", r.html)
        got = html_extract.extract(bare, learned).split("\n")
        found += len(set(main) & set(got))
        lost += len(set(main) - set(got))
        wrong += len(set(got) - set(main))
    assert found > 0.98 * (found + lost) and wrong < 0.02 * found


def test_formula_stays_in_its_paragraph():
    got = html_extract.extract("<article><p>It holds that <math><mi>a</mi><mo>=</mo><mi>b</mi></math> for all of them.</p></article>", html_extract.PLAIN)
    assert got == "It holds that a=b for all of them."


@pytest.mark.parametrize("page", [lambda n: '<a "' * n, lambda n: "<div>" * n + "</p>" * n, lambda n: "<div>" * n + "x" + "</div>" * n,
                                  lambda n: "<div><p>a b" * n])
def test_extract_is_linear(page):
    import time

    def seconds(n):
        t = time.process_time()
        html_extract.blocks(page(n))
        return time.process_time() - t

    seconds(1000)
    assert seconds(40_000) < 4 * (4 * min(seconds(10_000) for _ in range(3))) + 0.2


def test_min_cut_is_minimal():
    rng = random.Random(7)
    for _ in range(40):
        n = rng.randrange(1, 8)
        s, t = (np.array([rng.choice([0, 0, rng.random() * 4]) for _ in range(n)]) for _ in range(2))
        edges = [(a, b, rng.random() * 2) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda side: (sum(t[i] if x else s[i] for i, x in enumerate(side))
                             + sum(c for a, b, c in edges if side[a] != side[b]))
        got = html_extract.min_cut(s, t, edges)
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(list(got)) == pytest.approx(best)


def test_op10_tables(spark, learned):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (2, None, None, "x"), (None, "v", "", "x")],
                                  "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text) for r in html_extract.main_text(pages, learned).collect())
    assert got == [(0, ""), (1, MAIN), (2, ""), (2, "")]
    assert html_extract.train(pages.limit(0)) is html_extract.PLAIN
    given = {r.page_id: r.html for r in table(spark, "pages").collect()}
    for r in Q.op10_html(spark, SF).collect():
        assert r.n_chars == len(r.text) and r.text == "\n".join(b.text for b in html_extract.blocks(given[r.page_id]) if b.inside == 1)


# --- URLs ----------------------------------------------------------------------------

def test_viterbi_splits():
    counts = {"casino": 50, "win": 40, "sin": 5, "in": 300, "free": 60, "bets": 20, "cas": 1, "bet": 30}
    find = lambda w: {(i, n): counts[w[i:i + n]] for i in range(len(w)) for n in range(1, len(w) - i + 1) if w[i:i + n] in counts}
    total = sum(counts.values())
    assert url_filter.viterbi("casinowin", find("casinowin"), total) == ["casino", "win"]
    assert url_filter.viterbi("freebets", find("freebets"), total) == ["free", "bets"]
    assert url_filter.viterbi("zzz", {}, total) == ["zzz"] and url_filter.viterbi("zz", {}, 0) == ["zz"]


def plain_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    import re
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    host = lower(host)
    best = None
    for verdict, h, p in Q.URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


def test_url_judge(spark):
    urls = [None, "", "nourl", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "x://example.com", "http://a.net/fr/b", "http://net/es/",
            "http://b.casinowin.example.com/en/9", "https://notexample.com/en/", "http://é.org/ä/1/2", "http://x.org?u=a://b/c",
            "http://a.net/fr/b", "http://-.-/--", "http://" + "ab" * 3000 + ".org/" + "x/" * 3000]
    rows = spark.createDataFrame([(i, u, "t", 1, "h") for i, u in enumerate(urls)],
                                 "page_id long, url string, tokens string, score int, host string")
    corpus = spark.createDataFrame([("casino win casino, win! free",), (None,), ("",)], "text string")
    got = {r.page_id: r for r in url_filter.judge(rows, corpus, Q.URL_RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, best = plain_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[0])
        assert got[i].verdict == best[1] if best else got[i].verdict == ("block" if got[i].score > 0 else "allow")
    assert got[8].tokens[:3] == ["h:b", "h:casino", "h:win"]
    assert url_filter.judge(rows.limit(0), corpus.limit(0), Q.URL_RULES).count() == 0


def test_url_bayes_matches_plain(spark):
    got = url_filter.judge(table(spark, "pages"), table(spark, "documents"), Q.URL_RULES).collect()
    known = [r for r in got if r.rule]
    n = Counter(r.verdict for r in known)
    count = {c: Counter(t for r in known if r.verdict == c for t in r.tokens) for c in ("block", "allow")}
    vocabulary = len(set(count["block"]) | set(count["allow"])) + 1
    p = lambda t, c: math.log((count[c][t] + 1) / (sum(count[c].values()) + vocabulary))
    near = [abs(math.log((n["block"] + 1) / (n["allow"] + 1)) + sum(p(t, "block") - p(t, "allow") for t in r.tokens) - r.score) < 1e-6
            for r in got]
    assert sum(near) > 0.9 * len(near)          # the rest have words that share a hash bucket


# --- language model ------------------------------------------------------------------

def plain_scores(rows, weights):
    toks = [WORD.findall(lower(t)) + [None] for _, t in rows]
    fold = [zlib.crc32(str(d).encode() if d is not None else b"") % 5 for d, _ in rows]
    uni, ctx, big = Counter(), Counter(), Counter()
    for f, ts in zip(fold, toks):
        if f != 1:
            uni.update(ts)
            prev = ["<s>"] + ts[:-1]
            ctx.update(prev)
            big.update(zip(prev, ts))
    n, v = sum(uni.values()), len(uni)
    out = []
    for (d, _), ts in zip(rows, toks):
        s = 0.0
        for h, w in zip(["<s>"] + ts[:-1], ts):
            a, b, c = weights[min(ctx[h].bit_length(), interpolation.MOST)]
            s += math.log10(a * (big[h, w] / ctx[h] if ctx[h] else 0) + b * uni[w] / n + c / (v + 1))
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts)
        out.append((d, len(ts), sum(uni[w] > 0 for w in ts), n, round(base, 6), round(s, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("known", [1 << 20, 30])
def test_interpolation_matches_plain(spark, monkeypatch, known):
    docs = table(spark, "documents").limit(120).select("doc_id", "text").unionByName(odd_documents(spark).select("doc_id", "text"))
    docs = docs.withColumns({"score": F.lit("x"), "_id": F.lit(1), "w": F.lit(2)}).persist()
    kept = []
    learn = interpolation.learn_weights
    monkeypatch.setattr(interpolation, "learn_weights", lambda *a: kept.append(learn(*a)) or kept[-1])
    fold = Q.fold_of(F.col("doc_id"), 5)
    got = interpolation.score(docs, fold != 1, fold == 0, known=known).collect()
    got = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got], key=repr)
    want = plain_scores([(r.doc_id, r.text) for r in docs.collect()], kept[0])
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], atol=1e-5)
    assert np.allclose(kept[0].sum(1), 1) and (kept[0][:, 2] > 0).all()


def test_interpolation_without_training(spark):
    docs = odd_documents(spark)
    got = interpolation.score(docs, F.lit(False), F.lit(False)).collect()
    assert len(got) == docs.count() and all(r.n_known == 0 and math.isfinite(r.score) for r in got)
    assert interpolation.score(docs.limit(0), F.lit(True), F.lit(False)).count() == 0


def test_interpolation_beats_base_on_held_out(spark):
    held = [r for r in Q.op9_interpolation(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_em_finds_the_mixture():
    rng = np.random.default_rng(1)
    p2, p1 = np.array([-10, -40, 1]), np.array([-40, -20, -60])
    value = lambda b: np.where(b == 1, 0.0, 10.0 ** (b / interpolation.STEP))
    p = np.column_stack([value(p2), value(p1), np.full(3, 1 / 1001)])
    n = np.array([400, 300, 300])
    hist = np.column_stack([np.full(3, 4), p2, p1, n])
    got = interpolation.learn_weights(hist, 1000)[4]
    best = max(((n * np.log(p @ np.array([a, b, 1 - a - b]))).sum(), a, b)
               for a in np.arange(0.01, 0.98, 0.02) for b in np.arange(0.01, 0.99 - a, 0.02))
    assert (n * np.log(p @ got)).sum() >= best[0] - 1e-3


# --- pipeline -----------------------------------------------------------------------

def test_pipeline_stages(spark, encoding):
    import corpus_pipeline as C
    from tests.llm.test_documents import plain_fingerprint, plain_hits, plain_repeats, plain_roots
    from tidepool.session import materialize

    docs = table(spark, "documents")
    columns, parts = docs.columns, [docs]
    for name, stage in C.STAGES:
        parts.append(materialize(stage(spark, parts[-1], SF), "test-pipeline"))
    assert all(p.columns == columns for p in parts[:-1])
    rows = [[(r.doc_id, r.text) for r in p.collect()] for p in parts[:-1]]
    scores = {r.doc_id: r.predicted for r in Q.op8_toxicity(spark, SF).collect()}
    assert sorted(rows[1]) == sorted(r for r in rows[0] if not scores[r[0]])
    root = plain_roots([plain_fingerprint(t) for _, t in rows[1]])
    first = {}
    for d, t in sorted(rows[1]):
        first.setdefault(root[plain_fingerprint(t)], d)
    assert sorted(d for d, _ in rows[2]) == sorted(first.values())
    want = [(d, kept) for d, _, _, kept in plain_repeats(rows[2])]
    assert sorted((d, " ".join(WORD.findall(t))) for d, t in rows[3]) == sorted(want)
    bench = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    clean = {d for d, n, h, _ in plain_hits(rows[3], bench) if not (h and 20 * h >= n)}
    assert sorted(rows[4]) == sorted(r for r in rows[3] if r[0] in clean)
    texts = dict(rows[4])
    last = parts[-1].collect()
    assert sorted(r.doc_id for r in last) == sorted(texts) and all(r.round_trip for r in last)
    assert all(list(r.ids) == encoding[2].encode_ordinary(texts[r.doc_id]) for r in last)


def test_pipeline_odd_and_empty(spark):
    import corpus_pipeline as C
    docs = odd_documents(spark, "n_words int, _c0 string, _fp int, score string, h int").withColumn("n_chars", F.lit(1).cast("long"))
    for some in (docs, docs.limit(0)):
        at = some
        for name, stage in C.STAGES:
            at = stage(spark, at, SF)
        at.collect()


def test_interpolation_counts_codes_beyond_23_bits():
    """A slice with so many different words that a (word, context) pair does not fit one packed number."""
    import numpy as np

    from tidepool.llm.interpolation import CODE_BITS, _distinct
    top = 1 << CODE_BITS
    rows = [(5, top + 2, 0), (4, 2, 0), (5, 2, 0), (top + 9, top + 1, 3), (5, top + 2, 0), (top + 9, 1, 3), (9, 1, 3)]
    code, h, doc = (np.array(x, np.uint64) for x in zip(*rows))
    got = list(zip(*(x.tolist() for x in _distinct(code, h, doc, top + 10))))
    assert got == [(*r, rows.count(r)) for r in sorted(set(rows))]
    small = [(c % 8, x % 8, d) for c, x, d in rows]
    code, h, doc = (np.array(x, np.uint64) for x in zip(*small))
    for codes in (8, top + 1):      # packed, and as for a large slice
        got = list(zip(*(x.tolist() for x in _distinct(code, h, doc, codes))))
        assert got == [(*r, small.count(r)) for r in sorted(set(small))]


def test_sorted_codes_travel_as_differences():
    rng = np.random.default_rng(3)
    codes = np.r_[np.sort(rng.integers(0, 1 << 20, 5000)), 7, 3].astype(np.uint32)      # copies come last, out of order
    got, = interpolation.unpack(interpolation.pack(interpolation.steps(codes)))
    assert (interpolation.restored(got) == codes).all()
    assert len(interpolation.pack(interpolation.steps(codes))) < 0.7 * len(interpolation.pack(codes))
    assert len(interpolation.restored(interpolation.steps(codes[:0]))) == 0


def test_encoding_and_decoding_load_no_pandas():
    import subprocess
    import sys

    code = "import sys, tidepool.llm.bpe; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0


def test_decoding_nulls_slices_and_empty_lists(spark):
    ranks = {b"a": 0, b"b": 1, b"\xff": 2}
    df = spark.createDataFrame([(i, x) for i, x in enumerate([[0, 1], None, [], [2, 2, 0]])], "i int, x array<int>")
    got = [r.t for r in df.select("i", bpe.decode(F.col("x"), ranks).alias("t")).orderBy("i").collect()]
    assert [None if t is None else bytes(t) for t in got] == [b"ab", None, b"", b"\xff\xffa"]


def test_plain_parts_split_as_the_pattern_does(encoding):
    import regex

    pattern = encoding[1]
    split = bpe._Splitter(pattern)
    parts = ["word", "Été,", "x", "straße).", "don't", "it's,", "'s", "a1", "", "naïve'", "ÿ×", "µm", "ªº", "a_b", "word\n", "漢字!", "ab́", "A…"]
    assert [split.after_space(p) for p in parts] == [regex.findall(pattern, " " + p) for p in parts]
    assert sum(split.plain(p) is not None for p in parts) >= 5
    other = bpe._Splitter(r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}|\s+")      # no form that is known: always matched
    assert not any(map(other.plain, parts)) and other.after_space("ab,c") == [" ab", ",c"]


def test_shipped_dictionary_tells_words_of_one_hash_apart():
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    words = ["the", " of", "é", "漢"]
    h = np.array([xxh64_intdigest(w.encode(), 42) for w in words], np.uint64)
    h[1] = xxh64_intdigest(b" zz", 42)      # as if both words had this hash
    ids = [[1], [2, 3], [4], []]
    known = bpe._Known(bpe._packed(pa.table({"h": h.view(np.int64), "b": pa.array([w.encode() for w in words], pa.binary()),
                                             "ids": pa.array(ids, pa.list_(pa.int32()))})))
    as_bytes = lambda x: np.array(x, "<i4").tobytes()
    assert known.ids_of(["é", " zz", "no", "the", "漢"]) == [as_bytes([4]), None, None, as_bytes([1]), b""]


def test_encoding_and_decoding_take_one_python_step_each(spark, encoding):
    """Each step is a worker of its own beside the others of its task."""
    ranks, pattern, _ = encoding
    docs = spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")

    def python_steps(plan):
        names = [plan.nodeName()] if "Arrow" in plan.nodeName() else []
        return names + [n for i in range(plan.children().size()) for n in python_steps(plan.children().apply(i))]

    assert python_steps(Q.op7_bpe(spark, SF)._jdf.queryExecution().executedPlan()) == ["ArrowEvalPython", "MapInArrow"]
    plan = bpe.encode(docs, ranks, pattern)._jdf.queryExecution()
    assert python_steps(plan.executedPlan()) == ["MapInArrow"]
    assert len(plan.toString()) < 200_000       # the driver keeps what describes a plan


def test_dictionary_travels_compressed():
    """The driver holds it several times over: as a table, as bytes and in a file."""
    import pyarrow as pa

    n = 20_000
    words = pa.table({"h": np.arange(n), "b": pa.array([b" word%d" % i for i in range(n)], pa.binary()),
                      "ids": pa.array([[i % 50_000, 7] for i in range(n)], pa.list_(pa.int32()))})
    assert len(bpe._packed(words)) < 0.6 * words.nbytes


def test_distinct_parts_are_split_together(encoding):
    """Plain parts, over a line's end as well, need no call of their own in Python."""
    import pyarrow as pa
    import regex

    pattern = encoding[1]
    plain = ["word", "Été,", "straße).", "end.\nNew", "a\nb,", "x'\ns"]
    odd = ["don't", "'s", "a1", "", "ÿ×", "word\n", "漢字!", "a\nb\nc", "a\n'll", "(a\nb", "a\r\nb", "a\n1", "µ\nx"]
    for form in (pattern, r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}|\s+", pattern.replace(r"|\s+(?!\S)", "")):
        split = bpe._Splitter(form)
        asked = []
        split.find = lambda text, find=split.find: asked.append(text) or find(text)
        words, codes, cuts = split.after_spaces(pa.array(plain + odd))
        got = [words.take(pa.array(codes[lo:hi])).to_pylist() for lo, hi in zip(cuts, cuts[1:])]
        assert got == [regex.findall(form, " " + x) for x in plain + odd]
        assert form != pattern or asked == [" " + x for x in odd]
        words, codes, cuts = split.after_spaces(pa.array([], pa.string()))
        assert len(words) == len(codes) == 0 and cuts.tolist() == [0]


def test_lost_words_stand_between_segments(encoding):
    from types import SimpleNamespace

    import pyarrow as pa

    ranks, pattern, reference = encoding
    texts = ["lost", "the lost", None, "", "lost lost the", " the", "the  the", "of the, lost, of\nthe of", "lost", "the\x1c of \u2003the", "of"]
    words = [" the", "the", " of", "of", ",", "\n", " "]
    for known in (words, []):
        shipped = pa.table({"b": pa.array([w.encode() for w in known], pa.binary()),
                            "ids": pa.array([reference.encode_ordinary(w) for w in known], pa.list_(pa.int32()))})
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["_0", "_t"])
        for limit in (8, 1 << 20):
            run = bpe._lookup(pattern, SimpleNamespace(value=bpe._packed(shipped)), limit)
            rows = [r for b in run([batch.slice(0, 3), batch.slice(3)]) for r in b.to_pylist()]
            assert [r["_0"] for r in rows] == list(range(len(texts)))
            for r, text in zip(rows, texts):
                assert len(r["_segs"]) == len(r["_rest"]) + 1 and not set(r["_rest"]) & set(known)
                ids = list(r["_segs"][0])
                for word, more in zip(r["_rest"], r["_segs"][1:]):
                    ids += reference.encode_ordinary(word) + more
                assert ids == reference.encode_ordinary(text or "")


def test_no_node_of_a_plan_writes_out_the_ranks(spark, encoding):
    """The driver keeps the description of each node of each run."""
    ranks, pattern, _ = encoding
    docs = spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")

    def longest(plan):      # as Spark describes nodes for its listeners
        fields = int(spark.conf.get("spark.sql.debug.maxToStringFields"))
        return max([len(plan.simpleString(fields)), *[longest(plan.children().apply(i)) for i in range(plan.children().size())]])

    got = longest(bpe.encode(docs, ranks, pattern)._jdf.queryExecution().executedPlan())
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert got < 100_000, got


def test_op7_batches_hold_few_bytes_of_long_texts(spark, encoding, tmp_path, monkeypatch):
    """Workers that encode and decode live at a time: each holds a few MB, not 2,000 texts of any length."""
    import uuid

    import pyarrow as pa

    _, _, reference = encoding
    seen = tmp_path / "seen"
    seen.mkdir()
    note = lambda kind, n, at=str(seen): open(f"{at}/{kind}-{uuid.uuid4().hex}-{n}", "x").close()
    lookup, decode = bpe._lookup, bpe.decode

    def noted_lookup(pattern, shared):
        def watch(batches):
            for b in batches:
                note("encode", b.nbytes)
                yield b

        run = lookup(pattern, shared)
        return lambda batches: run(watch(batches))

    def noted_decode(ids, ranks):
        @F.arrow_udf("array<int>")
        def watch(batch: pa.Array) -> pa.Array:
            note("decode", batch.nbytes)
            return batch

        return decode(watch(ids), ranks)

    monkeypatch.setattr(bpe, "_lookup", noted_lookup)
    monkeypatch.setattr(bpe, "decode", noted_decode)
    texts = {i: f"text {i}:" + " the cat sat on it" * 2_200 for i in range(250)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for r in Q.op7_bpe(spark, str(tmp_path)).collect():
        ids = reference.encode_ordinary(texts.pop(r.doc_id))
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert not texts
    for kind in ("encode", "decode"):
        held = [int(p.name.split("-")[-1]) for p in seen.glob(f"{kind}-*")]
        assert sum(held) > 9 << 20 and max(held) < 3 << 20, (kind, held)
