"""Prefix token counts against the vocabulary's own library, prefix by prefix."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SF, odd_documents, table
from tidepool.llm import queries as Q
from tidepool.llm import token_counts as tc

FILE = Q.rank_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return tc.Counter(tc.load(FILE))


ODD = ["", "abc<|endoftext|>def <|startoftext|><|endoftext", "It's THE'RE they're ''re !!'s don't 'LL'", "ΑΣ ΟΔΟΣ ς İstanbul",
       "été Å ﬁ", "한가", "ạ̧́b", "ꟛx ՘y 1̀",
       "\x1c\x85  a　b \x00c", "1234 12a b3 ² Ⅷ_x", "日本語テキスト", "x'ŕe 'r" + "é", "😀👍🏽é're", "ź" * 30 + "'s",
       "word" * 60, "a" * 3000]


def test_every_prefix_as_the_library_counts_it(counter, library):
    rng = random.Random(1)
    alphabet = "abeЖé'̧́ 1.!<|>endoftxsrΣİ각ꟛ՘\n"
    cases = [t[:300] for t in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    for text in cases:
        assert counter.prefixes(text) == [library(text[:i]) for i in range(1, len(text) + 1)], repr(text)


def test_words_learned_together_equal_words_one_by_one(counter):
    words = {w for w in "the then there ding dingo été étéé ß1 'tis qqqq日本 ẞ abcabcabc".split()}
    batch = tc.Counter(tc.load(FILE))
    batch.learn(words)
    assert len(batch.table) == len(words)
    for w, steps in list(batch.table.items()):
        assert steps == counter.word_steps(w), w


def test_pairs_against_merging(counter):
    rng = random.Random(2)
    tokens = sorted(counter.open.values())
    closed = sorted(counter.closed.values())
    for _ in range(3000):
        a, b = rng.choice(tokens), rng.choice(tokens + closed)
        plain = counter.merged(counter.symbols(a) + counter.symbols(b)) == [a, b]
        assert counter.may_follow(a, b) == plain
        assert (counter.may_follow(-1, b)) == (counter.merged(counter.symbols(b)) == [b])


def test_odd_rows(spark, library):
    docs = odd_documents(spark, "n_tokens int, prefix_tokens string, _c0 int, _c1 string, shard int")
    docs = docs.unionByName(spark.createDataFrame([(100 + i, t, None, None, 7, "k", 8, "t", 9) for i, t in enumerate(ODD)], docs.schema))
    out = tc.prefix_counts(docs, tc.load(FILE))
    assert out.columns == [c for c in docs.columns if c != "prefix_tokens"] + ["prefix_tokens"]
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r.text or ""
        assert len(r.prefix_tokens) == len(text) + 1 and r.prefix_tokens[0] == 0
        assert r.prefix_tokens[-1] == library(text)
        for i in {len(text) // 3, len(text) // 2}:
            assert r.prefix_tokens[i] == library(text[:i])
    assert tc.prefix_counts(docs.limit(0), tc.load(FILE)).count() == 0


def test_budgets(spark, library):
    texts = [(i, t) for i, t in enumerate(["", "They're ding dong dell, ça va? été", "a b c d e f", "<|endoftext|> after", None])]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    out = tc.prefix_counts(docs, tc.load(FILE)).cache()
    for budget in (0, 1, 3, 5, 100):
        got = out.select("text", tc.longest_prefix(F.col("prefix_tokens"), F.lit(budget)).alias("cut"),
                         tc.fits(F.col("prefix_tokens"), F.lit(budget)).alias("fits"),
                         tc.tokens_of_prefix(F.col("prefix_tokens"), F.lit(budget)).alias("n")).collect()
        for r in got:
            text = r.text or ""
            assert r.cut == max(i for i in range(len(text) + 1) if library(text[:i]) <= budget)
            assert r.fits == (library(text) <= budget) and r.n == library(text[:budget])


def test_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in table(spark, "documents").collect()}
    out = Q.op13_tokens(spark, SF)
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    rows = out.collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = library(docs[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)
