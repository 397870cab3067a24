"""Small frames and plain versions that the operators are held against."""

import os
import random
import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def table(spark, name):
    return spark.read.parquet(os.path.join(SF, f"{name}.parquet"))


def odd_documents(spark, extra="n_words int, kept string, _id int, _t string, shard int"):
    """Nulls, empty and long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["Été", "straße", "ÀB", "x y"]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    long = make(4000)
    shared = make(40)
    rows = [
        (1, make(30) + " " + shared, "en", "a"), (2, shared + "\n" + make(25), "en", "a"),
        (3, None, "en", None), (4, "", None, "a"), (5, "   \n\t ", "de", "b"), (6, "one", "de", "b"),
        (7, long, "en", "a"), (8, long + " " + shared, "en", "a"), (None, shared, None, None),
        (None, shared + " tail", None, None), (9, make(13), "de", None), (9, make(50), "de", None),
        (10, "Same line\nSame line\nother " + make(20), "en", "b"), (10, "Same line\nSame line\nother " + make(20), "en", "b"),
        (11, "ONE two Three four", "en", "a"), (12, "one TWO three four", "en", "a"),
    ]
    rows += [rows[0], rows[0], (13, rows[0][1], "en", "a"), (14, shared * 1, "en", "b")]
    cols = "doc_id long, text string, lang string, source string, " + extra
    return spark.createDataFrame([(*r, 7, "k", 8, "t", 9) for r in rows], cols)


def collect(df):
    return sorted(map(tuple, df.collect()), key=repr)
