"""Small tables that every operator must take: nulls, empty and long texts, ties, repeats, clashing names."""

import os
import random
import re

from pyspark.sql import types as T

SF = os.environ.get("LLM_TEST_SF", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use for columns of their own.
CLASHES = ["size", "key", "n", "row", "part", "shard", "taken", "label", "score", "w", "t", "l", "uid", "cell", "next", "s", "kept"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHES])


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = "the of and river stone lamp garden which moved under bright quiet machine paper from to in".split()
    return " ".join(r.choice(words) + r.choice(["", "", "s", "ing", "ed"]) for _ in range(n))


def edge_rows() -> list[tuple]:
    base = prose(1, 60)
    near = base.split()
    near[-1] = "other"
    texts = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", None), (3, " ".join(near), "en", None),
        (4, None, None, None), (5, "", "en", "b"), (6, " \n\t ", "en", "b"), (7, "one two", "en", "b"), (8, "one two", "en", "c"),
        (9, prose(2, 20000), "en", "c"), (10, "x" * 50000, "en", "c"), (11, "Straße été 漢字 😀 naïve", "de", "d"),
        (None, prose(3, 30), "en", "d"), (None, prose(4, 30), "en", "d"), (12, prose(5, 40), None, ""),
        (13, "mail me: a.b@c.example.org or +1 (555) 010-9999, 4111 1111 1111 1111, 10.0.0.255. MIT License", "en", "e"),
        (14, "MIT-License, apache license; GNU General Public License! general public license", "en", "e"),
        (15, "▁ mark▁s and  two  blanks ", "en", "e"), (15, prose(6, 25), "en", "e"),
        (16, "SO!! LOUD!! " * 30, "en", "f"), (17, "spam*** a%%% b$$$ c&&& " * 10, "en", "f"),
    ]
    return [(*t, None if t[1] is None else len(t[1]), *["x"] * len(CLASHES)) for t in texts]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
