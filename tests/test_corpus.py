"""Answers over all passages by their rarest signature, against a substring test of every pair."""

import numpy as np

from lodestar.operators import corpus as C
from lodestar.operators.qa import match_tokens


def _brute(answers, passages):
    import re
    norm = lambda t: " " + " ".join(re.findall(r"\w+|[^\w\s]", (t or "").lower())) + " "
    return {(q, p) for q, a in answers for p, t in passages if norm(a).strip() and norm(a) in norm(t)}


def test_answers_in_corpus(spark):
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    passages = [(i, " ".join(r.choice(words, r.integers(1, 40)))) for i in range(300)]
    # every answer starts with a pair that most passages hold: the first pair would send each answer to all of them
    passages = [(i, t + " in the " + words[i % 60] + " of x" + str(i % 50)) for i, t in passages]
    passages += [(1000, None), (1001, ""), (1002, "single"), (1003, "Single"), (1000, "in the w1 of x1")]
    answers = [(i, "in the " + words[i] + " of x" + str(i % 50)) for i in range(40)]
    answers += [(100, "single"), (101, "W3"), (102, "in the nowhere"), (103, ""), (104, None), (105, "in the"), (100, "in the w2"), (106, "single")]
    a = spark.createDataFrame(answers, "qid long, answer string")
    p = spark.createDataFrame(passages, "pid long, text string")
    got = [(x.qid, x.pid) for x in C.answers_in_corpus(a, p).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(answers, passages)


def test_rarest_signature_bounds_candidates(spark):
    passages = [(i, f"in the town of x{i % 50}") for i in range(1000)]
    answers = [(f" in the town of x{i} ",) for i in range(40)]
    p = spark.createDataFrame(passages, "pid long, text string").select("pid", match_tokens("text").alias("_d"))
    n = C.rarest_candidates(spark.createDataFrame(answers, "_a string"), p).count()
    assert n == 40 * 20         # the true pairs; by the first pair it would be 40 * 1000


def test_nothing(spark):
    a = spark.createDataFrame([], "qid long, answer string")
    p = spark.createDataFrame([(1, "x y")], "pid long, text string")
    assert C.answers_in_corpus(a, p).collect() == []
    assert C.answers_in_corpus(spark.createDataFrame([(1, "x")], a.schema), p.filter("pid > 1")).collect() == []
