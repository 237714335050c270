"""Corpus-wide answer matching (J8 over all passages, D15 without a ranking) by equi-joins on signatures.

A passage that holds an answer holds each of the answer's neighbouring token pairs (its one token, if there is no pair).
The signatures that answers ask for are looked up in the passages once and written as a postings table; its document
frequencies name each answer's rarest signature, and only passages with that one are checked as a whole. An
answer with a signature that stands nowhere is dropped at once. No automaton, no collect; keys are broadcast while they are few
(``session.SMALL_ROWS``), so that texts are not dealt out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, small
from .qa import match_tokens


def rarest_candidates(answers: DataFrame, passages: DataFrame, pid: str = "pid") -> DataFrame:
    """``(_a, pid)`` for distinct normalised answers ``answers(_a)`` and passages ``passages(pid, _d)``: passages that hold
    the signature of the answer that the fewest passages hold (ties: the least). A signature is a hash of its tokens, so that
    passages with another of the same hash may be among them."""
    words = F.filter(F.split(F.trim("_a"), " "), lambda w: w != "")
    sigs = cut(answers.select("_a", (F.size(words) == 1).alias("one"), F.posexplode(words).alias("at", "a"), F.get(words, F.col("at") + 1).alias("b"))
               .filter("one OR b IS NOT NULL").select("_a", "one", F.when(F.col("one"), F.xxhash64("a")).otherwise(F.xxhash64("a", "b")).alias("sig")).distinct())
    w = F.split(F.trim("_d"), " ")
    held = passages.select(pid, w.alias("a")).select(pid, F.inline(F.arrays_zip("a", F.slice("a", F.lit(2), F.size("a")).alias("b"))))
    kinds = [F.when(F.col("b").isNotNull(), F.xxhash64("a", "b"))]
    if sigs.agg(F.max("one")).first()[0]:       # single tokens are asked for
        kinds.append(F.xxhash64("a"))
    held = held.select(pid, F.explode(F.array(*kinds)).alias("sig"))
    postings = cut(held.join(small(cut(sigs.select("sig").distinct())), "sig", "left_semi").distinct())
    df = postings.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    least = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "sig")).alias("m")
    rarest = cut(sigs.join(df, "sig", "left").groupBy("_a").agg(least).filter("m.df > 0").select("_a", "m.sig"))
    return small(rarest).join(postings, "sig").select("_a", pid)


def answers_in_corpus(answers: DataFrame, passages: DataFrame, qid: str = "qid", answer: str = "answer",
                      pid: str = "pid", text: str = "text") -> DataFrame:
    """All ``(qid, pid)`` where a passage holds the answer as a token sequence (string mode). All passages are normalised for
    their signatures; only candidates are again, for the check."""
    a = cut(answers.select(qid, match_tokens(F.col(answer)).alias("_a")).filter(F.length(F.trim("_a")) > 0))
    p = passages.select(pid, match_tokens(F.col(text)).alias("_d"))
    met = cut(rarest_candidates(a.select("_a").distinct(), p, pid).distinct())
    asked = passages.join(small(cut(met.select(pid).distinct())), pid, "left_semi").select(pid, match_tokens(F.col(text)).alias("_d"))
    # coalesce: a test for null that Spark derives from a bare contains() would normalise every passage before the semi-join
    holds = F.coalesce(F.col("_d").contains(F.col("_a")), F.lit(False))
    return small(met).join(asked, pid).filter(holds).select("_a", pid).distinct().join(a, "_a").select(qid, pid).distinct()
