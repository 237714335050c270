"""Quality rules by weak supervision: rules vote or abstain, EM estimates how far each can be trusted.

Each rule votes LOW, HIGH or abstains on a document. The distinct vote patterns are counted over
all documents (at most 3 ** number of rules, whatever the table's size); expectation-maximisation
on that table estimates the share of good documents and, for each rule, how often it votes LOW or
HIGH on good and on bad ones. Abstaining says nothing, so a document without a LOW vote is judged by
the prior and its HIGH votes. A document is kept if its posterior probability of being good reaches
``threshold`` and the base rule does not fail it.

DataFrame functions only. The texts are read once; the features (numbers only) are cut off there.
Repeated 5-word windows are found by the 64-bit hashes of the windows; only a text that has a
repeat at all sorts them.

The list of function words is of four languages. Where it does not apply, its rule does not vote LOW: texts mostly in
letters outside the Latin script, rows whose ``lang`` is another language, and rows without a ``lang`` that hold no
listed word at all.

Defined cases: null and blank texts have no words and fail the base rule; texts of any length are
read whole; repeated rows get equal verdicts; an empty table gives an empty result; ``judge`` reads
``doc_id``, ``text`` and, if there, ``lang`` only and ``keep_good`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS, bind, cut_lineage, text_of, words_of

WINDOW = 5
#: The commonest function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in that is was it for on with as are by a this from be at or an have not which you "
    "der die das und von mit den ist zu im ein eine für auf nicht sich dem des als auch "
    "le la les de et un une que qui est dans pour des du en pas au avec sur "
    "el los las y del se por con una su para es no al lo").split()
LISTED_LANGS = ("en", "de", "fr", "es")


def repeat_words(words: Column) -> Column:
    """Words that lie in a 5-word window found twice or more in the text, the first one included."""
    def windows(h):
        n = F.size(h) - (WINDOW - 1)
        return F.transform(F.arrays_zip(*[F.slice(h, F.lit(k + 1), n).alias(f"w{k}") for k in range(WINDOW)]), lambda x: F.xxhash64(x))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    found = F.when(F.size(words) >= WINDOW, bind(hashes, windows)).otherwise(F.array().cast("array<bigint>"))

    def covered(at):
        return F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))),
                           F.lit(0), lambda a, x: a + x)

    def again(s):
        return F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1)))

    def pairs(s):
        same = F.transform(s, lambda x, i: F.when(
            (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"]))
        return F.array_sort(F.filter(same, lambda p: p.isNotNull()))

    def places(w, twice):
        """Positions of the windows that occur again: by search in a short list, else by sorting pairs."""
        few = F.filter(F.transform(w, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda p: p.isNotNull())
        ordered = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(twice) <= 16, few).otherwise(bind(ordered, pairs))

    def total(w):
        counted = bind(bind(F.sort_array(w), again), lambda twice: bind(places(w, twice), covered))
        return F.when(F.size(w) == F.size(F.array_distinct(w)), F.lit(0)).otherwise(counted)

    return bind(found, total).cast("long")


def features(docs: DataFrame, *carried: Column) -> DataFrame:
    """``carried`` columns and the numbers that the rules look at, from one pass over the texts."""
    given = [c.alias(f"_c{i}") for i, c in enumerate(carried)]
    names = [f"_c{i}" for i in range(len(given))]
    lang = F.lower(F.trim(text_of(docs, "lang")))
    listed = F.when(lang != "", F.regexp_extract(lang, "^[a-z]*", 0).isin(*LISTED_LANGS))
    rows = docs.select(*given, listed.alias("listed"), text_of(docs).alias("t"))
    rows = rows.select(*names, "listed", "t", words_of(F.col("t")).alias("w"),
                       F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD_CLASS)).alias("l"))

    def count(pattern):
        return (F.char_length("t") - F.char_length(F.regexp_replace("t", pattern, ""))).cast("long")

    return rows.select(
        *names, F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"), count(r"\p{Lu}+").alias("n_upper"), count("!").alias("n_marks"),
        F.size(F.filter("w", lambda w: w.isin(FUNCTION_WORDS))).cast("long").alias("n_function"),
        "listed", count(r"[\p{L}\p{M}&&[^\p{IsLatin}]]+").alias("n_other"),
    )


def rules() -> list[tuple[str, Column, Column]]:
    """``(name, votes LOW, votes HIGH)``; both false: the rule abstains."""
    n, chars = F.col("n_words"), F.col("word_chars")
    some, never = n >= 10, F.lit(False)
    applies = (F.col("n_other") * 2 <= chars) & F.coalesce(F.col("listed"), F.col("n_function") > 0)
    return [
        ("symbols", some & (F.col("n_symbols") * 10 > n), never),
        ("capitals", some & (F.col("n_upper") * 2 > chars), some & (F.col("n_upper") * 5 < chars)),
        ("marks", some & (F.col("n_marks") * 5 > n), never),
        ("repeats", some & (F.col("n_repeat_words") * 4 > n), never),
        ("lines", (F.col("n_lines") >= 4) & (F.col("n_dup_lines") * 2 > F.col("n_lines")), never),
        ("word_length", some & ((chars < n * 2) | (chars > n * 20)), some & (chars >= n * 3) & (chars <= n * 12)),
        ("function_words", applies & (n >= 40) & (F.col("n_function") * 100 < n), some & (F.col("n_function") * 20 >= n)),
    ]


#: Start and pseudo-counts of EM: shares of LOW and HIGH votes on bad and on good documents.
_START = {"low": (0.25, 0.01), "high": (0.45, 0.8), "good": 0.8}
_WEIGHT = 20.0
ROUNDS = 12


def _log_odds(names: list[str], model: dict) -> Column:
    total = F.lit(math.log(model["good"] / (1 - model["good"])))
    for name in names:
        low, high = model[name]
        vote = F.col(f"v_{name}")
        total = total + F.when(vote < 0, math.log(low[1] / low[0])).when(vote > 0, math.log(high[1] / high[0])).otherwise(0.0)
    return total


def _posterior(names: list[str], model: dict) -> Column:
    return 1 / (1 + F.exp(-_log_odds(names, model)))


def estimate(votes: DataFrame, names: list[str], rounds: int = ROUNDS) -> dict:
    """EM over the table of vote patterns. One small aggregation and one row to the driver a round.

    A rule's LOW vote is never taken as a sign of quality, nor its HIGH vote as one against: the
    shares are held to that order.
    """
    patterns = cut_lineage(votes.groupBy(*[f"v_{n}" for n in names]).agg(F.count("*").alias("n")).coalesce(1))
    model = {"good": _START["good"]} | {n: (_START["low"], _START["high"]) for n in names}
    for _ in range(rounds):
        p = patterns.withColumn("g", F.col("n") * _posterior(names, model)).withColumn("b", F.col("n") - F.col("g"))
        sums = [F.sum("n").alias("all"), F.sum("g").alias("good")]
        for name in names:
            for vote, sign in (("low", -1), ("high", 1)):
                for who in "bg":
                    sums.append(F.sum(F.when(F.col(f"v_{name}") == sign, F.col(who)).otherwise(0.0)).alias(f"{name}_{vote}_{who}"))
        got = p.agg(*sums).first()
        if not got["all"]:
            return model
        good, bad = got["good"], got["all"] - got["good"]
        model = {"good": min(0.98, max(0.5, (good + _WEIGHT * _START["good"]) / (got["all"] + _WEIGHT)))}
        for name in names:
            share = {v: [(got[f"{name}_{v}_{w}"] + _WEIGHT * _START[v][i]) / (size + _WEIGHT) for i, (w, size) in enumerate((("b", bad), ("g", good)))]
                     for v in ("low", "high")}
            low, high = share["low"], share["high"]
            model[name] = ((max(low), min(low)), (min(high), max(high)))
    return model


def _voted(rows: DataFrame) -> DataFrame:
    for name, low, high in rules():
        rows = rows.withColumn(f"v_{name}", F.when(low, F.lit(-1)).when(high, F.lit(1)).otherwise(F.lit(0)))
    return rows


def _verdict(rows: DataFrame, model: dict, threshold: float) -> DataFrame:
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    names = [n for n, _, _ in rules()]
    return (rows.withColumn("base_failed", failed).withColumn("posterior", _posterior(names, model))
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: the features, ``base_failed``, each rule's vote, ``posterior`` and ``kept``."""
    rows = cut_lineage(_voted(features(docs, F.col("doc_id"))).withColumnRenamed("_c0", "doc_id"))
    return _verdict(rows, estimate(rows, [n for n, _, _ in rules()]), threshold)


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    The estimated rules are a few numbers, so the verdict is worked out again beside each row: the texts are
    read twice and never shuffled.
    """
    names = [n for n, _, _ in rules()]
    model = estimate(_voted(features(docs)).select(*[f"v_{n}" for n in names]), names)
    # a field that is not deterministic keeps the filter above the features, which are then worked out once
    rows = features(docs, F.struct(*[docs[c] for c in docs.columns])).withColumn("part", F.spark_partition_id())
    return _verdict(_voted(rows), model, threshold).where(F.col("kept") & (F.col("part") >= 0)).select("_c0.*")
