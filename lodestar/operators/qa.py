"""Answer matching and QA evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_level_hits(ranked: DataFrame, chunks: DataFrame, table_col: str = "table_id",
                     hit: str = "hit") -> DataFrame:
    """A ranked chunk is a table hit when any chunk of its table matches. The per-table flag is
    an aggregate (one row per table), joined back on ``table_id``."""
    per_table = chunks.groupBy(table_col).agg(F.max(F.col(hit).cast("int")).alias("_th"))
    return ranked.join(per_table, table_col, "left").withColumn("table_hit", F.coalesce(F.col("_th"), F.lit(0)) == 1).drop("_th")


# ---- encoder, retrieval results, answer matching ---------------------------------------------------

import re  # noqa: E402

import pandas as pd  # noqa: E402
from pyspark.sql import Column  # noqa: E402
from pyspark.sql.types import BooleanType  # noqa: E402

from ..functions.text import nfd, nfd_array, normalize_answer, tokenize  # noqa: E402

HEX = "0123456789abcdef"


def token_bucket(tok: Column, dim: int) -> Column:
    """Bucket of a token for the built-in test encoder: first two hex digits of its md5, mod dim."""
    m = F.md5(tok)
    h = (F.instr(F.lit(HEX), F.substring(m, 1, 1)) - 1) * 16 + (F.instr(F.lit(HEX), F.substring(m, 2, 1)) - 1)
    return (h % dim).cast("int")


def hashed_bag_weights(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """V29 built-in test encoder (sparse form): lower-cased tokens hashed into ``dim`` buckets,
    counts L2-normalised: ``(id, b, w)``. JVM-side: explode, one aggregate, a per-id window
    over at most ``dim`` rows for the norm (no lambdas: Catalyst would inline a norm computed
    outside a lambda into every element)."""
    from pyspark.sql import Window

    from .vectors import spread_scan
    toks = spread_scan(df.select(id_col, text_col)).select(id_col, F.explode(tokenize(F.lower(F.col(text_col)))).alias("_t"))
    counts = toks.groupBy(id_col, token_bucket(F.col("_t"), dim).alias("b")).agg(F.count(F.lit(1)).alias("_n"))
    norm = F.sqrt(F.sum(F.col("_n") * F.col("_n")).over(Window.partitionBy(id_col)))
    return counts.select(id_col, "b", (F.col("_n") / norm).alias("w"))


def encode_hashed_bag(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """V29 built-in test encoder (dense form): ``(id, embedding array<double>)`` of length ``dim``."""
    w = hashed_bag_weights(df, id_col, text_col, dim)
    g = w.groupBy(id_col).agg(F.collect_list(F.struct("b", "w")).alias("_bw"))      # <= dim entries

    def dense(m):       # the map as a variable: used inside a lambda, it would be made for each place
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0)))

    return g.select(id_col, F.element_at(F.transform(F.array(F.map_from_entries("_bw")), dense), 1).alias("embedding"))


def results_with_passages(ranked: DataFrame, passages: DataFrame, pid: str = "pid") -> DataFrame:
    """Ranked hits joined to their passage fields (equi-join on the id)."""
    return ranked.join(passages, pid)


def match_tokens(text: Column) -> Column:
    """String-mode form of a text: NFD, tokens lower-cased, joined and padded by single spaces.
    A token sequence occurs in a text exactly when its padded form is a substring of this."""
    toks = tokenize(nfd(text), lower=True)
    return F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))


@F.pandas_udf(BooleanType())
def _regex_any(texts: pd.Series, patterns: pd.Series) -> pd.Series:
    import functools
    import unicodedata

    @functools.lru_cache(4096)
    def compiled(pattern):      # once for each pattern of a batch
        try:
            return re.compile(unicodedata.normalize("NFD", pattern), flags=re.IGNORECASE | re.UNICODE | re.MULTILINE)
        except Exception:  # noqa: BLE001 - an invalid pattern is "no match"
            return None

    def one(text, pats):
        if text is None or pats is None:
            return False
        t = unicodedata.normalize("NFD", text)
        return any(rx is not None and rx.search(t) is not None for rx in map(compiled, pats))
    return pd.Series([one(t, p) for t, p in zip(texts, patterns)])


def answer_in_passage(pairs: DataFrame, mode: str = "string", text: str = "text", answers: str = "answers",
                      out: str = "has_answer", empty_matches: bool = False) -> DataFrame:
    """Does the passage hold any of the answers?

    * ``string``: NFD, token sequence of the answer occurs in the passage tokens (lower-cased);
    * ``regex``: any answer pattern found (NFD, case-insensitive, multiline); a bad pattern is no match;
    * ``kilt``: normalised answer is a substring of the normalised passage (no NFD).
    Answers with no tokens never match unless ``empty_matches``."""
    if mode == "string":
        pairs = pairs.withColumn("_doc", match_tokens(F.col(text))).withColumn("_ans", nfd_array(F.col(answers)))
        ans = F.transform(F.col("_ans"), lambda a: F.array_join(tokenize(a, lower=True), " "))
        hit = F.exists(ans, lambda a: (F.length(a) > 0) & F.col("_doc").contains(F.concat(F.lit(" "), a, F.lit(" "))))
        if empty_matches:
            hit = hit | F.exists(ans, lambda a: F.length(a) == 0)
    elif mode == "kilt":
        doc = normalize_answer(F.col(text))
        ans = F.transform(F.col(answers), lambda a: normalize_answer(a))
        hit = F.exists(ans, lambda a: ((F.length(a) > 0) | F.lit(empty_matches)) & doc.contains(a))
    elif mode == "regex":
        hit = _regex_any(F.col(text), F.col(answers))
    else:
        raise ValueError(f"unknown match type {mode}")
    return pairs.withColumn(out, F.coalesce(hit, F.lit(False))).drop("_doc", "_ans")


def answer_spans(ids: Column, answer_ids: Column) -> Column:
    """Every occurrence of the answer's id sequence in ``ids``: ``array<struct<start,end>>``,
    0-based, end inclusive; an empty answer occurs nowhere. A filter over the possible starts."""
    def search(x):      # both arrays as one variable: used inside a lambda, they would be worked out for each start
        n = F.size(x["b"])
        starts = F.when((n > 0) & (F.size(x["a"]) >= n), F.sequence(F.lit(0), F.size(x["a"]) - n)).otherwise(F.array().cast("array<int>"))
        found = F.filter(starts, lambda i: (F.get(x["a"], i) == F.get(x["b"], F.lit(0))) & (F.slice(x["a"], i + 1, n) == x["b"]))
        return F.transform(found, lambda i: F.struct(i.cast("int").alias("start"), (i + n - 1).cast("int").alias("end")))

    both = F.struct(F.coalesce(ids, F.array()).alias("a"), F.coalesce(answer_ids, F.array()).alias("b"))
    return F.element_at(F.transform(F.array(both), search), 1)


def exact_match_by_topk(preds: DataFrame, answers: DataFrame) -> DataFrame:
    """``preds(qid, n, prediction)``, ``answers(qid, answer)``: per ``n`` the mean over
    questions of the best exact match against any gold answer."""
    from ..functions.text import exact_match
    j = preds.join(answers, "qid")
    best = j.groupBy("n", "qid").agg(F.max(exact_match(F.col("prediction"), F.col("answer")).cast("int")).alias("_em"))
    return best.groupBy("n").agg(F.avg("_em").alias("em"))


def answer_in_ranked(ranked: DataFrame, passages: DataFrame, answers: DataFrame, mode: str = "string",
                     pid: str = "pid", text: str = "text", out: str = "has_answer") -> DataFrame:
    """J8 over a ranking: the passage side is normalised once per distinct passage (not once per
    (question, passage) pair: a passage retrieved by many questions is tokenised once), the
    answers once per question; the check itself is a substring test on the joined rows.
    ``ranked(qid, pid, ...)``, ``passages(pid, text)``, ``answers(qid, answers array<string>)``."""
    needed = ranked.select(pid).distinct()
    docs = passages.join(needed, pid, "left_semi").select(pid, text)
    if mode == "string":
        dnorm = docs.select(pid, match_tokens(F.col(text)).alias("_doc"))
        a = answers.select("qid", nfd_array(F.col("answers")).alias("_a")).select(
            "qid", F.transform("_a", lambda x: F.array_join(tokenize(x, lower=True), " ")).alias("_ans"))
        hit = F.exists("_ans", lambda x: (F.length(x) > 0) & F.col("_doc").contains(F.concat(F.lit(" "), x, F.lit(" "))))
    elif mode == "kilt":
        dnorm = docs.select(pid, normalize_answer(F.col(text)).alias("_doc"))
        a = answers.select("qid", F.transform("answers", lambda x: normalize_answer(x)).alias("_ans"))
        hit = F.exists("_ans", lambda x: (F.length(x) > 0) & F.col("_doc").contains(x))
    else:
        j = ranked.join(docs, pid).join(answers, "qid")
        return answer_in_passage(j, mode, text, "answers", out).drop(text, "answers")
    j = ranked.join(dnorm, pid).join(a, "qid")
    return j.withColumn(out, F.coalesce(hit, F.lit(False))).drop("_doc", "_ans")
