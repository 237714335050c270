"""Extractive-reader data and predictions.

Passages are independent rows, so the span choice (W10) is a per-row numpy kernel in
``mapInPandas``; everything else is windows and aggregates keyed by question with bounded lists
(at most the first 200 passages of a question)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                     T.StructField("score", T.DoubleType())])


def _span_table(start, end, max_len):
    """All spans of at most ``max_len`` tokens by first, then last token, with their scores."""
    width = min(max_len, len(start))
    first = np.repeat(np.arange(len(start)), width)
    last = first + np.tile(np.arange(width), len(start))
    inside = last < len(start)
    first, last = first[inside], last[inside]
    return first, last, start[first] + end[last]


def _whole_words(tokens, n):
    """For each token the first and the last token of its word (``##`` marks a word's further pieces)."""
    place = np.arange(n)
    head = np.ones(n, bool) if tokens is None else np.array([not t.startswith("##") for t in tokens], bool)
    head[:1] = True
    left = np.maximum.accumulate(np.where(head, place, 0))
    tail = np.append(head[1:], True)
    right = np.minimum.accumulate(np.where(tail, place, n - 1)[::-1])[::-1]
    return left, right


def _best_spans_one(start, end, tokens, max_len, top):
    """Rule: take the best span that is left, widen it to whole words, strike out every span that holds it or
    lies in it, and go on until ``top`` are taken. One mask over all spans is struck out at a time."""
    start, end = np.asarray(start, np.float64), np.asarray(end, np.float64)
    if not len(start):
        return []
    first, last, score = _span_table(start, end, max_len)
    left, right = _whole_words(tokens, len(start))
    open_score, taken = score.copy(), []
    while len(taken) < top:
        best = int(open_score.argmax())      # of equal scores the first span in order
        if open_score[best] == -np.inf:
            break
        a, b = left[first[best]], right[last[best]]
        taken.append({"start": int(a), "end": int(b), "score": float(score[best])})
        holds, within = (first <= a) & (last >= b), (first >= a) & (last <= b)
        open_score[holds | within] = -np.inf
        open_score[best] = -np.inf
    return taken


def best_spans(passages: DataFrame, max_len: int = 10, top: int = 10) -> DataFrame:
    """Per passage row ``(…, start_logits, end_logits, tokens)``: all spans with
    ``end - start < max_len`` scored ``start + end``, best first; a span that contains or lies
    inside an already chosen one is skipped; chosen spans grow to whole words; stop at ``top``."""
    keys = [c for c in passages.columns if c not in ("start_logits", "end_logits", "tokens")]
    schema = T.StructType([passages.schema[c] for c in keys] + [T.StructField("spans", T.ArrayType(SPAN))])

    def kernel(it):
        for p in it:
            out = p[keys].copy()
            out["spans"] = [_best_spans_one(a, b, t, max_len, top)
                            for a, b, t in zip(p["start_logits"], p["end_logits"], p["tokens"])]
            yield out

    return passages.mapInPandas(kernel, schema)


def best_prediction_by_threshold(preds: DataFrame, thresholds: list[int]) -> DataFrame:
    """``preds(qid, passage_idx, relevance, span_order, text)``: candidates are ordered by
    passage relevance (desc), then span order; for each threshold n the first candidate whose
    passage index is below n."""
    spark = preds.sparkSession
    ns = spark.createDataFrame([(int(n),) for n in thresholds], "n long")
    j = preds.crossJoin(F.broadcast(ns)).filter(F.col("passage_idx") < F.col("n"))   # thresholds: a handful
    key = F.struct(-F.col("relevance"), F.col("passage_idx"), F.col("span_order"))
    return j.groupBy("qid", "n").agg(F.min_by(F.struct("passage_idx", "text"), key).alias("_b")).select(
        "qid", "n", F.col("_b.passage_idx").alias("passage_idx"), F.col("_b.text").alias("prediction"))


def select_reader_passages(ranked: DataFrame, is_train: bool, max_passages: int = 200, max_fallback_pos: int = 20,
                           eval_negatives: int = 100, spans: str | None = None, gold: DataFrame | None = None) -> DataFrame:
    """``ranked(qid, pid, rank, has_answer, gold_page)``. First ``max_passages`` by rank.
    Training: positives are answer hits on the gold page; when there are none, any answer hits,
    first ``max_fallback_pos``; negatives are non-hits, ``min(max(10*pos, 50), 150)`` of them;
    questions without positives are dropped. Evaluation: the first ``eval_negatives`` passages.

    ``spans`` names a boolean column, true where answer spans were found: only such hits are positives.
    ``gold(qid, pid)`` adds a question's gold passages in training, as positives of rank 0, and keeps the question."""
    r = ranked.filter(F.col("rank") <= max_passages)
    if not is_train:
        return r.filter(F.col("rank") <= eval_negatives).withColumn("role", F.lit("passage"))
    if gold is not None:
        extra = {c: F.lit(None).cast(r.schema[c].dataType) for c in r.columns} | {
            "qid": F.col("qid"), "pid": F.col("pid"), "rank": F.lit(0).cast(r.schema["rank"].dataType), "has_answer": F.lit(True), "gold_page": F.lit(True)}
        if spans:
            extra[spans] = F.lit(True)
        given = gold.select("qid", "pid").distinct()
        r = r.join(given, ["qid", "pid"], "left_anti").select(r.columns).unionByName(given.select(*[c.alias(n) for n, c in extra.items()]))
    w = Window.partitionBy("qid").orderBy("rank", "pid")
    usable = F.col("has_answer") & (F.coalesce(F.col(spans), F.lit(False)) if spans else F.lit(True))
    on_page = usable & F.col("gold_page")
    x = r.withColumn("_ngold", F.sum(on_page.cast("int")).over(Window.partitionBy("qid")))
    x = x.withColumn("_hitrank", F.sum(usable.cast("int")).over(w))
    pos = F.when(F.col("_ngold") > 0, on_page).otherwise(usable & (F.col("_hitrank") <= max_fallback_pos))
    x = x.withColumn("_pos", pos)
    x = x.withColumn("_npos", F.sum(F.col("_pos").cast("int")).over(Window.partitionBy("qid")))
    x = x.withColumn("_negrank", F.sum((~F.col("has_answer")).cast("int")).over(w))
    nneg = F.least(F.greatest(10 * F.col("_npos"), F.lit(50)), F.lit(150))
    x = x.filter(F.col("_npos") > 0)
    out = x.withColumn("role", F.when(F.col("_pos"), "positive")
                       .when(~F.col("has_answer") & (F.col("_negrank") <= nneg), "negative"))
    return out.filter(F.col("role").isNotNull()).drop("_ngold", "_hitrank", "_pos", "_npos", "_negrank")


def compose_reader_batch(selected: DataFrame, n: int, fits: str | None = None) -> DataFrame:
    """Per question one positive (the best ranked), then negatives, padded with empty slots
    (pid -1) to ``n`` passages. ``fits`` names a boolean column, true where an answer span lies within the
    input's length: other positives are passed over, and a question without one is left out."""
    if fits:
        selected = selected.filter((F.col("role") != "positive") | F.coalesce(F.col(fits), F.lit(False)))
    w = Window.partitionBy("qid").orderBy(F.when(F.col("role") == "positive", 0).otherwise(1), "rank")
    first_pos = selected.filter(F.col("role") == "positive").groupBy("qid").agg(F.min("rank").alias("_pr"))
    s = selected.join(first_pos, "qid").filter((F.col("role") == "negative") | (F.col("rank") == F.col("_pr")))
    s = s.withColumn("slot", F.row_number().over(w) - 1).filter(F.col("slot") < n)
    g = s.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("slot", "pid"))).alias("_s"))   # bounded by n
    ids = F.transform("_s", lambda x: x["pid"])
    return g.select("qid", F.concat(ids, F.array_repeat(F.lit(-1).cast("long"), F.lit(n) - F.size(ids))).alias("pids"))


def gold_page_match(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """A hit is on the question's gold page when the titles are equal ignoring case."""
    g = gold.select("qid", F.lower("title").alias("_gt")).distinct()
    return hits.join(g, (hits["qid"] == g["qid"]) & (F.lower(hits["title"]) == g["_gt"]), "left") \
        .select(hits["*"], F.col("_gt").isNotNull().alias("gold_page"))
