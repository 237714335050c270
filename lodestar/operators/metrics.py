"""Ranking metrics (A*) as aggregates over long-form rankings.

Conventions: a run is ``(qid, docid, score)``; graded judgements ``(qid, docid, rel)``; a ranking
with binary gold is ``(qid, pid, rank)`` plus gold ``(qid, pid)``. Every metric first cuts the
ranking to the deepest cutoff it needs with ``topk_per_query`` (partial top-k before the
shuffle), so a query holding a third of all rows costs ``k`` rows per map task downstream.
Per-query values are plain aggregates; means divide by an explicit query count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import topk_per_query


def _log2(c):
    return F.log2(c)


def trec_rank(run: DataFrame, k: int) -> DataFrame:
    """trec_eval order: score descending, then docid descending (string order); top ``k``."""
    return topk_per_query(run, k, "qid", "score", "docid", tie_desc=True)


def _judged_run(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """The run's top ``k`` per query in trec order with each document's judgement (``rel``, null if unjudged)."""
    ranked = trec_rank(run.select("qid", "docid", "score"), k)
    return ranked.join(qrels.select("qid", "docid", "rel"), ["qid", "docid"], "left")


def _dcg_sums(ks: Sequence[int]) -> list[Column]:
    gain = F.greatest(F.coalesce(F.col("rel"), F.lit(0)), F.lit(0)).cast("double") / _log2(F.col("rank") + 1)
    return [F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias(f"dcg{k}") for k in ks]


def _ideal(qrels: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Per judged query the ideal DCG over every judged document (not only retrieved ones) and the relevant ones."""
    top = topk_per_query(qrels.select("qid", "docid", "rel"), max(ks), "qid", "rel", "docid", rank_col="irank")
    return top.groupBy("qid").agg(*[F.sum(F.when((F.col("irank") <= k) & (F.col("rel") > 0), F.col("rel") / _log2(F.col("irank") + 1))
                                          .otherwise(0.0)).alias(f"idcg{k}") for k in ks])


def _ndcg(ks: Sequence[int]) -> list[Column]:
    return [F.when(F.col(f"idcg{k}") > 0, F.col(f"dcg{k}") / F.col(f"idcg{k}")).otherwise(0.0).alias(f"ndcg_cut_{k}") for k in ks]


def _with_precision(judged: DataFrame, min_rel: int) -> DataFrame:
    """Precision at each rank of a judged run."""
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = (F.coalesce(F.col("rel"), F.lit(0)) >= min_rel).cast("int")
    return judged.withColumn("hit", hit).withColumn("p", F.sum("hit").over(w) / F.col("rank"))


def _precision_sums(ks: Sequence[int]) -> list[Column]:
    return [F.sum(F.when((F.col("rank") <= k) & (F.col("hit") == 1), F.col("p")).otherwise(0.0)).alias(f"s{k}") for k in ks]


def _map(ks: Sequence[int]) -> list[Column]:
    return [F.when(F.col("nrel") > 0, F.col(f"s{k}") / F.col("nrel")).otherwise(0.0).alias(f"map_cut_{k}") for k in ks]


def _relevant(qrels: DataFrame, min_rel: int) -> DataFrame:
    return qrels.groupBy("qid").agg(F.sum((F.col("rel") >= min_rel).cast("long")).alias("nrel"))


def ndcg_cut(run: DataFrame, qrels: DataFrame, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """nDCG@k per query (linear gain, ``log2(rank+1)``), over queries in both run and qrels.

    The ideal ranking uses every judged document of the query (not only retrieved ones).
    """
    dcg = _judged_run(run, qrels, max(ks)).groupBy("qid").agg(*_dcg_sums(ks))
    return dcg.join(_ideal(qrels, ks), "qid").select("qid", *_ndcg(ks))   # inner: queries both ranked and judged


def map_cut(run: DataFrame, qrels: DataFrame, ks: Sequence[int] = (5, 10), min_rel: int = 1) -> DataFrame:
    """A10: MAP@k per query: sum of precision at each relevant rank <= k, over all relevant."""
    sums = _with_precision(_judged_run(run, qrels, max(ks)), min_rel).groupBy("qid").agg(*_precision_sums(ks))
    return sums.join(_relevant(qrels, min_rel), "qid").select("qid", *_map(ks))


def mean_over_fixed_n(per_query: DataFrame, measures: Sequence[str], n: int | None = None,
                      queries: DataFrame | None = None) -> DataFrame:
    """Sum of each per-query measure / n. Queries absent from ``per_query`` count as 0.

    ``n`` defaults to the number of distinct qids in ``queries`` (the judged queries)."""
    sums = per_query.agg(*[F.sum(m).alias(m) for m in measures])
    if n is not None:
        return sums.select(*[(F.coalesce(F.col(m), F.lit(0.0)) / F.lit(float(n))).alias(m) for m in measures])
    cnt = queries.select("qid").distinct().agg(F.count(F.lit(1)).alias("_n"))
    return sums.crossJoin(cnt).select(*[(F.coalesce(F.col(m), F.lit(0.0)) / F.col("_n")).alias(m) for m in measures])


def trec_evaluate(run: DataFrame, qrels: DataFrame, n: int | None = None, ks: Sequence[int] = (5, 10), min_rel: int = 1) -> DataFrame:
    """The evaluation script: ndcg_cut and map_cut averaged over ``n`` queries. The run is ranked and joined
    to the judgements once; both measures come from one aggregate."""
    rows = _with_precision(_judged_run(run, qrels, max(ks)), min_rel)
    sums = rows.groupBy("qid").agg(*_dcg_sums(ks), *_precision_sums(ks))
    per = sums.join(_ideal(qrels, ks).join(_relevant(qrels, min_rel), "qid"), "qid").select("qid", *_ndcg(ks), *_map(ks))
    return mean_over_fixed_n(per, [f"{m}_cut_{k}" for m in ("ndcg", "map") for k in ks], n, qrels)


# ---- binary-gold ranking metrics (A1-A5, A22, A26, A27) ----------------------------------------

def _first_positive(ranking: DataFrame, gold: DataFrame, depth: int) -> DataFrame:
    top = ranking.filter(F.col("rank") <= depth).select("qid", "pid", "rank")
    return top.join(gold.select("qid", "pid").distinct(), ["qid", "pid"], "left_semi")


def query_metrics(ranking: DataFrame, gold: DataFrame, queries: DataFrame,
                  mrr_depths: Sequence[int] = (10,), success_depths: Sequence[int] = (5, 10),
                  recall_depths: Sequence[int] = (10,)) -> DataFrame:
    """A1-A3 per query: MRR@d = 1/rank of the first positive if within d; success@d; recall@d =
    positives within d / number of gold. Every query of ``queries`` gets a row (0 when nothing)."""
    depth = max([*mrr_depths, *success_depths, *recall_depths])
    pos = _first_positive(ranking, gold, depth)
    agg = pos.groupBy("qid").agg(
        F.min("rank").alias("_first"),
        *[F.sum((F.col("rank") <= d).cast("long")).alias(f"_hits{d}") for d in recall_depths])
    ngold = gold.select("qid", "pid").distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("_ngold"))
    q = queries.select("qid").distinct().join(agg, "qid", "left").join(ngold, "qid", "left")
    cols = [F.col("qid")]
    for d in mrr_depths:
        cols.append(F.when(F.col("_first") <= d, 1.0 / F.col("_first")).otherwise(0.0).alias(f"mrr_{d}"))
    for d in success_depths:
        cols.append(F.when(F.col("_first") <= d, 1.0).otherwise(0.0).alias(f"success_{d}"))
    for d in recall_depths:
        cols.append(F.when(F.col("_ngold") > 0, F.coalesce(F.col(f"_hits{d}"), F.lit(0)) / F.col("_ngold"))
                    .otherwise(0.0).alias(f"recall_{d}"))
    return q.select(*cols)


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """Mean of every measure column over all rows (all queries)."""
    ms = [c for c in per_query.columns if c != "qid"]
    return per_query.agg(*[F.avg(m).alias(m) for m in ms])


def recall_max_depth(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """A4: mean over gold queries of |gold ∩ ranked| / max(1, |gold|), rounded to 3 digits."""
    g = gold.select("qid", "pid").distinct()
    found = g.join(ranking.select("qid", "pid").distinct(), ["qid", "pid"], "left_semi").groupBy("qid").agg(
        F.count(F.lit(1)).alias("_found"))
    per = g.groupBy("qid").agg(F.count(F.lit(1)).alias("_ng")).join(found, "qid", "left")
    return per.agg(F.round(F.avg(F.coalesce(F.col("_found"), F.lit(0)) / F.greatest(F.col("_ng"), F.lit(1))), 3)
                   .alias("recall_max_depth"))


DEFAULT_CUTOFFS = (1, 5, 10, 20, 30, 50, 100, 1000)


def em_success_counts(labelled: DataFrame, judged_queries: DataFrame,
                      cutoffs: Sequence[int] = DEFAULT_CUTOFFS) -> DataFrame:
    """A5: per cutoff (and ``all`` = no cutoff, coded as -1): share of judged queries with a
    label=1 row within the cutoff, and mean count of label=1 rows within it.
    ``mismatch`` is true when judged and ranked query counts differ."""
    within = {int(c): (F.col("rank") <= c) for c in cutoffs} | {-1: F.lit(True)}
    per = labelled.groupBy("qid").agg(*[F.sum((cond & (F.col("label") == 1)).cast("long")).alias(f"c{c}") for c, cond in within.items()])
    sums = per.agg(F.count(F.lit(1)).alias("_nr"), *[x for c in within for x in (
        F.sum((F.col(f"c{c}") > 0).cast("long")).alias(f"s{c}"), F.sum(f"c{c}").alias(f"n{c}"))])
    nj = judged_queries.select("qid").distinct().agg(F.count(F.lit(1)).alias("_nj"))
    rows = F.array(*[F.struct(F.lit(c).cast("long").alias("cutoff"), F.col(f"s{c}").alias("s"), F.col(f"n{c}").alias("n")) for c in within])
    out = sums.crossJoin(nj).select("_nr", "_nj", F.explode(rows).alias("e"))     # one row a side, then one per cutoff
    return out.select(F.col("e.cutoff").alias("cutoff"),
                      (F.coalesce(F.col("e.s"), F.lit(0)) / F.col("_nj")).alias("success"),
                      (F.coalesce(F.col("e.n"), F.lit(0)) / F.col("_nj")).alias("counts"),
                      (F.col("_nj") != F.col("_nr")).alias("mismatch"))


def ranking_stats(ranking: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """Max K, mean K over queries, and mean positives per query."""
    per = ranking.groupBy("qid").agg(F.count(F.lit(1)).alias("_k"))
    out = per.agg(F.max("_k").cast("long").alias("max_k"), F.avg("_k").alias("avg_k"))
    if gold is not None:
        pos = gold.select("qid", "pid").distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("_p"))
        out = out.crossJoin(per.join(pos, "qid", "left").agg(
            F.avg(F.coalesce(F.col("_p"), F.lit(0))).alias("avg_positives")))
    return out


def running_metrics(per_query: DataFrame, idx_col: str, measures: Sequence[str]) -> DataFrame:
    """After each query (in ``idx_col`` order): running sum / (idx+1).

    The running sum is a cumulative window; per-query rows are one per query (small)."""
    from .ranking import running_offsets  # exclusive sums, distributed
    out = per_query
    for m in measures:
        out = running_offsets(out, m, [idx_col], offset_col=f"_ex_{m}")
        out = out.withColumn(f"running_{m}", (F.col(f"_ex_{m}") + F.col(m)) / (F.col(idx_col) + 1)).drop(f"_ex_{m}")
    return out


def check_rankings(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """Violation counts: repeated (qid,pid) in ranking, repeated gold pids."""
    dup_rank = ranking.groupBy("qid", "pid").count().filter("count > 1").agg(
        F.count(F.lit(1)).alias("dup_ranked_pids"))
    dup_gold = gold.groupBy("qid", "pid").count().filter("count > 1").agg(
        F.count(F.lit(1)).alias("dup_gold_pids"))
    return dup_rank.crossJoin(dup_gold)


def first_hit_curve(first_hits: DataFrame, max_k: int, n_questions: DataFrame | None = None) -> DataFrame:
    """Value at k = share of questions whose first hit rank <= k, for k = 1..max_k.

    ``first_hits(qid, first_hit_rank)`` with null for no hit. Counts per rank, then a cumulative
    window over at most ``max_k`` rows."""
    spark = first_hits.sparkSession
    ks = spark.range(1, max_k + 1).withColumnRenamed("id", "k")
    per_rank = first_hits.filter(F.col("first_hit_rank").isNotNull()).groupBy(
        F.col("first_hit_rank").alias("k")).agg(F.count(F.lit(1)).alias("_c"))
    nq = first_hits.agg(F.count(F.lit(1)).alias("_nq"))
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    curve = ks.join(per_rank, "k", "left").withColumn("_cum", F.sum(F.coalesce(F.col("_c"), F.lit(0))).over(w))
    return curve.crossJoin(nq).select(F.col("k").cast("long").alias("k"),
                                      (F.col("_cum") / F.col("_nq")).alias("accuracy"))


def logsumexp_by(df: DataFrame, keys: Sequence[str], score: str, out: str = "lse") -> DataFrame:
    """Numerically safe log(sum(exp(score))) per key: max first, then the shifted sum."""
    m = df.groupBy(*keys).agg(F.max(score).alias("_mx"))
    return (df.join(m, list(keys)).groupBy(*keys, "_mx")
            .agg(F.sum(F.exp(F.col(score) - F.col("_mx"))).alias("_s"))
            .select(*keys, (F.col("_mx") + F.log(F.col("_s"))).alias(out)))


def nway_cross_entropy(scores: DataFrame, key: str = "qid", pos_col: str = "pos") -> DataFrame:
    """Gold is position 0 of each n-way group: ``lse(scores) - score[0]`` per group."""
    lse = logsumexp_by(scores, [key], "score")
    gold = scores.filter(F.col(pos_col) == 0).select(key, F.col("score").alias("_g"))
    return lse.join(gold, key).select(key, (F.col("lse") - F.col("_g")).alias("loss"))


def distillation_kl(scores: DataFrame, alpha: float = 1.0, key: str = "qid") -> DataFrame:
    """Batch-mean KL(teacher || student) with teacher logits scaled by ``alpha``.
    ``scores(qid, pos, student, teacher)``."""
    t = scores.withColumn("_t", F.col("teacher") * alpha)
    lt = logsumexp_by(t, [key], "_t", "_lt")
    ls = logsumexp_by(t, [key], "student", "_ls")
    j = t.join(lt, key).join(ls, key).withColumn("_lpt", F.col("_t") - F.col("_lt")).withColumn(
        "_lps", F.col("student") - F.col("_ls"))
    return j.agg((F.sum(F.exp("_lpt") * (F.col("_lpt") - F.col("_lps"))) / F.countDistinct(key)).alias("kl"))


def margin_report(scores: DataFrame) -> DataFrame:
    """Mean positive score, mean negative score and their difference. ``scores(score, is_pos)``."""
    return scores.agg(F.avg(F.when(F.col("is_pos"), F.col("score"))).alias("avg_pos"),
                      F.avg(F.when(~F.col("is_pos"), F.col("score"))).alias("avg_neg")).withColumn(
        "margin", F.col("avg_pos") - F.col("avg_neg"))


def rouge_tokens(c) -> "Column":
    """Tokens for ROUGE: lower-case, every run of characters other than a-z/0-9 is a separator."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda t: t != "")


def _ngram_counts(df: DataFrame, key: str, tokens: str, n: int, side: str) -> DataFrame:
    toks = F.col(tokens)
    grams = F.when(F.size(toks) >= n, F.transform(F.sequence(F.lit(0), F.size(toks) - n),
                                                  lambda i: F.array_join(F.slice(toks, i + 1, n), " "))).otherwise(F.array())
    return df.select(key, F.explode(grams).alias("g")).groupBy(key, "g").agg(F.count(F.lit(1)).alias(side))


def rouge_n(pairs: DataFrame, n: int, key: str = "id", pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """A13 (ROUGE-1/2): per pair, F-measure x100 of the n-gram multiset overlap
    (``sum(min(count_pred, count_ref))``). Distributed: explode n-grams, group, join by (pair, gram)."""
    p = pairs.select(key, rouge_tokens(F.col(pred)).alias("_p"), rouge_tokens(F.col(ref)).alias("_r"))
    cp = _ngram_counts(p, key, "_p", n, "cp")
    cr = _ngram_counts(p, key, "_r", n, "cr")
    ov = cp.join(cr, [key, "g"]).groupBy(key).agg(F.sum(F.least("cp", "cr")).alias("_ov"))
    lens = p.select(key, F.greatest(F.size("_p") - n + 1, F.lit(0)).alias("_lp"), F.greatest(F.size("_r") - n + 1, F.lit(0)).alias("_lr"))
    j = lens.join(ov, key, "left").fillna(0, ["_ov"])
    prec = F.when(F.col("_lp") > 0, F.col("_ov") / F.col("_lp")).otherwise(0.0)
    rec = F.when(F.col("_lr") > 0, F.col("_ov") / F.col("_lr")).otherwise(0.0)
    f = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0) * 100
    return j.select(key, f.alias(f"rouge{n}"))


def _lcs_length(a, b) -> int:
    """Longest common subsequence with a row of the table held in the bits of one integer."""
    if not len(a) or not len(b):
        return 0
    places: dict = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        hit = row & places.get(t, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _lcs_udf():
    import pandas as pd
    from pyspark.sql.types import DoubleType

    @F.pandas_udf(DoubleType())
    def lcs_f(a, b):
        def one(x, y):
            lcs = _lcs_length(x, y) if x is not None and y is not None else 0
            return 200.0 * lcs / (len(x) + len(y)) if lcs else 0.0
        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")
    return lcs_f


def rouge_l(pairs: DataFrame, key: str = "id", pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """A13 (ROUGE-L): F-measure x100 from the longest common subsequence (dynamic programme per
    pair in an Arrow-batched helper; pairs are independent rows)."""
    return pairs.select(key, _lcs_udf()(rouge_tokens(F.col(pred)), rouge_tokens(F.col(ref))).alias("rougeL"))


def rouge_mean(pairs: DataFrame, key: str = "id", pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """``rouge1, rouge2, rougeL`` averaged over all pairs, and ``avg``, the mean of the three (one row)."""
    each = rouge_n(pairs, 1, key, pred, ref).join(rouge_n(pairs, 2, key, pred, ref), key).join(rouge_l(pairs, key, pred, ref), key)
    means = each.agg(*[F.avg(c).alias(c) for c in ("rouge1", "rouge2", "rougeL")])
    return means.withColumn("avg", (F.col("rouge1") + F.col("rouge2") + F.col("rougeL")) / 3)


def marginal_span_nll(losses: DataFrame) -> DataFrame:
    """``losses(qid, passage, slot, loss)``: per (question, answer slot) the max over passages;
    per question ``-log(sum over slots of exp(-loss))`` ignoring zero losses (log 1 when nothing
    is left); summed over questions."""
    m = losses.groupBy("qid", "slot").agg(F.max("loss").alias("_l"))
    ml = m.groupBy("qid").agg(F.sum(F.when(F.col("_l") != 0, F.exp(-F.col("_l"))).otherwise(0.0)).alias("_ml"))
    return ml.agg(F.sum(-F.log(F.when(F.col("_ml") == 0, F.lit(1.0)).otherwise(F.col("_ml")))).alias("span_nll"))


def inbatch_multivector_loss(scores: DataFrame, nway: int) -> DataFrame:
    """``scores(batch, qidx, pidx, score)`` with passages ``pidx = nway*q + j`` of query q
    (j = 0 is its positive). For query q the other passages of its own group are left out; its
    positive and every other query's passages stay; loss = logsumexp(kept) - score(own positive)."""
    own = F.floor(F.col("pidx") / nway) == F.col("qidx")
    kept = scores.filter(~own | (F.col("pidx") == F.col("qidx") * nway))
    lse = logsumexp_by(kept, ["batch", "qidx"], "score")
    pos = scores.filter(F.col("pidx") == F.col("qidx") * nway).select("batch", "qidx", F.col("score").alias("_s"))
    return lse.join(pos, ["batch", "qidx"]).select("batch", "qidx", (F.col("lse") - F.col("_s")).alias("loss"))


def reader_prep_stats(samples: DataFrame) -> DataFrame:
    """Samples without positives, and samples with a positive taken from the gold passage
    (score = -1). ``samples(qid, positives array<struct<pid, score>>)``."""
    return samples.agg(F.sum((F.size("positives") == 0).cast("long")).alias("no_positive"),
                       F.sum(F.exists("positives", lambda p: p["score"] == -1).cast("long")).alias("positives_from_gold"))


def reader_prep_stats_rows(rows: DataFrame, key: str = "qid", pid: str = "pid", score: str = "score") -> DataFrame:
    """A24 in long form: ``rows(qid, pid, score)`` hold one positive each, a null ``pid`` none (a sample without positives
    is such a row). Two flags per sample by partial aggregates, so a sample may hold any number of positives."""
    positive = F.col(pid).isNotNull()
    per = rows.groupBy(key).agg(F.max(positive).alias("_any"), F.max(positive & F.coalesce(F.col(score) == -1, F.lit(False))).alias("_gold"))
    return per.agg(F.sum((~F.col("_any")).cast("long")).alias("no_positive"), F.sum(F.col("_gold").cast("long")).alias("positives_from_gold"))
