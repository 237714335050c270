"""Ranking metrics on hand-made rows: the edge cases every run must hold (FIXTURES C)."""

import math

import pytest
from pyspark.sql import functions as F

from lodestar.operators import metrics as M


def _run(spark, rows):
    return spark.createDataFrame(rows, "qid long, docid string, score double")


def _qrels(spark, rows):
    return spark.createDataFrame(rows, "qid long, docid string, rel int")


def test_ndcg_ties_fewer_hits_and_missing_queries(spark):
    run = _run(spark, [(1, "a", 1.0), (1, "b", 1.0), (1, "c", 0.5),      # tie a/b: docid descending -> b first
                       (2, "x", 3.0),                                     # no relevant hit
                       (4, "z", 1.0)])                                    # unjudged run query
    qrels = _qrels(spark, [(1, "a", 2), (1, "c", 1), (1, "d", 1),         # d judged, never retrieved
                           (2, "y", 1), (3, "q", 1)])                     # query 3 judged, missing from run
    out = {r.qid: r for r in M.ndcg_cut(run, qrels, ks=(5,)).collect()}
    assert set(out) == {1, 2}                                             # only queries in run and qrels
    dcg = 0 / math.log2(2) + 2 / math.log2(3) + 1 / math.log2(4)
    idcg = 2 / math.log2(2) + 1 / math.log2(3) + 1 / math.log2(4)
    assert out[1].ndcg_cut_5 == pytest.approx(dcg / idcg)
    assert out[2].ndcg_cut_5 == 0.0
    mean = M.trec_evaluate(run, qrels).first()
    # mean divides by all judged queries (3): query 3 counts as 0
    assert mean.ndcg_cut_5 == pytest.approx((dcg / idcg) / 3)


def test_map_cut_counts_all_relevant(spark):
    run = _run(spark, [(1, "a", 3.0), (1, "b", 2.0), (1, "c", 1.0)])
    qrels = _qrels(spark, [(1, "a", 1), (1, "c", 1), (1, "zz", 1)])
    r = M.map_cut(run, qrels, ks=(5,)).first()
    assert r.map_cut_5 == pytest.approx((1 / 1 + 2 / 3) / 3)


def test_mrr_success_recall_with_empty_queries(spark):
    ranking = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 20, 1)], "qid long, pid long, rank long")
    gold = spark.createDataFrame([(1, 12), (1, 13), (3, 30)], "qid long, pid long")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    per = {r.qid: r for r in M.query_metrics(ranking, gold, queries, (10,), (1, 5), (10,)).collect()}
    assert per[1].mrr_10 == pytest.approx(1 / 3) and per[1].success_1 == 0.0 and per[1].success_5 == 1.0
    assert per[1].recall_10 == pytest.approx(0.5)
    assert per[2].mrr_10 == 0.0 and per[3].recall_10 == 0.0


def test_contiguous_ranks_and_duplicates(spark):
    from lodestar.operators.ranking import check_contiguous_ranks
    r = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (2, 2), (3, 1), (3, 1), (3, 2)], "qid long, rank long")
    bad = sorted((x.qid, x.rank) for x in check_contiguous_ranks(r).collect())
    assert bad == [(1, 4), (2, 2), (3, 1)]
    ranking = spark.createDataFrame([(1, 5, 1), (1, 5, 2)], "qid long, pid long, rank long")
    gold = spark.createDataFrame([(1, 5)], "qid long, pid long")
    c = M.check_rankings(ranking, gold).first()
    assert c.dup_ranked_pids == 1 and c.dup_gold_pids == 0


def test_mine_from_ranking_stop_rule(spark):
    from lodestar.operators.weak import mine_from_ranking
    # 12 positives then 40 negatives: stop once pos>=10 and neg>=10
    rows = [(1, i + 1, i < 12) for i in range(52)]
    # 40 negatives only: stop at 30 negatives
    rows += [(2, i + 1, False) for i in range(40)]
    hits = spark.createDataFrame(rows, "qid long, rank long, has_answer boolean")
    out = mine_from_ranking(hits).groupBy("qid").agg(F.count(F.lit(1)).alias("n"),
                                                     F.sum(F.col("has_answer").cast("int")).alias("p")).collect()
    got = {r.qid: (r.n, r.p) for r in out}
    assert got[1] == (22, 12)
    assert got[2] == (30, 0)


def test_logsumexp_losses(spark):
    s = spark.createDataFrame([(1, 0, 2.0), (1, 1, 1.0), (1, 2, -1.0)], "qid long, pos long, score double")
    loss = M.nway_cross_entropy(s).first().loss
    assert loss == pytest.approx(math.log(math.exp(2) + math.exp(1) + math.exp(-1)) - 2)


def test_mine_from_ranking_equals_sequential_walk(spark):
    """The cut-off formulation equals walking the hits one by one (random labelled rankings)."""
    import random

    from lodestar.operators.weak import mine_from_ranking
    rnd = random.Random(7)
    rows, expect = [], set()
    for q in range(40):
        n = rnd.randint(0, 80)
        labels = [rnd.random() < rnd.choice([0.1, 0.5, 0.9]) for _ in range(n)]
        pos = neg = 0
        for r, lab in enumerate(labels, 1):
            rows.append((q, r, lab))
            if (pos >= 10 and neg >= 10) or neg >= 30:
                continue
            expect.add((q, r))
            pos, neg = pos + lab, neg + (not lab)
    hits = spark.createDataFrame(rows, "qid long, rank long, has_answer boolean")
    got = {(r.qid, r.rank) for r in mine_from_ranking(hits).collect()}
    assert got == expect


def test_reader_prep_stats_rows_equal_the_grouped_form(spark):
    rows = spark.createDataFrame([(1, None, None), (2, 7, -1.0), (2, 8, 0.5), (3, 9, None), (4, 9, 0.1), (5, None, -1.0), (None, 3, -1.0)],
                                 "qid long, pid long, score double")
    grouped = rows.groupBy("qid").agg(F.collect_list(F.when(F.col("pid").isNotNull(), F.struct("pid", "score"))).alias("positives"))
    assert M.reader_prep_stats_rows(rows).first() == M.reader_prep_stats(grouped).first()
    assert tuple(M.reader_prep_stats_rows(rows).first()) == (2, 2)
