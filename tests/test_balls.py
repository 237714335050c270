"""Exact search by balls: equal to the full product, whole balls skipped or counted, no ball above a byte limit."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.operators import codebook as B
from lodestar.operators import vectors as V


def clustered(seed, n, dim, middles=12, width=0.05):
    r = np.random.default_rng(seed)
    m = r.normal(size=(middles, dim))
    X = m[r.integers(0, middles, n)] + width * r.normal(size=(n, dim))
    X[: n // 3] = X[0]          # a third of all vectors are equal: ties by id
    return X


def frame(spark, X, name, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in x]) for i, x in enumerate(X)], f"{name} long, embedding array<double>")


@pytest.mark.parametrize("width", [0.05, 2.0])
def test_knn_balls_is_the_full_product(spark, monkeypatch, width):
    monkeypatch.setattr(B, "SLICE", 40)
    monkeypatch.setattr(B, "COPIES", 7)
    X = clustered(5, 700, 8, width=width)
    Q = np.r_[X[::9], np.zeros((1, 8))]
    start = 1 << 40             # ids beyond 32 bits
    balls = V.document_balls(frame(spark, X, "pid", start))
    got = {}
    for r in V.knn_balls(frame(spark, Q, "qid"), balls, 6).collect():
        got.setdefault(r.qid, {})[r["rank"]] = (r.pid, r.score)
    S = np.round(Q @ X.T, B.DIGITS)
    for i, row in enumerate(S):
        best = np.lexsort((np.arange(len(X)), -row))[:6]
        assert [got[i][k + 1][0] - start for k in range(6)] == best.tolist()
        assert np.allclose([got[i][k + 1][1] for k in range(6)], row[best], atol=1e-11)


def test_no_ball_above_the_limit(spark, monkeypatch):
    monkeypatch.setattr(B, "LIST_BYTES", 30 * 8 * 8)      # thirty vectors
    X = clustered(6, 900, 8)
    balls = V.document_balls(frame(spark, X, "pid"))
    # a cell is cut by hashes of ids, so its parts are near the limit, and a third of all vectors fill no ball
    assert balls.size.sum() == 900 and balls.size.max() <= 60


def test_average_rank_balls(spark):
    X = clustered(7, 1200, 16)
    r = np.random.default_rng(8)
    gold = r.integers(0, len(X), 80)
    contexts = frame(spark, X, "cid")
    Q = X[gold] + 0.3 * r.normal(size=(80, 16))
    questions = frame(spark, Q, "qid").join(spark.createDataFrame([(i, int(g)) for i, g in enumerate(gold)], "qid long, gold_cid long"), "qid")
    rows = V.average_rank_balls(questions, contexts).collect()
    S = np.round(Q @ X.T, B.DIGITS)
    want = (S > S[np.arange(80), gold][:, None]).sum(1)
    assert {x.qid: x.gold_rank for x in rows} == dict(enumerate(want.tolist()))
    met = sum(x.met for x in rows) / (80 * 1200)
    assert met < 0.5, met
    flat = {x.qid: x.gold_rank for x in V.average_rank(questions, contexts).collect()}
    assert flat == dict(enumerate(want.tolist()))


def test_grid_blocks_follow_bytes(spark):
    """The document side of the grid has as many blocks as bytes ask for, equal vectors in different ones."""
    X = clustered(9, 300, 4)
    docs, q = frame(spark, X, "pid"), frame(spark, X[:5], "qid")
    small = V.knn_flat(q, docs, 3, score_digits=9, max_block_bytes=10 * 4 * 8).orderBy("qid", "rank").collect()
    assert small == V.knn_flat(q, docs, 3, score_digits=9).orderBy("qid", "rank").collect()


def test_balls_edges(spark):
    one = frame(spark, np.ones((1, 3)), "pid")
    balls = V.document_balls(one)
    none = spark.createDataFrame([], "qid long, embedding array<double>")
    assert V.knn_balls(none, balls, 2).collect() == []
    assert [(r.qid, r.pid, r["rank"]) for r in V.knn_balls(one.withColumnRenamed("pid", "qid"), balls, 5).collect()] == [(0, 0, 1)]
    with pytest.raises(ValueError):
        V.document_balls(one.filter(F.lit(False)))


def test_a_vector_goes_once_to_a_block(monkeypatch):
    """Marks of many lists travel as bits beside one copy for each block, and come back as the rows of each list."""
    rng = np.random.default_rng(3)
    cells = B._Cells(np.array([0, 9, 10, 20]), 1)
    go = rng.random((50, 20)) < 0.8
    go[3], go[4, 9] = False, False
    p = pd.DataFrame({"id": np.arange(50), "embedding": [np.ones(2)] * 50})
    monkeypatch.setattr(B, "COPIES", 7)
    sent = list(cells.send(p, go))
    assert max(map(len, sent)) <= 7
    sent = pd.concat(sent)
    assert not sent.duplicated(["id", "block"]).any()
    assert len(sent) == sum(go[:, a:b].any(1).sum() for a, b in ((0, 9), (9, 10), (10, 20))) < go.sum() / 4
    got = np.zeros_like(go)
    c = pd.DataFrame({"list": np.arange(20), "code": np.arange(20), "centroid": [np.ones(2)] * 20})
    for block, x in sent.groupby("block"):
        a, b = cells.edges[block], cells.edges[block + 1]
        for rows, codes, C in cells.meetings(x, c[a:b]):
            got[x["id"].to_numpy()[rows], codes[0]] = True
    assert (got == go).all()


def test_balls_in_many_cells(spark, monkeypatch):
    """Small blocks, slices and steps give the full product too, where no bound helps."""
    monkeypatch.setattr(B, "SLICE", 40)
    monkeypatch.setattr(B, "STEP", 64)
    monkeypatch.setattr(V, "STEP_CELLS", 100)
    monkeypatch.setattr(V, "MAX_BLOCK_BYTES", 40 * 6 * 8)
    rng = np.random.default_rng(11)
    X = rng.integers(-2, 3, (300, 6)) / 2.0         # many ties
    q = frame(spark, X[:90], "qid")
    balls = V.document_balls(frame(spark, X, "pid"))
    got = {}
    for r in V.knn_balls(q, balls, 7).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.pid
    S = X[:90] @ X.T
    for i, row in enumerate(S):
        assert [got[i][k + 1] for k in range(7)] == np.lexsort((np.arange(300), -row))[:7].tolist()
    gold = q.withColumn("gold_cid", (F.col("qid") * 3).cast("long"))
    rank = {r.qid: r.gold_rank for r in V.average_rank_balls(gold, frame(spark, X, "cid")).collect()}
    assert rank == {i: int((S[i] > S[i, 3 * i]).sum()) for i in range(90)}
