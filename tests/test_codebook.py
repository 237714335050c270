"""Two-level codebook against the full product."""

import numpy as np
import pytest

from lodestar.operators import codebook as B


def frame(spark, X, name="id", vec="embedding"):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], f"{name} {'int' if name == 'code' else 'long'}, {vec} array<double>")


def flat(X, C, n):
    S = np.round(X @ C.T, B.DIGITS)
    return np.lexsort((np.broadcast_to(np.arange(len(C)), S.shape), -S), axis=1)[:, :n]


def data(seed, n, k, dim):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(7, dim))
    X = middles[r.integers(0, 7, n)] + 0.3 * r.normal(size=(n, dim))
    X[: n // 3] = X[0] + 0.01 * r.normal(size=(n // 3, dim))      # a hot cell
    C = middles[r.integers(0, 7, k)] + 0.3 * r.normal(size=(k, dim))
    C[k // 2] = C[1]                                             # equal centroids tie to the smaller code
    X[-1] = 0                                                    # a zero vector ties with all
    return X, C / np.linalg.norm(C, axis=1, keepdims=True)


@pytest.mark.parametrize("n", [1, 3])
def test_nearest_is_the_full_product(spark, monkeypatch, n):
    monkeypatch.setattr(B, "SLICE", 50)      # several slices of the hot list
    X, C = data(1, 400, 230, 8)
    book = B.build_codebook(frame(spark, C, "code", "centroid"))
    assert len(book.size) < 40 and book.size.sum() == 230
    got = {}
    for r in B.nearest_codes(frame(spark, X), book, n).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.code
    assert [[got[i][k + 1] for k in range(n)] for i in range(len(X))] == flat(X, C, n).tolist()


def test_more_asked_than_a_list_holds(spark):
    X, C = data(2, 30, 12, 4)
    book = B.build_codebook(frame(spark, C, "code", "centroid"))
    rows = B.nearest_codes(frame(spark, X), book, 11).collect()
    got = {i: [r.code for r in sorted((r for r in rows if r.id == i), key=lambda r: r["rank"])] for i in range(30)}
    assert [got[i] for i in range(30)] == flat(X, C, 11).tolist()


def test_bound_saves_visits(spark):
    """Clustered vectors meet a small share of the centroids."""
    X, C = data(3, 300, 400, 16)
    book = B.build_codebook(frame(spark, C, "code", "centroid"))
    sent = X @ book.center.T + np.linalg.norm(X, axis=1, keepdims=True) * book.radius
    best = np.round(X @ C.T, B.DIGITS).max(1)
    met = ((sent >= best[:, None] - 1e-9) * book.size).sum(1)[:-1]     # the zero vector meets all
    assert met.mean() < 0.6 * len(C)


def test_lloyd_is_spherical_k_means(spark):
    X, C = data(4, 200, 9, 6)
    got = np.array([r.centroid for r in B.lloyd(frame(spark, X), frame(spark, C, "code", "centroid"), 3).orderBy("code").collect()])
    want = C.copy()
    for _ in range(3):
        code = flat(X, want, 1)[:, 0]
        for c in np.unique(code):
            m = X[code == c].mean(0)
            want[c] = m / np.linalg.norm(m)
    assert np.allclose(got, want)


@pytest.mark.parametrize("slice_rows", [3, 1 << 13])
def test_index_beyond_the_broadcast_bound(spark, monkeypatch, slice_rows):
    """A codec with more centroids than may be broadcast gives the codes, values, cells and scores of a broadcast one."""
    from pyspark.sql import functions as F

    from lodestar.operators import index as I
    from lodestar.operators import search as S
    from lodestar.operators.vectors import pack_vectors
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter("vec_id < 200")
    toks = e.select(F.floor(F.col("vec_id") / 8).cast("long").alias("pid"), (F.col("vec_id") % 8).cast("long").alias("tok_pos"), "embedding")
    cent = I.train_centroids(e.select(F.col("vec_id").alias("id"), "embedding"), 24, 1)
    asked = pack_vectors(toks.select(F.col("pid").alias("qid"), "tok_pos", "embedding"), "qid", "tok_pos", "embedding", "qvecs").checkpoint()
    told = []
    for bound in (1 << 28, 1000):
        monkeypatch.setattr(I, "MAX_CODEC_BYTES", bound)
        codec = I.train_codec(e.select("embedding"), cent, 2, 64)
        assert codec.fits == (bound > 1000)
        ix = I.build_index(toks, codec)
        probes = S.probe_cells(asked, ix, 2)
        cands = S.generate_candidates(probes, ix.ivf, list_rows=2)
        scores = [S.approx_scores(cands, asked, S.doc_codes(ix), ix, t, slice_rows) for t in (None, 0.5)]
        told.append([sorted(map(tuple, ix.codes.select("pid", "tok_pos", "code", F.hex("residual")).collect())),
                     sorted((r.pid, r.tok_pos, tuple(np.round(r.embedding, 9))) for r in I.decompress(ix.codes, codec).collect()),
                     sorted(map(tuple, probes.collect())), sorted(map(tuple, cands.collect())),
                     *(sorted((r.qid, r.pid, round(r.approx, 8)) for r in s.collect()) for s in scores)])
    assert told[0] == told[1] and all(told[0])
