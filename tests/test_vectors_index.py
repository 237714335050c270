"""Vector and index properties (survey §5 c/d): brute force agreement, codec error, state changes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import index as I
from lodestar.operators import search as S
from lodestar.operators import vectors as V

SF = "/root/testdata/sf0.001"


def _emb(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def _np(spark):
    pdf = _emb(spark).orderBy("vec_id").toPandas()
    return pdf["vec_id"].to_numpy(), np.stack([np.asarray(v, np.float64) for v in pdf["embedding"]]), pdf["label"].to_numpy()


def test_knn_block_equals_numpy_and_columns(spark):
    ids, X, _ = _np(spark)
    e = _emb(spark)
    q = e.select(F.col("vec_id").alias("qid"), "embedding")
    d = e.select(F.col("vec_id").alias("pid"), "embedding")
    got = {}
    for r in V.knn_flat(q, d, 5).collect():
        got.setdefault(r.qid, []).append((r.rank, r.pid))
    S_ = X @ X.T
    for i, qid in enumerate(ids[:50]):
        order = sorted(range(len(ids)), key=lambda j: (-S_[i, j], ids[j]))[:5]
        assert [p for _, p in sorted(got[qid])] == [ids[j] for j in order]
    # many small blocks on both sides give the same answer
    fine = V.knn_flat(q.withColumnRenamed("embedding", "qvec"), d, 5, qvec="qvec", max_block_bytes=40 * 64 * 8)
    assert sorted((r.qid, r.pid) for r in fine.collect()) == sorted((q_, p) for q_, l in got.items() for _, p in l)


def test_maxsim_negative_and_zero_vectors(spark):
    pairs = spark.createDataFrame([(1, 10), (1, 11), (1, 12)], "qid long, pid long")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 1.0])], "qid long, qvecs array<double>")   # two 2-d vectors
    d = spark.createDataFrame([(10, [-1.0, -1.0, -1.0, -0.5]),    # all dots negative
                               (11, [0.0, 0.0]),                  # zero vector, one token
                               (12, [])], "pid long, dvecs array<double>")   # removed document
    out = {r.pid: r.score for r in V.maxsim(pairs, q, d, dim=2).collect()}
    assert out[10] == pytest.approx(-1.5)        # true max, not floored at 0
    assert out[11] == pytest.approx(0.0)
    assert out[12] == 0.0
    floored = {r.pid: r.score for r in V.maxsim(pairs, q, d, dim=2, floor_zero=True).collect()}
    assert floored[10] == 0.0


@pytest.fixture(scope="module")
def built(spark):
    e = _emb(spark)
    toks = e.select(F.floor(F.col("vec_id") / 8).cast("long").alias("pid"), (F.col("vec_id") % 8).cast("long").alias("tok_pos"), "embedding")
    cent = I.centroids_from_labels(e)
    codecs = {nb: I.train_codec(e.select("embedding"), cent, nb, 64) for nb in (1, 2, 4)}
    return toks, codecs


def test_codes_equal_bruteforce_argmax(spark, built):
    toks, codecs = built
    c = codecs[2]
    C, _, _ = c.arrays()
    got = {(r.pid, r.tok_pos): r.code for r in I.compress(toks, c).collect()}
    for r in toks.collect():
        x = np.asarray(r.embedding, np.float64)
        assert got[(r.pid, r.tok_pos)] == int(np.argmax(C @ x))


def test_reconstruction_error_falls_with_nbits(spark, built):
    toks, codecs = built
    X = {(r.pid, r.tok_pos): np.asarray(r.embedding, np.float64) for r in toks.collect()}
    errs = []
    for nb in (1, 2, 4):
        dec = I.decompress(I.compress(toks, codecs[nb]), codecs[nb]).collect()
        err = np.mean([np.linalg.norm(X[(r.pid, r.tok_pos)] / np.linalg.norm(X[(r.pid, r.tok_pos)]) - np.asarray(r.embedding))
                       for r in dec])
        errs.append(err)
    assert errs[0] > errs[1] > errs[2]


def test_search_without_pruning_equals_bruteforce(spark, built):
    toks, codecs = built
    ix = I.build_index(toks, codecs[4], materialize=False)
    q = toks.filter(F.col("pid") < 5).select(F.col("pid").alias("qid"), F.col("tok_pos").alias("qtok"), "embedding")
    ncent = codecs[4].arrays()[0].shape[0]
    res = S.search_all(q, ix, k=5, ncells=ncent, threshold=-1e9, ndocs=10 ** 6).collect()
    # brute force: maxsim of the query against every decompressed document
    dec = I.decompress(ix.codes, ix.codec).collect()
    docs = {}
    for r in dec:
        docs.setdefault(r.pid, []).append((r.tok_pos, np.asarray(r.embedding)))
    qv = {}
    for r in q.collect():
        qv.setdefault(r.qid, []).append((r.qtok, np.asarray(r.embedding, np.float64)))
    for qid, vs in qv.items():
        Q = np.stack([v for _, v in sorted(vs, key=lambda t: t[0])])
        scores = {pid: (Q @ np.stack([v for _, v in sorted(dv, key=lambda t: t[0])]).T).max(1).sum() for pid, dv in docs.items()}
        best = sorted(scores, key=lambda p: (-round(scores[p], 10), p))[:5]
        got = [r.pid for r in sorted((r for r in res if r.qid == qid), key=lambda r: r.rank)]
        assert got == best


def test_threshold_no_code_passes_gives_minus_9999(spark, built):
    toks, codecs = built
    ix = I.build_index(toks, codecs[2], materialize=False)
    qp = V.pack_vectors(toks.filter(F.col("pid") == 0).select(F.col("pid").alias("qid"), "tok_pos", "embedding"),
                        "qid", "tok_pos", "embedding", "qvecs")
    cands = spark.createDataFrame([(0, 1), (0, 2)], "qid long, pid long")
    out = S.approx_scores(cands, qp, S.doc_codes(ix), ix, threshold=1e9).collect()
    assert all(r.approx == pytest.approx(-9999.0 * 8) for r in out)
    # fewer candidates than ndocs: keep what exists
    assert S.prune(spark.createDataFrame(out), 256).count() == 2


def test_state_changes_remove_add_copies(spark, built):
    """Remove the top passage: the others move up; add it back: its new pid takes rank 1; add
    copies: the top ranks are the new pids."""
    toks, codecs = built
    codec = codecs[4]
    ix = I.build_index(toks, codec, materialize=False)
    q = toks.filter(F.col("pid") == 3).select(F.col("pid").alias("qid"), F.col("tok_pos").alias("qtok"), "embedding")
    ncent = codec.arrays()[0].shape[0]

    def top(index, k=5):
        r = S.search_all(q, index, k=k, ncells=ncent, threshold=-1e9, ndocs=10 ** 6).collect()
        return [x.pid for x in sorted(r, key=lambda x: x.rank)]
    before = top(ix)
    assert before[0] == 3
    removed = I.index_remove(ix, spark.createDataFrame([(3,)], "pid long"))
    after = top(removed)
    assert after[:4] == before[1:5]
    assert removed.doclens.filter("pid = 3").first().doclen == 0
    again, mapping = I.index_add(removed, toks.filter(F.col("pid") == 3).select(F.lit(0).cast("long").alias("local_id"), "tok_pos", "embedding"))
    new_pid = mapping.first().pid
    assert new_pid > toks.agg(F.max("pid")).first()[0]             # pids are never re-used
    assert top(again)[0] == new_pid
    copies = toks.filter(F.col("pid") == 3).crossJoin(spark.range(4).select(F.col("id").alias("local_id"))) \
        .select("local_id", "tok_pos", "embedding")
    four, m4 = I.index_add(removed, copies)
    assert sorted(top(four, 4)) == sorted(r.pid for r in m4.collect())


def test_add_then_remove_is_no_change(spark, built):
    toks, codecs = built
    ix = I.build_index(toks, codecs[2], materialize=False)
    extra = toks.filter(F.col("pid") < 2).select(F.col("pid").alias("local_id"), "tok_pos", "embedding")
    added, mapping = I.index_add(ix, extra)
    back = I.index_remove(added, mapping.select("pid"))
    live = back.doclens.filter("doclen > 0")
    assert sorted(tuple(r) for r in live.collect()) == sorted(tuple(r) for r in ix.doclens.collect())
    assert back.codes.count() == ix.codes.count()


def test_approx_knn_recall(spark):
    e = _emb(spark)
    q = e.select(F.col("vec_id").alias("qid"), "embedding")
    d = e.select(F.col("vec_id").alias("pid"), "embedding")
    exact = {(r.qid, r.pid) for r in V.knn_flat(q, d, 5).collect()}
    approx = {(r.qid, r.pid) for r in V.knn_approx(q, d, 5).collect()}
    print("recall", len(exact & approx) / len(exact))
    assert len(exact & approx) / len(exact) > 0.9


def test_approx_knn_joins_few_pairs(spark):
    """Cells join near-linearly: a small share of all pairs, and a smaller one for more documents."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 24))

    def share(n):
        X = base[rng.integers(0, 40, n)] + 0.4 * rng.normal(size=(n, 24))
        d = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(X)], "pid long, embedding array<double>")
        q = d.select(F.col("pid").alias("qid"), "embedding")
        exact = {(r.qid, r.pid) for r in V.knn_flat(q, d, 5).collect()}
        approx = {(r.qid, r.pid) for r in V.knn_approx(q, d, 5).collect()}
        centers = V.knn_cells(n)
        return V.knn_probes(centers) / centers, len(exact & approx) / len(exact)

    pairs, recall = share(1500)
    assert pairs < 0.2 and recall > 0.9
    assert V.knn_probes(V.knn_cells(10 ** 8)) / V.knn_cells(10 ** 8) < 0.001


@pytest.mark.parametrize("table", ["sf0.1", "unclustered"])
def test_approx_knn_recall_at_the_query_k(spark, table):
    """Recall at ten on larger tables: the probes follow the table, without a fixed most."""
    if table == "sf0.1":
        e = spark.read.parquet(f"{SF.replace('sf0.001', table)}/embeddings.parquet")
        d = e.select(F.col("vec_id").alias("pid"), "embedding")
    else:
        X = np.random.default_rng(8).normal(size=(8000, 24))
        d = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(X)], "pid long, embedding array<double>")
    q = d.select(F.col("pid").alias("qid"), "embedding")
    got = V.knn_approx(q, d, 10).collect()
    exact = {(r.qid, r.pid) for r in V.knn_flat(q, d, 10).collect()}
    assert len(got) == len({(r.qid, r.pid) for r in got}) == len(exact)
    found = len(exact & {(r.qid, r.pid) for r in got}) / len(exact)
    print("recall", table, found)
    assert found >= 0.9


def test_approx_knn_cuts_hot_cells(spark):
    """Many equal vectors lie in one cell, which is cut; with all cells probed the result is exact."""
    X = np.random.default_rng(9).normal(size=(600, 8)).round(3)
    X[200:] = X[0]
    d = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(X)], "pid long, embedding array<double>")
    q = d.select(F.col("pid").alias("qid"), "embedding")
    got = {(r.qid, r.pid) for r in V.knn_approx(q, d, 10, cells=40, probes=40).collect()}
    assert got == {(r.qid, r.pid) for r in V.knn_flat(q, d, 10, score_digits=9).collect()}


def test_long_query_is_rescored_with_all_vectors(spark, built):
    toks, codecs = built
    ix = I.build_index(toks, codecs[4], materialize=False)
    q = toks.filter(F.col("pid") < 5).select(F.lit(0).cast("long").alias("qid"), (F.col("pid") * 8 + F.col("tok_pos")).alias("qtok"), "embedding")
    ncent = codecs[4].arrays()[0].shape[0]
    got = S.search_all(q, ix, k=5, ncells=ncent, threshold=-1e9, ndocs=10 ** 6).collect()
    docs = {}
    for r in I.decompress(ix.codes, ix.codec).collect():
        docs.setdefault(r.pid, []).append(np.asarray(r.embedding))
    Q = np.stack([np.asarray(r.embedding, np.float64) for r in q.orderBy("qtok").collect()])
    assert len(Q) == 40
    scores = {p: (Q @ np.stack(v).T).max(1).sum() for p, v in docs.items()}
    best = sorted(scores, key=lambda p: (-round(scores[p], 10), p))[:5]
    assert [r.pid for r in sorted(got, key=lambda r: r.rank)] == best
    assert [r.score for r in sorted(got, key=lambda r: r.rank)] == pytest.approx([scores[p] for p in best])


def test_whole_index_path_with_a_user_encoder(spark):
    """Texts -> encoder hook -> sample, centroids, buckets, codes, lists -> search: success@5."""
    import hashlib

    def encode(texts):
        def vector(tok):
            v = np.frombuffer(hashlib.sha256(tok.encode()).digest(), np.uint8)[:32].astype(np.float64) - 127.5
            return v / np.linalg.norm(v)
        return [np.stack([vector(t) for t in (x.lower().split() or ["-"])]) for x in texts]

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("pid"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 60), " ").alias("text"))
    docs = docs.filter(F.size(F.split("text", " ")) == 60).dropDuplicates(["text"])
    index = I.train_index(I.encode_passages(docs, encode, 32), nbits=2)
    ask = docs.filter("pid % 3 = 0").select("pid", F.array_join(F.slice(F.split("text", " "), 20, 12), " ").alias("text"))
    asked = I.encode_passages(ask, encode, 32).select(F.col("pid").alias("qid"), F.col("tok_pos").alias("qtok"), "embedding")
    got = S.search_all(asked, index, k=5).collect()
    want = {r.pid for r in ask.collect()}
    assert len(want) > 20 and sum(any(r.qid == p and r.pid == p for r in got) for p in want) / len(want) > 0.93


def test_write_index_over_itself(spark, built, tmp_path):
    toks, codecs = built
    path = str(tmp_path / "ix")
    I.write_index(I.build_index(toks, codecs[2], materialize=False), path)
    before = sorted(tuple(r) for r in I.read_index(spark, path).codes.select("pid", "tok_pos", "code").collect())
    again = I.read_index(spark, path)
    I.write_index(I.index_remove(again, spark.createDataFrame([(3,)], "pid long")), path, mode="overwrite")
    now = sorted(tuple(r) for r in I.read_index(spark, path).codes.select("pid", "tok_pos", "code").collect())
    assert now == [r for r in before if r[0] != 3]
    I.write_index(again, path, mode="reuse")
    assert I.read_index(spark, path).codes.count() == len(now)


def _state(ix):
    return (sorted((r.pid, r.tok_pos, r.code, bytes(r.residual)) for r in ix.codes.collect()),
            sorted(tuple(r) for r in ix.ivf.select("code", "pid").collect()), sorted(tuple(r) for r in ix.doclens.collect()))


def test_publish_after_any_failure(spark, built, tmp_path, monkeypatch):
    """A change that fails between any two of its writes leaves the version before; repeated, it gives the whole result once."""
    from pyspark.sql.readwriter import DataFrameWriter
    toks, codecs = built
    ix = I.build_index(toks, codecs[2])
    last = toks.agg(F.max("pid")).first()[0]
    half = I.Index(ix.codec, ix.codes.filter(F.col("pid") <= last - 10), ix.ivf.filter(F.col("pid") <= last - 10), ix.doclens.filter(F.col("pid") <= last - 10))
    rest = I.Index(ix.codec, ix.codes.filter(F.col("pid") > last - 10), ix.ivf.filter(F.col("pid") > last - 10), ix.doclens.filter(F.col("pid") > last - 10))
    gone = spark.createDataFrame([(0,), (17,)], "pid long")
    want = _state(I.index_remove(ix, gone))
    path, write, publish = str(tmp_path / "ix"), DataFrameWriter.parquet, I._publish
    I.write_index(half, path, chunk_size=16)
    before = _state(I.read_index(spark, path))
    for fail_at in range(4):
        calls = []

        def failing(self, *a, **k):
            calls.append(a)
            if len(calls) > fail_at:
                raise OSError("lost")
            return write(self, *a, **k)

        def no_publish(*a):
            raise OSError("lost before the manifest")

        monkeypatch.setattr(DataFrameWriter, "parquet", failing)
        monkeypatch.setattr(I, "_publish", no_publish)
        with pytest.raises(OSError):
            I.persist_changes(spark, path, gone, rest)
        monkeypatch.setattr(DataFrameWriter, "parquet", write)
        monkeypatch.setattr(I, "_publish", publish)
        assert _state(I.read_index(spark, path)) == before
    for _ in range(2):      # a repeat after success changes nothing
        I.persist_changes(spark, path, gone, rest)
        assert _state(I.read_index(spark, path)) == want
    assert I.index_versions(spark, path) == [1, 2, 3] and _state(I.read_index(spark, path, 1)) == before
    stale = I._manifest(spark, path, 2)
    with pytest.raises(RuntimeError):       # a writer that started from an older version
        I._publish(spark, path, stale | {"version": 3})
    assert I.sweep_index(spark, path, keep=1) == 0 and I.index_versions(spark, path) == [3]      # young folders stay
    assert I.sweep_index(spark, path, keep=1, min_age_s=0) > 0
    assert _state(I.read_index(spark, path)) == want
