"""Registered queries: codec, compressed index, three-stage search, maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index as I
from ..operators import search as S
from ..session import table
from .registry import register

R = 6
NBITS = 2
SEED = 123


def tokens(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 8).cast("long").alias("pid"), (F.col("vec_id") % 8).cast("long").alias("tok_pos"),
                    "embedding")


_BUILT: dict = {}


def centroids(spark, d):
    """V11 over all vectors: an eighth of the planned centroids (V10), one Lloyd step, which SQL can repeat."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    k = max(1, I.plan_partitions(vectors.count()) // 8)
    return I.train_centroids(vectors, k, iters=1, seed=SEED)


def codec(spark, d):
    """The trained codec for a table folder (trained once per session: an index artifact)."""
    key = ("codec", spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        e = table(spark, d, "embeddings")
        dim = e.select(F.max(F.size("embedding"))).first()[0]
        _BUILT[key] = I.train_codec(e.select("embedding"), centroids(spark, d), NBITS, int(dim))
    return _BUILT[key]


def index(spark, d):
    """The built (checkpointed) index for a table folder, built once per session."""
    key = ("index", spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        _BUILT[key] = I.build_index(tokens(spark, d), codec(spark, d))
    return _BUILT[key]


def queries(spark, d):
    return tokens(spark, d).select(F.col("pid").alias("qid"), F.col("tok_pos").alias("qtok"), "embedding")


# ---- DuckDB form of the same index --------------------------------------------------------------
BASE = f"""WITH tok AS (SELECT vec_id, vec_id // 8 AS pid, vec_id % 8 AS tp, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
planned AS (SELECT greatest(1, CAST(pow(2, floor(log2(16 * sqrt(count(*))))) AS BIGINT) // 8) AS k FROM tok),
started AS (SELECT row_number() OVER (ORDER BY md5('{SEED}:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS code, v FROM tok),
start AS (SELECT code, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS c FROM started, planned WHERE code < k),
sc0 AS (SELECT t.vec_id, t.v, s.code, round(list_dot_product(t.v, s.c), 12) AS s FROM tok t, start s),
asg0 AS (SELECT vec_id, v, code FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, code) AS rn FROM sc0) WHERE rn = 1),
dimx AS (SELECT code, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM asg0),
means AS (SELECT code, i, AVG(x) AS m FROM dimx GROUP BY code, i),
moved AS (SELECT code, list(m ORDER BY i) AS c FROM means GROUP BY code),
cent AS MATERIALIZED (SELECT s.code, coalesce(list_transform(m.c, lambda x: x / sqrt(list_dot_product(m.c, m.c))), s.c) AS c FROM start s LEFT JOIN moved m ON m.code = s.code),
sc AS (SELECT t.vec_id, t.pid, t.tp, t.v, c.code, list_dot_product(t.v, c.c) AS s FROM tok t, cent c),
asg AS (SELECT vec_id, pid, tp, v, code FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, code) AS rn FROM sc) WHERE rn = 1),
res AS (SELECT a.vec_id, a.pid, a.tp, a.code, list_transform(a.v, lambda x, i: x - c.c[i]) AS r FROM asg a JOIN cent c ON a.code = c.code),
vals AS (SELECT unnest(r) AS x FROM res),
bk AS (SELECT quantile_cont(x, [0.25, 0.5, 0.75]) AS cutoffs, quantile_cont(x, [0.125, 0.375, 0.625, 0.875]) AS weights FROM vals),
bkt AS (SELECT r.vec_id, r.pid, r.tp, r.code, list_transform(r.r, lambda x: len(list_filter(bk.cutoffs, lambda c: c < x))) AS b FROM res r, bk),
dec AS (SELECT t.pid, t.tp, list_transform(c.c, lambda x, i: x + bk.weights[t.b[i] + 1]) AS w FROM bkt t JOIN cent c ON t.code = c.code, bk),
decn AS (SELECT pid, tp, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS dv FROM dec),
q AS (SELECT pid AS qid, tp AS qtok, v AS qv FROM tok),
cs AS (SELECT q.qid, q.qtok, c.code, list_dot_product(q.qv, c.c) AS s FROM q, cent c),
ivf AS (SELECT DISTINCT code, pid FROM asg),
dcodes AS (SELECT DISTINCT pid, code FROM asg),
nq AS (SELECT qid, COUNT(*) AS n FROM q GROUP BY qid)
"""


def stage_sql(ncells: int, thr: float, ndocs: int) -> str:
    return f""",
probes AS (SELECT DISTINCT qid, code FROM (SELECT qid, qtok, code, row_number() OVER (PARTITION BY qid, qtok ORDER BY s DESC, code) AS rn FROM cs) WHERE rn <= {ncells}),
cands AS (SELECT DISTINCT p.qid, i.pid FROM probes p JOIN ivf i ON p.code = i.code),
passing AS (SELECT qid, code FROM cs GROUP BY qid, code HAVING MAX(s) >= {thr}),
s1q AS (SELECT c.qid, c.pid, cs.qtok, MAX(cs.s) AS m FROM cands c JOIN dcodes d ON c.pid = d.pid
        JOIN passing p ON p.qid = c.qid AND p.code = d.code JOIN cs ON cs.qid = c.qid AND cs.code = d.code GROUP BY 1, 2, 3),
s1all AS (SELECT c.qid, c.pid, round(COALESCE(SUM(s.m), 0) + (-9999.0) * (nq.n - COUNT(s.qtok)), 10) AS approx
        FROM cands c JOIN nq ON c.qid = nq.qid LEFT JOIN s1q s ON s.qid = c.qid AND s.pid = c.pid GROUP BY c.qid, c.pid, nq.n),
s1 AS (SELECT qid, pid, approx FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY approx DESC, pid) AS rn FROM s1all) WHERE rn <= {ndocs}),
s2q AS (SELECT c.qid, c.pid, cs.qtok, MAX(cs.s) AS m FROM s1 c JOIN dcodes d ON c.pid = d.pid
        JOIN cs ON cs.qid = c.qid AND cs.code = d.code GROUP BY 1, 2, 3),
s2all AS (SELECT qid, pid, round(SUM(m), 10) AS approx FROM s2q GROUP BY qid, pid),
s2 AS (SELECT qid, pid, approx FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY approx DESC, pid) AS rn FROM s2all) WHERE rn <= {max(ndocs // 4, 1)}),
fin AS (SELECT qid, pid, round(SUM(m), 10) AS score FROM (SELECT s.qid, s.pid, q.qtok, MAX(list_dot_product(q.qv, d.dv)) AS m
        FROM s2 s JOIN q ON q.qid = s.qid JOIN decn d ON d.pid = s.pid GROUP BY 1, 2, 3) GROUP BY 1, 2),
ranked AS (SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM fin)
"""


@register("V10_plan_partitions", "SELECT CAST(COUNT(*) AS BIGINT) AS n, CAST(pow(2, floor(log2(16 * sqrt(COUNT(*))))) AS BIGINT) AS partitions FROM embeddings")
def v10(spark, d):
    n = table(spark, d, "embeddings").agg(F.count(F.lit(1)).cast("long").alias("n"))
    return n.select("n", I.plan_partitions_col(F.col("n")).alias("partitions"))


@register("A25_avg_doclen", "SELECT round(AVG(n), 6) AS avg_doclen, CAST(SUM(n) AS BIGINT) AS num_embeddings, CAST(COUNT(*) AS BIGINT) AS num_passages FROM (SELECT vec_id // 8 AS pid, COUNT(*) AS n FROM embeddings GROUP BY 1)")
def a25(spark, d):
    a = I.avg_doclen(tokens(spark, d))
    return a.select(F.round("avg_doclen", R).alias("avg_doclen"), "num_embeddings", "num_passages")


@register("V11_train_centroids", BASE + f"""SELECT CAST(code AS INTEGER) AS code, round(list_sum(c), {R}) AS total, round(c[1], {R}) AS first,
 round(list_sum(list_transform(c, lambda x, i: x * i)), {R}) AS weighted FROM cent""")
def v11(spark, d):
    weighted = F.aggregate(F.transform("centroid", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return centroids(spark, d).select("code", F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), R).alias("total"),
                                      F.round(F.col("centroid")[0], R).alias("first"), F.round(weighted, R).alias("weighted"))


@register("V12_assign_codes_two_level", BASE + "SELECT pid, CAST(tp AS BIGINT) AS tok_pos, CAST(code AS INTEGER) AS code FROM asg")
def v12_two_level(spark, d):
    """The codes by the two-level codebook, as for a codec that is too large to be broadcast."""
    from ..operators.codebook import build_codebook, nearest_codes
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    codes = nearest_codes(e, build_codebook(codec(spark, d).centroids))
    return codes.select(F.floor(F.col("id") / 8).cast("long").alias("pid"), (F.col("id") % 8).cast("long").alias("tok_pos"), "code")


@register("V12_assign_codes", BASE + "SELECT pid, CAST(tp AS BIGINT) AS tok_pos, CAST(code AS INTEGER) AS code FROM asg")
def v12(spark, d):
    c = I.compress(tokens(spark, d), codec(spark, d))
    return c.select("pid", "tok_pos", "code")


@register("V13_residual_stats", BASE + f"""SELECT CAST(i - 1 AS INTEGER) AS dim, round(AVG(abs(x)), {R}) AS avg_abs FROM (SELECT generate_subscripts(r, 1) AS i, unnest(r) AS x FROM res) GROUP BY i""")
def v13(spark, d):
    e = table(spark, d, "embeddings")
    c = codec(spark, d)
    res = I.residual_values(e.select("embedding"), c.centroids, c.dim)
    return I.residual_stats(res).select("dim", F.round("avg_abs", R).alias("avg_abs"))


@register("V14_bucket_table", BASE + f"""SELECT 'cutoff' AS kind, CAST(i AS BIGINT) AS i, round(x, {R}) AS x FROM (SELECT generate_subscripts(cutoffs, 1) AS i, unnest(cutoffs) AS x FROM bk)
UNION ALL SELECT 'weight', CAST(i AS BIGINT), round(x, {R}) FROM (SELECT generate_subscripts(weights, 1) AS i, unnest(weights) AS x FROM bk)""")
def v14(spark, d):
    b = codec(spark, d).buckets
    cut = b.select(F.lit("cutoff").alias("kind"), F.posexplode("cutoffs").alias("i", "x"))
    wt = b.select(F.lit("weight").alias("kind"), F.posexplode("weights").alias("i", "x"))
    return cut.unionByName(wt).select("kind", (F.col("i") + 1).cast("long").alias("i"), F.round("x", R).alias("x"))


@register("V15_bucketize", BASE + "SELECT pid, CAST(tp AS BIGINT) AS tok_pos, array_to_string(b, ',') AS buckets FROM bkt")
def v15(spark, d):
    from ..functions.vectors import bucketize
    c = codec(spark, d)
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).cast("long").alias("pid"),
                                             (F.col("vec_id") % 8).cast("long").alias("tok_pos"), "embedding")
    res = I.residual_values(e, c.centroids, c.dim).crossJoin(F.broadcast(c.buckets.select("cutoffs")))
    return res.select("pid", "tok_pos", F.array_join(F.transform("residual", lambda x: bucketize(x, F.col("cutoffs"))), ",").alias("buckets"))


@register("V16_pack_residual", BASE + """,
planes AS (SELECT pid, tp, list_reduce(list_transform(b, lambda x: CAST(x % 2 AS VARCHAR) || CAST(x // 2 AS VARCHAR)), lambda x, y: x || y) AS bits, len(b) // 4 AS n FROM bkt)
SELECT pid, CAST(tp AS BIGINT) AS tok_pos, array_to_string(list_transform(range(0, 2 * n), lambda i: '0123456789ABCDEF'[
 CAST(bits[4 * i + 1] AS INTEGER) * 8 + CAST(bits[4 * i + 2] AS INTEGER) * 4 + CAST(bits[4 * i + 3] AS INTEGER) * 2 + CAST(bits[4 * i + 4] AS INTEGER) + 1]), '') AS residual,
 CAST(n AS INTEGER) AS nbytes FROM planes""")
def v16(spark, d):
    c = I.compress(tokens(spark, d), codec(spark, d))
    return c.select("pid", "tok_pos", F.hex("residual").alias("residual"), F.length("residual").alias("nbytes"))


@register("V17_compress", BASE + "SELECT pid, CAST(tp AS BIGINT) AS tok_pos, CAST(code AS INTEGER) AS code, array_to_string(b, ',') AS buckets FROM bkt")
def v17(spark, d):
    c = I.compress(tokens(spark, d), codec(spark, d), with_buckets=True)
    return c.select("pid", "tok_pos", "code", F.array_join("buckets", ",").alias("buckets"))


@register("V18_decompress", BASE + f"SELECT pid, CAST(tp AS BIGINT) AS tok_pos, round(list_sum(dv), {R}) AS total, round(dv[1], {R}) AS first FROM decn")
def v18(spark, d):
    ix = index(spark, d)
    dec = I.decompress(ix.codes, ix.codec)
    return dec.select("pid", "tok_pos", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), R).alias("total"),
                      F.round(F.col("embedding")[0], R).alias("first"))


@register("V19_build_inverted_lists", BASE + "SELECT CAST(c.code AS INTEGER) AS code, CAST(COUNT(i.pid) AS BIGINT) AS length FROM cent c LEFT JOIN ivf i ON c.code = i.code GROUP BY c.code")
def v19(spark, d):
    ix = index(spark, d)
    _, lengths = I.build_inverted_lists(ix.codes, ix.codec.centroids)
    return lengths


@register("J12_embedding_to_passage", "SELECT vec_id, vec_id // 8 AS pid FROM embeddings")
def j12(spark, d):
    """Packed offsets to pid: ``explode(sequence(offset, offset+len-1))`` over doclens + W8."""
    from ..operators.ranking import running_offsets
    dl = tokens(spark, d).groupBy("pid").agg(F.count(F.lit(1)).alias("doclen"))
    off = running_offsets(dl, "doclen", ["pid"], offset_col="offset")
    return off.select(F.explode(F.sequence("offset", F.col("offset") + F.col("doclen") - 1)).alias("vec_id"), "pid")


def _stage_sql_default():
    return stage_sql(1, 0.5, 256)


@register("V20_probe_cells", BASE + stage_sql(1, 0.5, 256) + "SELECT qid, CAST(code AS INTEGER) AS code FROM probes")
def v20(spark, d):
    ix = index(spark, d)
    from ..operators.vectors import pack_vectors
    qpacked = pack_vectors(queries(spark, d), "qid", "qtok", "embedding", "qvecs")
    return S.probe_cells(qpacked, ix, 1)


@register("V21_generate_candidates", BASE + stage_sql(2, 0.5, 256) + "SELECT qid, pid FROM cands")
def v21(spark, d):
    ix = index(spark, d)
    from ..operators.vectors import pack_vectors
    qpacked = pack_vectors(queries(spark, d), "qid", "qtok", "embedding", "qvecs")
    return S.generate_candidates(S.probe_cells(qpacked, ix, 2), ix.ivf)


@register("V21_generate_embedding_candidates", BASE + stage_sql(1, 0.5, 256) + """SELECT DISTINCT p.qid, a.pid, a.tp AS tok_pos
 FROM probes p JOIN asg a ON p.code = a.code""")
def v21e(spark, d):
    ix = index(spark, d)
    from ..operators.vectors import pack_vectors
    qpacked = pack_vectors(queries(spark, d), "qid", "qtok", "embedding", "qvecs")
    return S.generate_embedding_candidates(S.probe_cells(qpacked, ix, 1), ix.codes)


@register("S27_lists_from_embeddings", BASE + "SELECT CAST(code AS INTEGER) AS code, pid FROM ivf")
def s27_old(spark, d):
    ix = index(spark, d)
    old = ix.codes.select("code", (F.col("pid") * 8 + F.col("tok_pos")).alias("emb_id"))     # eight vectors a passage
    return I.lists_from_embeddings(old, ix.doclens)


@register("J11_probe_inverted_lists", BASE + stage_sql(1, 0.5, 256) + "SELECT qid, pid FROM cands")
def j11(spark, d):
    ix = index(spark, d)
    from ..operators.vectors import pack_vectors
    qpacked = pack_vectors(queries(spark, d), "qid", "qtok", "embedding", "qvecs")
    return S.generate_candidates(S.probe_cells(qpacked, ix, 1), ix.ivf, list_rows=64)


@register("V22_filter_candidates", BASE + stage_sql(1, 0.5, 256) + """SELECT c.qid, c.pid FROM cands c
 WHERE c.pid IN (SELECT vec_id // 8 FROM embeddings WHERE label < 5)""")
def v22(spark, d):
    ix = index(spark, d)
    from ..operators.vectors import pack_vectors
    qpacked = pack_vectors(queries(spark, d), "qid", "qtok", "embedding", "qvecs")
    cands = S.generate_candidates(S.probe_cells(qpacked, ix, 1), ix.ivf)
    allowed = table(spark, d, "embeddings").filter(F.col("label") < 5).select(F.floor(F.col("vec_id") / 8).cast("long").alias("pid"))
    return S.filter_candidates(cands, allowed)


def _stages(spark, d, ncells, thr, ndocs):
    ix = index(spark, d)
    from ..operators.vectors import pack_vectors
    qpacked = pack_vectors(queries(spark, d), "qid", "qtok", "embedding", "qvecs")
    cands = S.generate_candidates(S.probe_cells(qpacked, ix, ncells), ix.ivf)
    dcodes = S.doc_codes(ix)
    s1 = S.prune(S.approx_scores(cands, qpacked, dcodes, ix, thr), ndocs)
    s2 = S.prune(S.approx_scores(s1.select("qid", "pid"), qpacked, dcodes, ix, None), max(ndocs // 4, 1))
    return ix, qpacked, s1, s2


@register("V23_prune_stage1", BASE + stage_sql(1, 0.5, 16) + f"SELECT qid, pid, round(approx, {R}) AS approx FROM s1")
def v23(spark, d):
    _, _, s1, _ = _stages(spark, d, 1, 0.5, 16)
    return s1.select("qid", "pid", F.round("approx", R).alias("approx"))


@register("V24_prune_stage2", BASE + stage_sql(1, 0.5, 16) + f"SELECT qid, pid, round(approx, {R}) AS approx FROM s2")
def v24(spark, d):
    _, _, _, s2 = _stages(spark, d, 1, 0.5, 16)
    return s2.select("qid", "pid", F.round("approx", R).alias("approx"))


@register("V25_rescore", BASE + stage_sql(1, 0.5, 16) + f"SELECT qid, pid, round(score, {R}) AS score FROM fin")
def v25(spark, d):
    ix, qpacked, _, s2 = _stages(spark, d, 1, 0.5, 16)
    return S.rescore(s2, qpacked, ix).select("qid", "pid", F.round("score", R).alias("score"))


@register("V26_search_all", BASE + stage_sql(1, 0.5, 256) + f"SELECT qid, pid, CAST(rank AS BIGINT) AS rank, round(score, {R}) AS score FROM ranked WHERE rank <= 10")
def v26(spark, d):
    out = S.search_all(queries(spark, d), index(spark, d), k=10)
    return out.select("qid", "pid", "rank", F.round("score", R).alias("score"))


@register("V26_search_all_k100", BASE + stage_sql(2, 0.45, 1024) + f"SELECT qid, pid, CAST(rank AS BIGINT) AS rank, round(score, {R}) AS score FROM ranked WHERE rank <= 100")
def v26b(spark, d):
    out = S.search_all(queries(spark, d), index(spark, d), k=100)
    return out.select("qid", "pid", "rank", F.round("score", R).alias("score"))


@register("V28_lookup_embeddings", BASE + f"""SELECT pid, CAST(tp AS BIGINT) AS tok_pos, round(list_sum(dv), {R}) AS total FROM decn
 WHERE pid IN (SELECT vec_id // 8 FROM embeddings WHERE label = 3)""")
def v28(spark, d):
    ix = index(spark, d)
    pids = table(spark, d, "embeddings").filter(F.col("label") == 3).select(F.floor(F.col("vec_id") / 8).cast("long").alias("pid"))
    out = I.lookup_embeddings(ix, pids)
    return out.select("pid", "tok_pos", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), R).alias("total"))
