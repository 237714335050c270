"""Registered queries: vectors, exact/approximate search, maxsim, in-batch losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as VF
from ..operators import vectors as V
from ..session import table
from .registry import register

R = 6


def emb(spark, d):
    return table(spark, d, "embeddings")


_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_FIRST = "c AS (SELECT e.label, e.v FROM e JOIN (SELECT label, MIN(vec_id) AS m FROM e GROUP BY label) f ON e.vec_id = f.m)"


def _with_first(spark, d):
    e = emb(spark, d)
    first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id")).join(e.select("vec_id", F.col("embedding").alias("c")), "vec_id")
    return e.join(first.select("label", "c"), "label")


@register("V1_dot", f"WITH {_E}, {_FIRST} SELECT e.vec_id, round(list_dot_product(e.v, c.v), {R}) AS s FROM e JOIN c ON e.label = c.label")
def v1(spark, d):
    return _with_first(spark, d).select("vec_id", F.round(VF.dot("embedding", "c"), R).alias("s"))


@register("V2_cosine", f"""WITH {_E}, {_FIRST} SELECT e.vec_id,
 round(list_dot_product(e.v, c.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(c.v, c.v))), {R}) AS s FROM e JOIN c ON e.label = c.label""")
def v2(spark, d):
    return _with_first(spark, d).select("vec_id", F.round(VF.cosine("embedding", "c"), R).alias("s"))


@register("V3_l2_normalize", f"""WITH {_E}, s AS (SELECT vec_id, list_transform(v, lambda x: x * (1 + label)) AS w FROM e)
SELECT vec_id, round(list_sum(list_transform(w, lambda x: x / sqrt(list_dot_product(w, w)))), {R}) AS total,
 round(w[1] / sqrt(list_dot_product(w, w)), {R}) AS first FROM s""")
def v3(spark, d):
    e = emb(spark, d).select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (1 + F.col("label"))).alias("w"))
    n = VF.l2_normalize("w")
    return e.select("vec_id", F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), R).alias("total"),
                    F.round(n[0], R).alias("first"))


_KNN_SQL = """WITH {e}, s AS (SELECT q.vec_id AS qid, d.vec_id AS pid, list_dot_product(q.v, d.v) AS score FROM e q, e d {where}),
r AS (SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM s)
SELECT qid, pid, round(score, {R}) AS score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 10"""


def _knn_out(df):
    return df.select("qid", "pid", F.round("score", R).alias("score"), "rank")


@register("V7_knn_flat", _KNN_SQL.format(e=_E, where="", R=R))
def v7(spark, d):
    e = emb(spark, d)
    q = e.select(F.col("vec_id").alias("qid"), "embedding")
    docs = e.select(F.col("vec_id").alias("pid"), "embedding")
    return _knn_out(V.knn_flat(q, docs, 10))


@register("V7_knn_flat_columns", _KNN_SQL.format(e=_E, where="", R=R))
def v7c(spark, d):
    e = emb(spark, d)
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    docs = e.select(F.col("vec_id").alias("pid"), "embedding")
    return _knn_out(V.knn_flat(q, docs, 10, qvec="qvec"))


@register("V7_knn_balls", _KNN_SQL.format(e=_E, where="", R=R))
def v7_balls(spark, d):
    e = emb(spark, d)
    balls = V.document_balls(e.select(F.col("vec_id").alias("pid"), "embedding"))
    return _knn_out(V.knn_balls(e.select(F.col("vec_id").alias("qid"), "embedding"), balls, 10))


@register("V34_knn_filtered", _KNN_SQL.format(e=_E, where="WHERE d.label < 5", R=R))
def v34(spark, d):
    e = emb(spark, d)
    q = e.select(F.col("vec_id").alias("qid"), "embedding")
    docs = e.filter(F.col("label") < 5).select(F.col("vec_id").alias("pid"), "embedding")
    return _knn_out(V.knn_flat(q, docs, 10))


@register("V7_knn_flat_l2", f"""WITH {_E}, s AS (SELECT q.vec_id AS qid, d.vec_id AS pid,
  -(list_dot_product(q.v, q.v) + list_dot_product(d.v, d.v) - 2 * list_dot_product(q.v, d.v)) AS score FROM e q, e d),
r AS (SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM s)
SELECT qid, pid, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 10""")
def v7l2(spark, d):
    e = emb(spark, d)
    q = e.select(F.col("vec_id").alias("qid"), "embedding")
    docs = e.select(F.col("vec_id").alias("pid"), "embedding")
    return V.knn_flat(q, docs, 10, metric="l2").select("qid", "pid", "rank")


# ---- multi-vector: first stage = token kNN, second stage = maxsim --------------------------------

_TOK = "tok AS (SELECT vec_id, vec_id // 8 AS pid, vec_id % 8 AS tp, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_SIMS = """sims AS (SELECT q.pid AS qid, q.tp AS qtp, d.pid, d.vec_id AS dvec, list_dot_product(q.v, d.v) AS s,
   -(list_dot_product(q.v, q.v) + list_dot_product(d.v, d.v) - 2 * list_dot_product(q.v, d.v)) AS l2 FROM tok q, tok d),
cand AS (SELECT DISTINCT qid, pid FROM (SELECT qid, pid, row_number() OVER (PARTITION BY qid, qtp ORDER BY s DESC, dvec) AS rn FROM sims) WHERE rn <= 10),
ms AS (SELECT qid, pid, SUM(m) AS score, SUM(ml2) AS score_l2 FROM (SELECT s.qid, s.qtp, s.pid, MAX(s.s) AS m, MAX(s.l2) AS ml2
       FROM sims s JOIN cand c ON s.qid = c.qid AND s.pid = c.pid GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


def multivector(spark, d):
    e = emb(spark, d)
    toks = e.select("vec_id", F.floor(F.col("vec_id") / 8).cast("long").alias("pid"),
                    (F.col("vec_id") % 8).cast("long").alias("tp"), "embedding")
    return toks


def token_candidates(toks, k=10):
    """Stage 1: exact kNN of every query token over all document tokens; candidate documents are
    the distinct owners of the hits."""
    q = toks.select(F.col("pid").alias("qid"), F.col("tp").alias("qtp"), "embedding")
    d = toks.select(F.col("vec_id").alias("dvec"), "embedding")
    hits = V.knn_flat(q, d, k, qkeys=("qid", "qtp"), did="dvec")
    owner = toks.select(F.col("vec_id").alias("dvec"), "pid")
    return hits.join(owner, "dvec").select("qid", "pid").distinct()


def _maxsim(spark, d, variant):
    toks = multivector(spark, d)
    packed = V.pack_vectors(toks, "pid", "tp", element="float")
    cand = token_candidates(toks)
    return V.maxsim(cand, packed.withColumnRenamed("pid", "qid").withColumnRenamed("vecs", "qvecs"),
                    packed.withColumnRenamed("vecs", "dvecs"), V.vector_dim(toks), variant=variant)


@register("V4_maxsim", f"WITH {_TOK}, {_SIMS} SELECT qid, pid, round(score, {R}) AS score FROM ms")
def v4(spark, d):
    return _maxsim(spark, d, "colbert").select("qid", "pid", F.round("score", R).alias("score"))


@register("V4_maxsim_join", f"WITH {_TOK}, {_SIMS} SELECT qid, pid, round(score, {R}) AS score FROM ms")
def v4j(spark, d):
    toks = multivector(spark, d)
    cand = token_candidates(toks)
    qtok = toks.select(F.col("pid").alias("qid"), F.col("tp").alias("qpos"), F.col("embedding").alias("qvec"))
    dtok = toks.select("pid", F.col("embedding").alias("dvec"))
    return V.maxsim_join(cand, qtok, dtok).select("qid", "pid", F.round("score", R).alias("score"))


@register("V5_maxsim_l2", f"WITH {_TOK}, {_SIMS} SELECT qid, pid, round(score_l2, {R}) AS score FROM ms")
def v5(spark, d):
    return _maxsim(spark, d, "l2").select("qid", "pid", F.round("score", R).alias("score"))


@register("V6_maxsim_flipr", f"WITH {_TOK}, {_SIMS} SELECT qid, pid, round(score, {R}) AS score FROM ms")
def v6(spark, d):
    return _maxsim(spark, d, "flipr").select("qid", "pid", F.round("score", R).alias("score"))


# queries of 80 vectors, so both cuts of the measure are reached; candidates: passages of the ten nearest of all vectors to each
@register("V6_maxsim_flipr_long", f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT vec_id // 80 AS qid, vec_id % 80 AS qp, v FROM e), p AS (SELECT vec_id // 8 AS pid, v FROM e),
near AS (SELECT qid, vec_id // 8 AS pid, row_number() OVER (PARTITION BY qid, qp ORDER BY list_dot_product(q.v, e.v) DESC, vec_id) AS rn FROM q, e),
cand AS (SELECT DISTINCT qid, pid FROM near WHERE rn <= 10),
m AS (SELECT c.qid, c.pid, qp, MAX(list_dot_product(q.v, p.v)) AS s FROM cand c JOIN q ON q.qid = c.qid JOIN p ON p.pid = c.pid GROUP BY ALL),
l AS (SELECT qid, pid, list_reverse_sort(coalesce(list(s) FILTER (WHERE qp < 64), [])) AS a, list_reverse_sort(coalesce(list(s) FILTER (WHERE qp >= 64), [])) AS b FROM m GROUP BY ALL)
SELECT qid, pid, round(list_sum(a[1:32]) + CASE WHEN len(b) >= 8 THEN list_sum(b[1:8]) ELSE 0 END, {R}) AS score FROM l""")
def v6_long(spark, d):
    e = emb(spark, d)
    q = e.select(F.floor(F.col("vec_id") / 80).cast("long").alias("qid"), (F.col("vec_id") % 80).alias("qp"), "embedding")
    p = e.select(F.floor(F.col("vec_id") / 8).cast("long").alias("pid"), (F.col("vec_id") % 8).alias("tp"), "embedding")
    near = V.knn_flat(q, e.select("vec_id", "embedding"), 10, ("qid", "qp"), did="vec_id")
    pairs = near.select("qid", F.floor(F.col("vec_id") / 8).cast("long").alias("pid")).distinct()
    out = V.maxsim(pairs, V.pack_vectors(q, "qid", "qp", "embedding", "qvecs", "float"),
                   V.pack_vectors(p, "pid", "tp", "embedding", "dvecs", "float"),
                   V.vector_dim(e), variant="flipr")
    return out.select("qid", "pid", F.round("score", R).alias("score"))


@register("V27_rerank", f"""WITH {_TOK}, {_SIMS}, r AS (SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM ms)
SELECT CAST(qid AS VARCHAR) AS qid, 'Q0' AS q0, CAST(pid AS VARCHAR) AS docid, CAST(rank AS BIGINT) AS rank, round(score, {R}) AS score, 'maxsim' AS tag FROM r WHERE rank <= 10""")
def v27(spark, d):
    from ..operators.search import rerank_to_trec
    scored = _maxsim(spark, d, "colbert")
    return rerank_to_trec(scored, 10, "maxsim").withColumn("score", F.round("score", R))


@register("V8_mips_transform", f"""WITH {_E}, n AS (SELECT vec_id, list_dot_product(v, v) AS n2 FROM e)
SELECT vec_id, round(sqrt(GREATEST((SELECT MAX(n2) FROM n) - n2, 0)), {R}) AS aug FROM n""")
def v8t(spark, d):
    return V.mips_to_l2(emb(spark, d).select("vec_id", "embedding")).select("vec_id", F.round("aug", R).alias("aug"))


@register("V8_knn_approx")
def v8(spark, d):
    e = emb(spark, d)
    q = e.select(F.col("vec_id").alias("qid"), "embedding")
    docs = e.select(F.col("vec_id").alias("pid"), "embedding")
    return V.knn_approx(q, docs, 10)


@register("V9_quantize_8bit", """WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
r AS (SELECT dim, MIN(x) AS lo, MAX(x) AS hi FROM x GROUP BY dim)
SELECT x.vec_id, CAST(x.dim AS INTEGER) AS dim, CAST(CASE WHEN hi > lo THEN LEAST(floor(255 * (x.x - lo) / (hi - lo)), 255) ELSE 0 END AS INTEGER) AS code
FROM x JOIN r ON x.dim = r.dim""")
def v9(spark, d):
    return V.quantize_8bit(emb(spark, d).select("vec_id", "embedding"))


_A14_SQL = (f"""WITH {_E}, g AS (SELECT e.vec_id AS qid, e.v AS qv, list_dot_product(e.v, c.v) AS gs FROM e JOIN {_FIRST.split(' AS ')[0]} c ON e.label = c.label)
SELECT g.qid, CAST(SUM(CASE WHEN list_dot_product(g.qv, d.v) > g.gs THEN 1 ELSE 0 END) AS BIGINT) AS gold_rank FROM g, e d GROUP BY g.qid""".replace(
    f"WITH {_E}, g AS", f"WITH {_E}, {_FIRST}, g AS"))


def _questions(e):
    first = e.groupBy("label").agg(F.min("vec_id").alias("gold_cid"))
    questions = e.select(F.col("vec_id").alias("qid"), "embedding", "label").join(first, "label").drop("label")
    return questions, e.select(F.col("vec_id").alias("cid"), "embedding")


@register("A14_average_rank", _A14_SQL)
def a14(spark, d):
    return V.average_rank(*_questions(emb(spark, d)))


@register("A14_average_rank_balls", _A14_SQL)
def a14_balls(spark, d):
    return V.average_rank_balls(*_questions(emb(spark, d))).drop("met")


_BATCH = f"""WITH {_E}, b AS (SELECT q.vec_id AS qid, q.vec_id // 16 AS batch, q.v AS qv, c.v AS cv FROM e q JOIN e c ON c.vec_id = xor(q.vec_id, 1)),
s AS (SELECT x.batch, x.qid, y.qid AS cq, list_dot_product(x.qv, y.cv) AS s FROM b x JOIN b y ON x.batch = y.batch),
m AS (SELECT batch, qid, MAX(s) AS mx FROM s GROUP BY 1, 2),
l AS (SELECT s.batch, s.qid, m.mx + ln(SUM(exp(s.s - m.mx))) AS lse, SUM(s.s) AS tot, COUNT(*) AS n FROM s JOIN m ON s.batch = m.batch AND s.qid = m.qid GROUP BY 1, 2, m.mx),
a AS (SELECT batch, qid, cq FROM (SELECT batch, qid, cq, row_number() OVER (PARTITION BY batch, qid ORDER BY s DESC, cq) AS rn FROM s) WHERE rn = 1),
g AS (SELECT batch, qid, s AS gs FROM s WHERE qid = cq)"""


def _inbatch(spark, d):
    e = emb(spark, d)
    c = e.select((F.col("vec_id").bitwiseXOR(F.lit(1))).alias("vec_id"), F.col("embedding").alias("cvec"))
    rows = e.join(c, "vec_id").select(F.floor(F.col("vec_id") / 16).cast("long").alias("batch"),
                                      F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), "cvec")
    return V.inbatch_scores(rows)


@register("A15_inbatch_nll", _BATCH + f""" SELECT l.batch, l.qid, round(l.lse - g.gs, {R}) AS nll, CAST(a.cq = l.qid AS BIGINT) AS correct
FROM l JOIN g ON l.batch = g.batch AND l.qid = g.qid JOIN a ON l.batch = a.batch AND l.qid = a.qid""")
def a15(spark, d):
    s = _inbatch(spark, d)
    return s.select("batch", "qid", F.round(F.col("lse") - F.col("gold_score"), R).alias("nll"),
                    (F.col("argmax") == F.col("pos")).cast("long").alias("correct"))


@register("J15_pairwise_similarity", _BATCH + f" SELECT batch, qid, CAST(n AS BIGINT) AS n, round(tot, {R}) AS total FROM l")
def j15(spark, d):
    s = _inbatch(spark, d)
    return s.select("batch", "qid", F.size("scores").cast("long").alias("n"),
                    F.round(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x), R).alias("total"))
