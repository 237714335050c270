"""Registered queries: retrieval with the built-in encoder, answer matching and QA metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import qa as QA
from ..operators.corpus import answers_in_corpus
from ..operators.ranking import first_hit
from ..operators.vectors import knn_flat
from ..session import cut, small, table
from .q_text import sql_norm_answer, sql_tok
from .registry import register

R = 6
K = 20
DIM = 64

_BUCKET = ("((strpos('0123456789abcdef', substr(md5(t), 1, 1)) - 1) * 16 + "
           "strpos('0123456789abcdef', substr(md5(t), 2, 1)) - 1) % 64")

_ENC = f"""dt AS (SELECT doc_id, unnest({sql_tok('lower(text)')}) AS t FROM documents),
db AS (SELECT doc_id, {_BUCKET} AS b, COUNT(*) AS n FROM dt GROUP BY 1, 2),
dw AS (SELECT doc_id, b, n / sqrt(SUM(n * n) OVER (PARTITION BY doc_id)) AS w FROM db),
qt AS (SELECT item_id, unnest({sql_tok('lower(text)')}) AS t FROM benchmark),
qb AS (SELECT item_id, {_BUCKET} AS b, COUNT(*) AS n FROM qt GROUP BY 1, 2),
qw AS (SELECT item_id, b, n / sqrt(SUM(n * n) OVER (PARTITION BY item_id)) AS w FROM qb),
sc AS (SELECT q.item_id AS qid, d.doc_id AS pid, round(SUM(q.w * d.w), 10) AS score FROM qw q JOIN dw d ON q.b = d.b GROUP BY 1, 2),
rk AS (SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM sc),
top AS (SELECT qid, pid, score, rank FROM rk WHERE rank <= {K})"""


def _mt(x: str) -> str:
    return f"(' ' || array_to_string({sql_tok(f'lower(nfc_normalize({x}))')}, ' ') || ' ')"


def ranked(spark, d):
    """Benchmark items retrieve documents: hashed-bag vectors, exact inner-product top-K."""
    docs = table(spark, d, "documents")
    b = table(spark, d, "benchmark")
    # the vectors are written: the search counts their bytes before it deals them out
    dv = cut(QA.encode_hashed_bag(docs, "doc_id", "text", DIM).withColumnRenamed("doc_id", "pid"))
    qv = cut(QA.encode_hashed_bag(b, "item_id", "text", DIM).withColumnRenamed("item_id", "qid"))
    return knn_flat(qv, dv, K, score_digits=10)


def _pairs(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pid"), "text", "source")
    ans = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.array("text").alias("answers"))
    return small(cut(ranked(spark, d))).join(docs, "pid").join(ans, "qid")     # the texts stay where they are


@register("V29_encode_hashed_bag", f"WITH {_ENC} SELECT doc_id, CAST(b AS INTEGER) AS b, round(w, {R}) AS w FROM dw")
def v29(spark, d):
    w = QA.hashed_bag_weights(table(spark, d, "documents"), "doc_id", "text", DIM)
    return w.select("doc_id", "b", F.round("w", R).alias("w"))


@register("V29_encode_dense", f"WITH {_ENC} SELECT doc_id, round(SUM(w), {R}) AS total, CAST(COUNT(*) AS BIGINT) AS nnz FROM dw GROUP BY doc_id")
def v29d(spark, d):
    e = QA.encode_hashed_bag(table(spark, d, "documents"), "doc_id", "text", DIM)
    return e.select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), R).alias("total"),
                    F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("nnz"))


@register("J7_results_with_passages", f"""WITH {_ENC} SELECT t.qid, t.pid, CAST(t.rank AS BIGINT) AS rank, round(t.score, {R}) AS score, d.source
 FROM top t JOIN documents d ON t.pid = d.doc_id""")
def j7(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pid"), "source")
    r = QA.results_with_passages(ranked(spark, d), docs)
    return r.select("qid", "pid", "rank", F.round("score", R).alias("score"), "source")


_J8_STRING = f"""WITH {_ENC},
j AS (SELECT t.qid, t.pid, t.rank, {_mt('d.text')} AS dm, {_mt('b.text')} AS am FROM top t JOIN documents d ON t.pid = d.doc_id JOIN benchmark b ON t.qid = b.item_id)
"""


def _ranked_inputs(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pid"), "text")
    ans = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.array("text").alias("answers"))
    return ranked(spark, d), docs, ans


@register("J8_answer_in_passage", _J8_STRING + "SELECT qid, pid, CAST(length(trim(am)) > 0 AND contains(dm, am) AS BIGINT) AS has_answer FROM j")
def j8(spark, d):
    out = QA.answer_in_passage(_pairs(spark, d), "string")
    return out.select("qid", "pid", F.col("has_answer").cast("long"))


@register("J8_answer_in_ranked", _J8_STRING + "SELECT qid, pid, CAST(length(trim(am)) > 0 AND contains(dm, am) AS BIGINT) AS has_answer FROM j")
def j8r2(spark, d):
    """The same check with each passage normalised once however many questions retrieved it."""
    out = QA.answer_in_ranked(*_ranked_inputs(spark, d), mode="string")
    return out.select("qid", "pid", F.col("has_answer").cast("long"))


@register("J8_answer_in_passage_kilt", f"""WITH {_ENC},
j AS (SELECT t.qid, t.pid, {sql_norm_answer('d.text')} AS dn, {sql_norm_answer('b.text')} AS an FROM top t JOIN documents d ON t.pid = d.doc_id JOIN benchmark b ON t.qid = b.item_id)
SELECT qid, pid, CAST(length(an) > 0 AND contains(dn, an) AS BIGINT) AS has_answer FROM j""")
def j8k(spark, d):
    out = QA.answer_in_ranked(*_ranked_inputs(spark, d), mode="kilt")
    return out.select("qid", "pid", F.col("has_answer").cast("long"))


# the answers as patterns: special characters escaped, any white space between words
@register("J8_answer_in_passage_regex", f"""WITH {_ENC}, p AS (SELECT item_id, regexp_replace(regexp_replace(nfc_normalize(text),
  '([.^$*+?()\\[\\]{{}}|])', '\\\\\\1', 'g'), '\\s+', '\\\\s+', 'g') AS pat FROM benchmark)
SELECT t.qid, t.pid, CAST(regexp_matches(nfc_normalize(d.text), p.pat, 'i') AS BIGINT) AS has_answer
FROM top t JOIN documents d ON t.pid = d.doc_id JOIN p ON t.qid = p.item_id""")
def j8r(spark, d):
    p = _pairs(spark, d).withColumn("answers", F.transform("answers", lambda a: F.regexp_replace(
        F.regexp_replace(a, r"([.^$*+?()\[\]{}|])", r"\\$1"), r"\s+", r"\\s+")))
    out = QA.answer_in_passage(p, "regex")
    return out.select("qid", "pid", F.col("has_answer").cast("long"))


@register("J8_answer_in_corpus", f"""WITH dm AS (SELECT doc_id, {_mt('text')} AS dm FROM documents),
am AS (SELECT item_id, {_mt('text')} AS am FROM benchmark)
SELECT am.item_id AS qid, dm.doc_id AS pid FROM am, dm WHERE length(trim(am.am)) > 0 AND contains(dm.dm, am.am)""")
def j8c(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pid"), "text")
    ans = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("answer"))
    return answers_in_corpus(ans, docs)


@register("D15_annotate_ranking", _J8_STRING + "SELECT qid, pid, CAST(rank AS BIGINT) AS rank, CAST(length(trim(am)) > 0 AND contains(dm, am) AS BIGINT) AS label FROM j")
def d15(spark, d):
    out = QA.answer_in_passage(_pairs(spark, d), "string", out="label")
    return out.select("qid", "pid", "rank", F.col("label").cast("long"))


@register("J5_expand_ranking", f"""WITH {_ENC} SELECT t.qid, t.pid, CAST(t.rank AS BIGINT) AS rank, CAST(length(d.text) AS BIGINT) AS passage_chars,
 CAST(length(b.text) AS BIGINT) AS answer_chars FROM top t JOIN documents d ON t.pid = d.doc_id JOIN benchmark b ON t.qid = b.item_id""")
def j5(spark, d):
    p = _pairs(spark, d)
    return p.select("qid", "pid", "rank", F.length("text").cast("long").alias("passage_chars"),
                    F.length(F.get("answers", 0)).cast("long").alias("answer_chars"))


_CURVE = """, fh AS (SELECT qid, MIN(CASE WHEN hit THEN rank END) AS f FROM h GROUP BY qid),
ks AS (SELECT range AS k FROM range(1, 21)),
pr AS (SELECT f AS k, COUNT(*) AS c FROM fh WHERE f IS NOT NULL GROUP BY f),
cum AS (SELECT ks.k, SUM(COALESCE(pr.c, 0)) OVER (ORDER BY ks.k ROWS UNBOUNDED PRECEDING) AS cc FROM ks LEFT JOIN pr ON ks.k = pr.k)
SELECT CAST(k AS BIGINT) AS k, round(cc * 1.0 / (SELECT COUNT(*) FROM fh), 6) AS accuracy FROM cum"""


@register("A6_topk_hit_accuracy_qa", _J8_STRING + ", h AS (SELECT qid, rank, length(trim(am)) > 0 AND contains(dm, am) AS hit FROM j)" + _CURVE)
def a6qa(spark, d):
    out = QA.answer_in_passage(_pairs(spark, d), "string")
    return M.first_hit_curve(first_hit(out), 20).withColumn("accuracy", F.round("accuracy", R))


@register("A8_topk_hit_accuracy_meta", f"""WITH {_ENC},
j AS (SELECT t.qid, t.rank, {_mt("d.source || ' . ' || d.text")} AS dm, {_mt('b.text')} AS am FROM top t JOIN documents d ON t.pid = d.doc_id JOIN benchmark b ON t.qid = b.item_id),
h AS (SELECT qid, rank, length(trim(am)) > 0 AND contains(dm, am) AS hit FROM j)""" + _CURVE)
def a8(spark, d):
    p = _pairs(spark, d).withColumn("text", F.concat(F.col("source"), F.lit(" . "), F.col("text")))
    out = QA.answer_in_passage(p, "string")
    return M.first_hit_curve(first_hit(out), 20).withColumn("accuracy", F.round("accuracy", R))


@register("D10_answer_spans", f"""WITH {_ENC}, j AS (SELECT t.qid, t.pid, {sql_tok('lower(d.text)')} AS a, {sql_tok('lower(b.text)')} AS w
  FROM top t JOIN documents d ON t.pid = d.doc_id JOIN benchmark b ON t.qid = b.item_id),
s AS (SELECT qid, pid, list_filter(range(0, CAST(greatest(len(a) - len(w) + 1, 0) AS BIGINT)), lambda i: a[i + 1:i + len(w)] = w) AS st FROM j)
SELECT qid, pid, CAST(len(st) AS BIGINT) AS n_spans, CAST(st[1] AS BIGINT) AS first_start FROM s""")
def d10(spark, d):
    from ..functions.text import tokenize
    p = _pairs(spark, d)
    sp = QA.answer_spans(tokenize(F.lower("text")), tokenize(F.lower(F.get("answers", 0))))
    return p.select("qid", "pid", F.size(sp).cast("long").alias("n_spans"), F.get(sp, 0)["start"].cast("long").alias("first_start"))


@register("A12_exact_match_by_topk", f"""WITH {_ENC}, p AS (SELECT t.qid, n.n, d.text AS prediction FROM top t JOIN documents d ON t.pid = d.doc_id,
  (SELECT unnest([1, 5, 20]) AS n) n WHERE t.rank = 1),
e AS (SELECT p.n, p.qid, MAX(CASE WHEN {sql_norm_answer('p.prediction')} = {sql_norm_answer('b.text')} THEN 1 ELSE 0 END) AS em
  FROM p JOIN benchmark b ON p.qid = b.item_id GROUP BY 1, 2)
SELECT CAST(n AS BIGINT) AS n, round(AVG(em), {R}) AS em FROM e GROUP BY n""")
def a12(spark, d):
    top1 = _pairs(spark, d).filter(F.col("rank") == 1)
    ns = spark.createDataFrame([(1,), (5,), (20,)], "n long")
    preds = top1.select("qid", F.col("text").alias("prediction")).crossJoin(F.broadcast(ns))  # 3 fixed thresholds
    answers = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("answer"))
    return QA.exact_match_by_topk(preds, answers).withColumn("em", F.round("em", R))
