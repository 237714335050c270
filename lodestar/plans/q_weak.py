"""Registered queries: weak supervision and training-set construction (J1-J3, J6, J10, J13, J14,
J16, D2-D5, D8, D12, D14, S20, S26)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import weak as WK
from ..session import table
from . import bindings as B
from .q_text import _TRIPLES_SQL, content_documents_from_orders, sql_tok
from .registry import register

R = 6


def _order_metadata(spark, d):
    from ..functions.text import metadata_document
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("did"),
                    metadata_document(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderdate").cast("string")).alias("document"))


_CONTENT = _TRIPLES_SQL.replace("WITH tr AS", "tr AS").replace(
    "SELECT o.o_orderkey AS dataset_id, COALESCE(d.document, '') AS document FROM orders o LEFT JOIN docs d ON o.o_orderkey = d.dataset_id\nWHERE o.o_orderstatus IS NOT NULL",
    "")
_CONTENT = _CONTENT.rstrip().rstrip(",")


@register("J1_training_pairs", "WITH " + _CONTENT + """,
content AS (SELECT o.o_orderkey AS did, COALESCE(d.document, '') AS document FROM orders o LEFT JOIN docs d ON o.o_orderkey = d.dataset_id WHERE o.o_orderstatus IS NOT NULL),
meta AS (SELECT o_orderkey AS did, '[CLS] ' || concat_ws(' [SEP] ', o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')) || ' [SEP]' AS document FROM orders),
q AS (SELECT o_custkey AS qid, o_orderkey AS did, CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 ELSE 0 END AS rel FROM orders)
SELECT q.qid, q.did, CAST(q.rel AS INTEGER) AS rel, c.c_name AS query, m.document AS metadata, ct.document AS content
FROM q JOIN customer c ON q.qid = c.c_custkey JOIN meta m ON q.did = m.did JOIN content ct ON q.did = ct.did WHERE q.rel <> 0""")
def j1(spark, d):
    qrels = B.qrels_orders(spark, d).filter(F.col("rel") != 0).select("qid", F.col("docid").cast("long").alias("did"), "rel")
    queries = table(spark, d, "customer").select(F.col("c_custkey").alias("qid"), F.col("c_name").alias("query"))
    content = content_documents_from_orders(spark, d).withColumnRenamed("dataset_id", "did")
    pairs, _ = WK.training_pairs(qrels, queries, _order_metadata(spark, d), content)
    return pairs.select("qid", "did", "rel", "query", "metadata", "content")


@register("J2_unannotated", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j2(spark, d):
    return WK.unannotated(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@register("J3_restrict_to_judged", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def j3(spark, d):
    return WK.restrict_to_judged(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@register("S26_read_judged_dataset_ids", "SELECT DISTINCT doc_id FROM labels")
def s26(spark, d):
    return table(spark, d, "labels").select("doc_id").distinct()


_GEN_SQL = f"""t AS (SELECT doc_id, unnest({sql_tok('lower(text)')}) AS tok FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
c AS (SELECT doc_id, tok, COUNT(*) AS cnt FROM t WHERE length(tok) >= 4 GROUP BY 1, 2),
r AS (SELECT doc_id, tok, cnt, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, tok) AS rn FROM c),
g AS (SELECT doc_id, string_agg(tok, ' ' ORDER BY rn) AS prediction, 1.0 / (1.0 + MAX(CASE WHEN rn = 1 THEN cnt END)) AS loss FROM r WHERE rn <= 3 GROUP BY doc_id)"""


def _generated(spark, d):
    unj = WK.unannotated(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")
    return WK.frequent_token_generator(unj, "doc_id", "text")


@register("D2_generate_queries", f"WITH {_GEN_SQL} SELECT doc_id, prediction, round(loss, {R}) AS loss FROM g")
def d2(spark, d):
    return _generated(spark, d).withColumn("loss", F.round("loss", R))


@register("D3_confidence_filter", f"WITH {_GEN_SQL} SELECT doc_id, prediction FROM g WHERE NOT (loss > 0.2)")
def d3(spark, d):
    return WK.confidence_filter(_generated(spark, d), 0.2).select("doc_id", "prediction")


@register("D4_pseudo_pairs", f"WITH {_GEN_SQL} SELECT prediction AS query, doc_id AS positive_id FROM g")
def d4(spark, d):
    return WK.pseudo_pairs(_generated(spark, d), "doc_id")


_LAB = B.with_ctes(B.SQL_RANKING_EVENTS, "lab AS (SELECT r.qid, r.pid, r.rank, e.event_type = 'purchase' AS has_answer, "
                   "CASE WHEN e.event_type = 'purchase' THEN 1 ELSE 0 END AS label FROM ranking r JOIN events e ON r.pid = e.event_id)")


def _labelled(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("pid"), (F.col("event_type") == "purchase").alias("has_answer"))
    return B.ranking_events(spark, d).join(e, "pid").withColumn("label", F.col("has_answer").cast("int"))


@register("D5_mine_from_ranking", _LAB + """, x AS (SELECT *, COALESCE(SUM(CAST(has_answer AS INTEGER)) OVER w, 0) AS p,
  COALESCE(SUM(CAST(NOT has_answer AS INTEGER)) OVER w, 0) AS n FROM lab
  WINDOW w AS (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT qid, pid, CAST(rank AS BIGINT) AS rank, CAST(has_answer AS BIGINT) AS positive FROM x WHERE NOT ((p >= 10 AND n >= 10) OR n >= 30)""")
def d5(spark, d):
    out = WK.mine_from_ranking(_labelled(spark, d))
    return out.select("qid", "pid", "rank", F.col("has_answer").cast("long").alias("positive"))


@register("D8_make_triples", _LAB + """, pos AS (SELECT qid, pid AS pos FROM (SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r
  FROM lab WHERE label = 1 AND rank <= 10) WHERE r <= 3),
neg AS (SELECT qid, pid AS neg FROM lab WHERE label = 0 AND rank <= 30)
SELECT pos.qid, pos.pos, neg.neg FROM pos JOIN neg ON pos.qid = neg.qid""")
def d8(spark, d):
    return WK.make_triples(_labelled(spark, d), max_best=3, max_depth=10, depth=30)


_SAMPLES_SQL = """s AS (SELECT user_id AS qid, user_id // 8 AS batch,
  list(event_id ORDER BY event_id) FILTER (WHERE event_type = 'purchase') AS positives,
  list(event_id ORDER BY event_id) FILTER (WHERE event_type = 'view') AS negatives,
  COALESCE(list(event_id ORDER BY event_id) FILTER (WHERE event_type = 'click'), []) AS hard_negatives
  FROM events GROUP BY user_id HAVING COUNT(*) FILTER (WHERE event_type = 'purchase') > 0)"""


#: Hard and other negatives of a question in a batch.
NUM_HARD, NUM_OTHER = 2, 4


def _samples(spark, d, keep: int):
    """Per user: purchases (positives), views (negatives), clicks (hard negatives), in id order.
    Only the first ``keep`` of each list can be used by the batch, so rows are cut per
    (user, type) with a window limit before grouping: a user holding a third of all events still
    forms a bounded list."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    cut = e.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep)

    def ids(t):
        return F.array_sort(F.collect_list(F.when(F.col("event_type") == t, F.col("event_id"))))
    g = cut.groupBy(F.col("user_id").alias("qid")).agg(ids("purchase").alias("positives"), ids("view").alias("negatives"),
                                                       ids("click").alias("hard_negatives"))
    return g.filter(F.size("positives") > 0).withColumn("batch", F.floor(F.col("qid") / 8).cast("long"))


@register("D12_compose_batch", "WITH " + _SAMPLES_SQL + """,
c AS (SELECT batch, qid, positives[1] AS positive, COALESCE(negatives, [])[1:4] AS negs,
  CASE WHEN len(hard_negatives) = 0 THEN COALESCE(negatives, [])[1:2] ELSE hard_negatives[1:2] END AS hards FROM s),
o AS (SELECT *, COALESCE(SUM(1 + len(negs) + len(hards)) OVER (PARTITION BY batch ORDER BY qid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS positive_idx FROM c)
SELECT batch, qid, positive, array_to_string(negs, ',') AS negs, array_to_string(hards, ',') AS hards, CAST(positive_idx AS BIGINT) AS positive_idx,
  array_to_string(list_transform(hards, lambda x, i: positive_idx + len(negs) + i), ',') AS hard_idx FROM o""")
def d12(spark, d):
    out = WK.compose_batch(_samples(spark, d, max(NUM_HARD, NUM_OTHER)), num_hard=NUM_HARD, num_other=NUM_OTHER)
    return out.select("batch", "qid", "positive", F.array_join("negs", ",").alias("negs"), F.array_join("hards", ",").alias("hards"),
                      "positive_idx", F.array_join("hard_idx", ",").alias("hard_idx"))


_PAIR_SQL = """pairs AS (SELECT u.conv_id * 1000 + u.turn AS qid, u.text AS query, a.conv_id * 1000 + a.turn AS pid, a.text AS passage
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def _conv_pairs(spark, d):
    c = table(spark, d, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("passage"),
                                                      (F.col("conv_id") * 1000 + F.col("turn")).alias("pid"))
    j = u.join(a, ["conv_id", "turn"]).withColumn("qid", F.col("conv_id") * 1000 + F.col("turn"))
    return j


_SCORE_SQL = f"""len(list_distinct(list_intersect(list_transform({sql_tok('query')}, lambda t: lower(t)), list_transform({sql_tok('passage')}, lambda t: lower(t)))))"""


@register("J16_score_pairs", f"WITH {_PAIR_SQL} SELECT qid, pid, CAST({_SCORE_SQL} AS DOUBLE) AS score FROM pairs")
def j16(spark, d):
    j = _conv_pairs(spark, d)
    return WK.score_pairs(j.select("qid", "pid"), j.select("qid", "query"), j.select("pid", "passage"))


@register("D14_teacher_scores", f"""WITH {_PAIR_SQL}, s AS (SELECT qid // 1000 AS conv, pid, CAST({_SCORE_SQL} AS DOUBLE) AS score FROM pairs),
r AS (SELECT conv, pid, score, row_number() OVER (PARTITION BY conv ORDER BY score DESC, pid) AS rn FROM s)
SELECT conv AS qid, string_agg(CAST(pid AS VARCHAR) || ':' || CAST(score AS VARCHAR), ',' ORDER BY rn) AS pids FROM r WHERE rn <= 3 GROUP BY conv""")
def d14(spark, d):
    j = _conv_pairs(spark, d)
    sc = WK.score_pairs(j.select("qid", "pid"), j.select("qid", "query"), j.select("pid", "passage"))
    ex = WK.teacher_examples(sc.withColumn("qid", F.floor(F.col("qid") / 1000).cast("long")), nway=3)
    return ex.select("qid", F.array_join(F.transform("pids", lambda x: F.concat(x["pid"].cast("string"), F.lit(":"),
                                                                                 x["score"].cast("string"))), ",").alias("pids"))


@register("J6_resolve_examples", f"""WITH {_PAIR_SQL}, s AS (SELECT qid // 1000 AS conv, pid, passage, CAST({_SCORE_SQL} AS DOUBLE) AS score FROM pairs),
r AS (SELECT conv, pid, passage, score, row_number() OVER (PARTITION BY conv ORDER BY score DESC, pid) AS rn FROM s),
q AS (SELECT conv_id, text AS query FROM conversations WHERE turn = 0)
SELECT r.conv AS qid, q.query, string_agg(r.passage, ' || ' ORDER BY rn) AS passages FROM r JOIN q ON r.conv = q.conv_id WHERE rn <= 3 GROUP BY r.conv, q.query""")
def j6(spark, d):
    j = _conv_pairs(spark, d)
    sc = WK.score_pairs(j.select("qid", "pid"), j.select("qid", "query"), j.select("pid", "passage"))
    ex = WK.teacher_examples(sc.withColumn("qid", F.floor(F.col("qid") / 1000).cast("long")), nway=3)
    c = table(spark, d, "conversations")
    queries = c.filter(F.col("turn") == 0).select(F.col("conv_id").alias("qid"), F.col("text").alias("query"))
    out = WK.resolve_examples(ex, queries, j.select("pid", "passage"))
    return out.select("qid", "query", F.array_join("passages", " || ").alias("passages"))


@register("J10_canonical_question", """WITH m AS (SELECT lower(text) AS question, MIN(conv_id) AS canonical FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT c.conv_id, c.turn, COALESCE(CAST(m.canonical AS VARCHAR), lower(c.text)) AS question_canonical FROM conversations c LEFT JOIN m ON lower(c.text) = m.question""")
def j10(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.lower("text").alias("question"))
    m = table(spark, d, "conversations").filter(F.col("role") == "user").groupBy(F.lower("text").alias("question")).agg(
        F.min("conv_id").cast("string").alias("canonical"))
    return WK.canonical_question(c, m).select("conv_id", "turn", "question_canonical")


@register("J13_chunk_of_pid", """SELECT d.doc_id AS pid, CAST(c.chunk AS BIGINT) AS chunk FROM documents d LEFT JOIN
 (SELECT row_number() OVER (ORDER BY off) - 1 AS chunk, off, n FROM (SELECT doc_id // 97 * 97 AS off, 97 AS n FROM documents GROUP BY 1)) c
 ON d.doc_id >= c.off AND d.doc_id < c.off + c.n""")
def j13(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pid"))
    starts = docs.select((F.floor(F.col("pid") / 97) * 97).cast("long").alias("offset")).distinct()
    chunks = starts.withColumn("chunk", F.row_number().over(Window.orderBy("offset")).cast("long") - 1).withColumn("n", F.lit(97).cast("long"))
    return WK.chunk_of_pid(docs, chunks)


@register("J14_kilt_provenance", """SELECT 'doc:' || CAST(l.doc_id AS VARCHAR) AS id, d.source AS wikipedia_id, CAST(l.quality AS BIGINT) AS end_paragraph_id
 FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
def j14(spark, d):
    hits = table(spark, d, "labels").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"),
                                            F.col("quality").cast("long").alias("end_paragraph_id"))
    mapping = table(spark, d, "documents").select(F.col("doc_id"), F.col("source").alias("wikipedia_id"))
    j = hits.join(mapping, F.regexp_extract("id", r"(\d+)$", 1).cast("long") == F.col("doc_id"))
    return j.select("id", "wikipedia_id", "end_paragraph_id")
