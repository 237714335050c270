"""Registered queries: ROUGE, reader losses/statistics, span selection and reader data
(A13, A18, A19, A24, W10, W11, D9, D13, J9, K5, K10)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..operators import metrics as M
from ..operators import reader as RDR
from ..session import cut, scratch_dir, table
from .q_qa import _ENC, _J8_STRING, _pairs
from .q_text import sql_tok
from .registry import ORACLE, register

R = 6

_CONV_PAIRS = """pr AS (SELECT u.conv_id * 1000 + u.turn AS id, u.text AS prediction, a.text AS reference FROM conversations u
  JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
tk AS (SELECT id, list_filter(string_split(regexp_replace(lower(prediction), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '') AS tp,
  list_filter(string_split(regexp_replace(lower(reference), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '') AS tr FROM pr)"""


def _rouge_sql(n: int) -> str:
    grams = "CASE WHEN len({t}) >= {n} THEN list_transform(range(0, len({t}) - {n} + 1), lambda i: array_to_string({t}[i + 1:i + {n}], ' ')) ELSE [] END"
    return f"""WITH {_CONV_PAIRS},
gp AS (SELECT id, g, COUNT(*) AS cp FROM (SELECT id, unnest({grams.format(t='tp', n=n)}) AS g FROM tk) GROUP BY 1, 2),
gr AS (SELECT id, g, COUNT(*) AS cr FROM (SELECT id, unnest({grams.format(t='tr', n=n)}) AS g FROM tk) GROUP BY 1, 2),
ov AS (SELECT gp.id, SUM(LEAST(cp, cr)) AS o FROM gp JOIN gr ON gp.id = gr.id AND gp.g = gr.g GROUP BY 1),
x AS (SELECT tk.id, GREATEST(len(tp) - {n} + 1, 0) AS lp, GREATEST(len(tr) - {n} + 1, 0) AS lr, COALESCE(ov.o, 0) AS o FROM tk LEFT JOIN ov ON tk.id = ov.id),
y AS (SELECT id, CASE WHEN lp > 0 THEN o * 1.0 / lp ELSE 0 END AS p, CASE WHEN lr > 0 THEN o * 1.0 / lr ELSE 0 END AS r FROM x)
SELECT id, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * 100, {R}) AS rouge{n} FROM y"""


def _conv_pairs(spark, d):
    c = table(spark, d, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prediction"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return u.join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "prediction", "reference")


@register("A13_rouge_1", _rouge_sql(1))
def a13_1(spark, d):
    return M.rouge_n(_conv_pairs(spark, d), 1).withColumn("rouge1", F.round("rouge1", R))


@register("A13_rouge_2", _rouge_sql(2))
def a13_2(spark, d):
    return M.rouge_n(_conv_pairs(spark, d), 2).withColumn("rouge2", F.round("rouge2", R))


@register("A13_rouge_mean")
def a13_mean(spark, d):
    return M.rouge_mean(_conv_pairs(spark, d))


@register("A13_rouge_l")
def a13_l(spark, d):
    return M.rouge_l(_conv_pairs(spark, d))


@register("A18_inbatch_multivector_loss", f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT vec_id // 16 AS batch, (vec_id % 16) // 2 AS qidx, v FROM e WHERE vec_id % 2 = 0),
p AS (SELECT vec_id // 16 AS batch, ((vec_id % 16) // 2) * 2 + CASE WHEN vec_id % 2 = 1 THEN 0 ELSE 1 END AS pidx, v FROM e),
s AS (SELECT q.batch, q.qidx, p.pidx, list_dot_product(q.v, p.v) AS score FROM q JOIN p ON q.batch = p.batch),
k AS (SELECT * FROM s WHERE NOT (pidx // 2 = qidx) OR pidx = qidx * 2),
m AS (SELECT batch, qidx, MAX(score) AS mx FROM k GROUP BY 1, 2),
l AS (SELECT k.batch, k.qidx, m.mx + ln(SUM(exp(k.score - m.mx))) AS lse FROM k JOIN m ON k.batch = m.batch AND k.qidx = m.qidx GROUP BY 1, 2, m.mx)
SELECT l.batch, CAST(l.qidx AS BIGINT) AS qidx, round(l.lse - s.score, {R}) AS loss FROM l JOIN s ON l.batch = s.batch AND l.qidx = s.qidx AND s.pidx = s.qidx * 2""")
def a18(spark, d):
    from ..functions.vectors import dot
    e = table(spark, d, "embeddings")
    q = e.filter(F.col("vec_id") % 2 == 0).select(F.floor(F.col("vec_id") / 16).alias("batch"),
                                                  F.floor((F.col("vec_id") % 16) / 2).cast("long").alias("qidx"), F.col("embedding").alias("qv"))
    p = e.select(F.floor(F.col("vec_id") / 16).alias("batch"),
                 (F.floor((F.col("vec_id") % 16) / 2) * 2 + F.when(F.col("vec_id") % 2 == 1, 0).otherwise(1)).cast("long").alias("pidx"),
                 F.col("embedding").alias("pv"))
    s = q.join(p, "batch").select("batch", "qidx", "pidx", dot("qv", "pv").alias("score"))   # within a batch of 16
    return M.inbatch_multivector_loss(s, nway=2).withColumn("loss", F.round("loss", R))


@register("A19_marginal_span_nll", f"""WITH l AS (SELECT user_id AS qid, event_type AS passage,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS slot, value / 10.0 AS loss FROM events),
m AS (SELECT qid, slot, MAX(loss) AS l FROM l GROUP BY 1, 2),
ml AS (SELECT qid, SUM(CASE WHEN l <> 0 THEN exp(-l) ELSE 0 END) AS ml FROM m GROUP BY 1)
SELECT round(SUM(-ln(CASE WHEN ml = 0 THEN 1.0 ELSE ml END)), {R}) AS span_nll FROM ml""")
def a19(spark, d):
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    losses = e.select(F.col("user_id").alias("qid"), F.col("event_type").alias("passage"),
                      (F.row_number().over(w) - 1).alias("slot"), (F.col("value") / 10.0).alias("loss"))
    return M.marginal_span_nll(losses).withColumn("span_nll", F.round("span_nll", R))


@register("A24_reader_prep_stats", """WITH s AS (SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'purchase') AS np,
  COUNT(*) FILTER (WHERE event_type = 'purchase' AND value > 50) AS ng FROM events GROUP BY user_id)
SELECT CAST(SUM(CASE WHEN np = 0 THEN 1 ELSE 0 END) AS BIGINT) AS no_positive, CAST(SUM(CASE WHEN ng > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positives_from_gold FROM s""")
def a24(spark, d):
    e = table(spark, d, "events")
    pid = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    score = F.when(F.col("value") > 50, F.lit(-1.0)).otherwise(F.col("value"))
    return M.reader_prep_stats_rows(e.select(F.col("user_id").alias("qid"), pid.alias("pid"), score.alias("score")))


def _logits(spark, d):
    p = _pairs(spark, d)
    toks = tokenize(F.lower("text"))
    return p.select("qid", "pid", "rank", "score", toks.alias("tokens"),
                    F.transform(toks, lambda t: F.length(t) / 10.0).alias("start_logits"),
                    F.transform(toks, lambda t: (F.length(t) % 5) / 10.0).alias("end_logits"))


@register("W10_best_spans")
def w10(spark, d):
    sp = RDR.best_spans(_logits(spark, d).select("qid", "pid", "tokens", "start_logits", "end_logits"), max_len=10, top=10)
    return sp.select("qid", "pid", F.size("spans").alias("n_spans"), F.get("spans", 0)["start"].alias("best_start"))


_LONGEST = f"""lt AS (SELECT t.qid, t.pid, t.score, row_number() OVER (PARTITION BY t.qid ORDER BY t.pid) - 1 AS passage_idx,
  list_filter(tk, lambda x: length(x) = ml)[1] AS text
  FROM (SELECT t.*, tk, list_max(list_transform(tk, lambda y: length(y))) AS ml FROM top t JOIN
        (SELECT doc_id, {sql_tok('lower(text)')} AS tk FROM documents) d ON t.pid = d.doc_id) t)"""


@register("W11_best_prediction_by_threshold", f"""WITH {_ENC}, {_LONGEST}, ns AS (SELECT unnest([1, 5, 20]) AS n),
c AS (SELECT lt.*, ns.n, row_number() OVER (PARTITION BY lt.qid, ns.n ORDER BY lt.score DESC, lt.passage_idx) AS rn FROM lt JOIN ns ON lt.passage_idx < ns.n)
SELECT qid, CAST(n AS BIGINT) AS n, CAST(passage_idx AS BIGINT) AS passage_idx, text AS prediction FROM c WHERE rn = 1""")
def w11(spark, d):
    p = _pairs(spark, d).withColumn("_t", tokenize(F.lower("text")))
    # first longest token in one pass (a max computed outside a lambda would be inlined into it)
    init = F.struct(F.lit(-1).alias("n"), F.lit(None).cast("string").alias("t"))
    longest = F.aggregate("_t", init, lambda acc, x: F.when(F.length(x) > acc["n"], F.struct(F.length(x).alias("n"), x.alias("t")))
                          .otherwise(acc))["t"]
    preds = p.select("qid", F.col("score").alias("relevance"),
                     (F.row_number().over(Window.partitionBy("qid").orderBy("pid")) - 1).cast("long").alias("passage_idx"),
                     F.lit(0).alias("span_order"), longest.alias("text"))
    return RDR.best_prediction_by_threshold(preds, [1, 5, 20])


def _selected(spark, d):
    from ..operators.qa import answer_in_passage
    hits = answer_in_passage(_pairs(spark, d), "string").withColumn("gold_page", F.lit(False))
    return RDR.select_reader_passages(cut(hits.select("qid", "pid", "rank", "has_answer", "gold_page")), is_train=True)


@register("D9_select_reader_passages", _J8_STRING + """, h AS (SELECT qid, pid, rank, length(trim(am)) > 0 AND contains(dm, am) AS hit FROM j),
x AS (SELECT *, SUM(CAST(hit AS INTEGER)) OVER (PARTITION BY qid ORDER BY rank) AS hr,
  SUM(CAST(NOT hit AS INTEGER)) OVER (PARTITION BY qid ORDER BY rank) AS nr FROM h),
y AS (SELECT *, SUM(CASE WHEN hit AND hr <= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS npos FROM x)
SELECT qid, pid, CAST(rank AS BIGINT) AS rank, CASE WHEN hit THEN 'positive' ELSE 'negative' END AS role FROM y
WHERE npos > 0 AND ((hit AND hr <= 20) OR (NOT hit AND nr <= LEAST(GREATEST(10 * npos, 50), 150)))""")
def d9(spark, d):
    return _selected(spark, d).select("qid", "pid", "rank", "role")


# a question's gold passage is the first document that holds its answer, its gold page that document's source; answer
# spans count in texts of up to 4,000 characters
@register("D9_select_with_gold_page", _J8_STRING + """,
am2 AS (SELECT item_id, ' ' || array_to_string(""" + sql_tok("lower(nfc_normalize(text))") + """, ' ') || ' ' AS am FROM benchmark),
dm2 AS (SELECT doc_id, ' ' || array_to_string(""" + sql_tok("lower(nfc_normalize(text))") + """, ' ') || ' ' AS dm FROM documents),
first AS (SELECT am2.item_id AS qid, MIN(dm2.doc_id) AS pid FROM am2, dm2 WHERE length(trim(am2.am)) > 0 AND contains(dm2.dm, am2.am) GROUP BY 1),
gold AS (SELECT f.qid, f.pid, lower(d.source) AS title FROM first f JOIN documents d ON d.doc_id = f.pid),
h AS (SELECT j.qid, j.pid, CAST(j.rank AS BIGINT) AS rank, length(trim(am)) > 0 AND contains(dm, am) AS hit, length(d.text) <= 4000 AS span,
      coalesce(lower(d.source) = g.title, false) AS gp, coalesce(g.pid = j.pid, false) AS given
      FROM j JOIN documents d ON d.doc_id = j.pid LEFT JOIN gold g ON g.qid = j.qid),
r AS (SELECT qid, pid, rank, hit, span, gp FROM h WHERE rank <= 200 AND NOT given UNION ALL SELECT qid, pid, 0, true, true, true FROM gold),
x AS (SELECT *, hit AND span AS usable, SUM(CAST(hit AND span AND gp AS INTEGER)) OVER (PARTITION BY qid) AS on_page,
  SUM(CAST(hit AND span AS INTEGER)) OVER (PARTITION BY qid ORDER BY rank, pid) AS hr, SUM(CAST(NOT hit AS INTEGER)) OVER (PARTITION BY qid ORDER BY rank, pid) AS nr FROM r),
y AS (SELECT *, CASE WHEN on_page > 0 THEN usable AND gp ELSE usable AND hr <= 20 END AS pos FROM x),
z AS (SELECT *, SUM(CAST(pos AS INTEGER)) OVER (PARTITION BY qid) AS npos FROM y)
SELECT qid, pid, rank, CASE WHEN pos THEN 'positive' ELSE 'negative' END AS role FROM z
WHERE npos > 0 AND (pos OR (NOT hit AND nr <= LEAST(GREATEST(10 * npos, 50), 150)))""")
def d9g(spark, d):
    from ..operators.qa import answer_in_passage
    titles = table(spark, d, "documents").select(F.col("doc_id").alias("pid"), F.col("source").alias("title"))
    gold = _gold(spark, d).groupBy("qid").agg(F.min("pid").alias("pid"))
    hits = answer_in_passage(_pairs(spark, d), "string").select(
        "qid", "pid", F.col("rank").cast("long").alias("rank"), "has_answer", (F.char_length("text") <= 4000).alias("span"), F.col("source").alias("title"))
    gold = cut(gold)
    hits = RDR.gold_page_match(cut(hits), gold.join(titles, "pid").select("qid", "title")).drop("title")
    return RDR.select_reader_passages(hits, is_train=True, spans="span", gold=gold).select("qid", "pid", "rank", "role")


@register("D13_compose_reader_batch", _J8_STRING + """, h AS (SELECT qid, pid, rank, length(trim(am)) > 0 AND contains(dm, am) AS hit FROM j),
x AS (SELECT *, SUM(CAST(hit AS INTEGER)) OVER (PARTITION BY qid ORDER BY rank) AS hr,
  SUM(CAST(NOT hit AS INTEGER)) OVER (PARTITION BY qid ORDER BY rank) AS nr FROM h),
y AS (SELECT *, SUM(CASE WHEN hit AND hr <= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS npos FROM x),
s AS (SELECT qid, pid, rank, hit, row_number() OVER (PARTITION BY qid ORDER BY NOT hit, rank) AS slot FROM y
 WHERE npos > 0 AND ((hit AND hr = 1) OR (NOT hit AND nr <= LEAST(GREATEST(10 * npos, 50), 150)))),
g AS (SELECT qid, list(CAST(pid AS VARCHAR) ORDER BY slot) AS pids FROM s WHERE slot <= 8 GROUP BY qid)
SELECT qid, array_to_string(list_concat(pids, list_transform(range(0, 8 - len(pids)), lambda i: '-1')), ',') AS pids FROM g""")
def d13(spark, d):
    out = RDR.compose_reader_batch(_selected(spark, d), n=8)
    return out.select("qid", F.array_join(F.transform("pids", lambda x: x.cast("string")), ",").alias("pids"))


@register("J9_gold_page_match", f"""WITH {_ENC},
am AS (SELECT item_id, ' ' || array_to_string({sql_tok('lower(nfc_normalize(text))')}, ' ') || ' ' AS am FROM benchmark),
dm AS (SELECT doc_id, source, ' ' || array_to_string({sql_tok('lower(nfc_normalize(text))')}, ' ') || ' ' AS dm FROM documents),
gold AS (SELECT DISTINCT am.item_id AS qid, lower(dm.source) AS gt FROM am, dm WHERE length(trim(am.am)) > 0 AND contains(dm.dm, am.am))
SELECT t.qid, t.pid, CAST(EXISTS (SELECT 1 FROM gold g WHERE g.qid = t.qid AND g.gt = lower(d.source)) AS BIGINT) AS gold_page
FROM top t JOIN documents d ON t.pid = d.doc_id""")
def j9(spark, d):
    from ..operators.corpus import answers_in_corpus
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pid"), "text", F.col("source").alias("title"))
    ans = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("answer"))
    gold = answers_in_corpus(ans, docs.select("pid", "text")).join(docs.select("pid", "title"), "pid").select("qid", "title")
    hits = _pairs(spark, d).select("qid", "pid", F.col("source").alias("title"))
    return RDR.gold_page_match(hits, gold).select("qid", "pid", F.col("gold_page").cast("long"))


@register("K10_write_reader_predictions", "SELECT qid, CAST(COUNT(*) AS INTEGER) AS n, string_agg(prediction, '|' ORDER BY n) AS predictions FROM ("
          + ORACLE["W11_best_prediction_by_threshold"] + ") GROUP BY qid")
def k10(spark, d):
    path = scratch_dir(spark, "k10")
    preds = w11(spark, d)
    nested = preds.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("n").alias("top_k"), "prediction"))).alias("predictions"))
    nested.write.json(path)
    return spark.read.json(path).select("qid", F.size("predictions").alias("n"),
                                        F.array_join(F.transform("predictions", lambda p: p["prediction"]), "|").alias("predictions"))


@register("K5_write_kilt", f"WITH {_ENC} SELECT qid AS id, CAST(COUNT(*) AS INTEGER) AS n FROM top GROUP BY qid")
def k5(spark, d):
    from ..sources import sinks as SK
    path = scratch_dir(spark, "k5")
    hits = _pairs(spark, d).select("qid", "pid", "rank", "score", F.lit(False).alias("has_answer"), F.col("source").alias("title"), "text")
    qs = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.array("text").alias("answers"))
    res = SK.results_nested(hits, qs)
    mapping = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("ctx_id"), F.col("source").alias("wikipedia_id"),
                                                  F.lit(0).alias("end_paragraph_id"))
    SK.write_kilt(res, mapping, path)
    return spark.read.json(path).select("id", F.size(F.get("output", 0)["provenance"]).alias("n"))


def _mined(spark, d):
    from ..operators.qa import answer_in_passage
    from ..operators.weak import mine_from_ranking
    hits = answer_in_passage(_pairs(spark, d), "string").select("qid", "pid", "rank", "has_answer")
    return cut(mine_from_ranking(cut(hits)))       # read several times: texts are checked once


def _gold(spark, d):
    from ..operators.corpus import answers_in_corpus
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pid"), "text")
    ans = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("answer"))
    return answers_in_corpus(ans, docs).select("qid", "pid", F.col("pid").alias("gpos"), F.lit(True).alias("has_answer"))


_MINED_SQL = _J8_STRING + """, h AS (SELECT qid, pid, rank, length(trim(am)) > 0 AND contains(dm, am) AS hit FROM j),
x AS (SELECT *, COALESCE(SUM(CAST(hit AS INTEGER)) OVER w, 0) AS p, COALESCE(SUM(CAST(NOT hit AS INTEGER)) OVER w, 0) AS n FROM h
  WINDOW w AS (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mined AS (SELECT qid, pid, rank, hit FROM x WHERE NOT ((p >= 10 AND n >= 10) OR n >= 30)),
am2 AS (SELECT item_id, ' ' || array_to_string(""" + sql_tok("lower(nfc_normalize(text))") + """, ' ') || ' ' AS am FROM benchmark),
dm2 AS (SELECT doc_id, ' ' || array_to_string(""" + sql_tok("lower(nfc_normalize(text))") + """, ' ') || ' ' AS dm FROM documents),
gold AS (SELECT am2.item_id AS qid, MIN(dm2.doc_id) AS pid FROM am2, dm2 WHERE length(trim(am2.am)) > 0 AND contains(dm2.dm, am2.am) GROUP BY 1)"""


@register("D6_inject_gold", _MINED_SQL + """
SELECT qid, pid, CAST(rank AS BIGINT) AS pos, CAST(0 AS BIGINT) AS gold_match FROM mined WHERE hit
UNION ALL SELECT qid, pid, CAST(-1 AS BIGINT), CAST(1 AS BIGINT) FROM gold""")
def d6(spark, d):
    from ..operators.weak import inject_gold
    mined = _mined(spark, d)
    pos = mined.filter("has_answer").select("qid", "pid", F.col("rank").alias("pos"))
    out = inject_gold(pos, _gold(spark, d))
    return out.select("qid", "pid", "pos", F.col("gold_match").cast("long"))


@register("D7_assemble_training_tables", _MINED_SQL + """,
pos AS (SELECT qid, pid, rank AS pos FROM mined WHERE hit UNION ALL SELECT qid, pid, -1 FROM gold),
neg AS (SELECT qid, pid, rank AS pos FROM mined WHERE NOT hit),
pa AS (SELECT qid, string_agg(CAST(pid AS VARCHAR), ',' ORDER BY pos, pid) AS positive_ids FROM pos GROUP BY qid),
na AS (SELECT qid, string_agg(CAST(pid AS VARCHAR), ',' ORDER BY pos, pid) AS hard_negative_ids FROM neg GROUP BY qid)
SELECT COALESCE(pa.qid, na.qid) AS qid, COALESCE(positive_ids, '') AS positive_ids, COALESCE(hard_negative_ids, '') AS hard_negative_ids
FROM pa FULL JOIN na ON pa.qid = na.qid""")
def d7(spark, d):
    from ..operators.weak import assemble_training_tables, inject_gold
    mined = _mined(spark, d)
    pos = inject_gold(mined.filter("has_answer").select("qid", "pid", F.col("rank").alias("pos")), _gold(spark, d))
    neg = mined.filter(~F.col("has_answer")).select("qid", "pid", F.col("rank").alias("pos"))
    out = assemble_training_tables(pos, neg)  # documents have no tables; D7_with_gold_tables has a gold page
    return out.select("qid", F.array_join(F.transform("positive_ids", lambda x: x.cast("string")), ",").alias("positive_ids"),
                      F.array_join(F.transform("hard_negative_ids", lambda x: x.cast("string")), ",").alias("hard_negative_ids"))
