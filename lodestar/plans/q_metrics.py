"""Registered queries: ranking metrics (A*) and ranking/window operators (W*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from . import bindings as B
from .registry import register

R = 6  # digits kept for float outputs on both sides


def _r(df, cols):
    return df.select(*[F.round(F.col(c), R).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---- A9 / A10 / A11 -------------------------------------------------------------------------------

_SQL_NDCG_CORE = """
ranked AS (SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid DESC) AS rnk FROM run),
top AS (SELECT r.qid, r.rnk, GREATEST(COALESCE(q.rel, 0), 0) / log2(r.rnk + 1) AS g
        FROM ranked r LEFT JOIN qrels q ON r.qid = q.qid AND r.docid = q.docid WHERE r.rnk <= 10),
dcg AS (SELECT qid, SUM(CASE WHEN rnk <= 5 THEN g ELSE 0 END) AS d5, SUM(g) AS d10 FROM top GROUP BY qid),
ideal AS (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, docid) AS irk FROM qrels WHERE rel > 0),
idcg AS (SELECT qid, SUM(CASE WHEN irk <= 5 THEN rel / log2(irk + 1) ELSE 0 END) AS i5,
                SUM(CASE WHEN irk <= 10 THEN rel / log2(irk + 1) ELSE 0 END) AS i10 FROM ideal GROUP BY qid),
ndcg AS (SELECT d.qid,
           CASE WHEN COALESCE(i.i5, 0) > 0 THEN d.d5 / i.i5 ELSE 0 END AS ndcg_cut_5,
           CASE WHEN COALESCE(i.i10, 0) > 0 THEN d.d10 / i.i10 ELSE 0 END AS ndcg_cut_10
         FROM dcg d LEFT JOIN idcg i ON d.qid = i.qid WHERE d.qid IN (SELECT qid FROM qrels)),
mhits AS (SELECT r.qid, r.rnk, CASE WHEN COALESCE(q.rel, 0) >= 1 THEN 1 ELSE 0 END AS hit
          FROM ranked r LEFT JOIN qrels q ON r.qid = q.qid AND r.docid = q.docid WHERE r.rnk <= 10),
mprec AS (SELECT qid, rnk, hit, SUM(hit) OVER (PARTITION BY qid ORDER BY rnk ROWS UNBOUNDED PRECEDING) / rnk AS p FROM mhits),
msum AS (SELECT qid, SUM(CASE WHEN rnk <= 5 AND hit = 1 THEN p ELSE 0 END) AS s5,
                SUM(CASE WHEN hit = 1 THEN p ELSE 0 END) AS s10 FROM mprec GROUP BY qid),
nrel AS (SELECT qid, SUM(CASE WHEN rel >= 1 THEN 1 ELSE 0 END) AS nr FROM qrels GROUP BY qid),
mapc AS (SELECT s.qid, CASE WHEN n.nr > 0 THEN s.s5 / n.nr ELSE 0 END AS map_cut_5,
                CASE WHEN n.nr > 0 THEN s.s10 / n.nr ELSE 0 END AS map_cut_10
         FROM msum s JOIN nrel n ON s.qid = n.qid)
"""

_EV = B.with_ctes(B.SQL_RUN_EVENTS, B.SQL_QRELS_EVENTS) + "," + _SQL_NDCG_CORE


@register("A9_ndcg_cut", _EV + "SELECT qid, round(ndcg_cut_5, 6) AS ndcg_cut_5, round(ndcg_cut_10, 6) AS ndcg_cut_10 FROM ndcg")
def a9(spark, d):
    return _r(M.ndcg_cut(B.run_events(spark, d), B.qrels_events(spark, d)), {"ndcg_cut_5", "ndcg_cut_10"})


@register("A10_map_cut", _EV + "SELECT qid, round(map_cut_5, 6) AS map_cut_5, round(map_cut_10, 6) AS map_cut_10 FROM mapc")
def a10(spark, d):
    return _r(M.map_cut(B.run_events(spark, d), B.qrels_events(spark, d)), {"map_cut_5", "map_cut_10"})


_MEAN_SELECT = """
, nq AS (SELECT COUNT(DISTINCT qid) AS n FROM qrels)
SELECT round(COALESCE((SELECT SUM(ndcg_cut_5) FROM ndcg), 0) / n, 6) AS ndcg_cut_5,
       round(COALESCE((SELECT SUM(ndcg_cut_10) FROM ndcg), 0) / n, 6) AS ndcg_cut_10,
       round(COALESCE((SELECT SUM(map_cut_5) FROM mapc), 0) / n, 6) AS map_cut_5,
       round(COALESCE((SELECT SUM(map_cut_10) FROM mapc), 0) / n, 6) AS map_cut_10
FROM nq
"""

MEASURES = ["ndcg_cut_5", "ndcg_cut_10", "map_cut_5", "map_cut_10"]


@register("A11_mean_over_fixed_n", _EV + _MEAN_SELECT)
def a11(spark, d):
    return _r(M.trec_evaluate(B.run_events(spark, d), B.qrels_events(spark, d)), set(MEASURES))


@register("A11_trec_evaluate_orders", B.with_ctes(B.SQL_RUN_ORDERS, B.SQL_QRELS_ORDERS) + "," + _SQL_NDCG_CORE + _MEAN_SELECT)
def a11_orders(spark, d):
    return _r(M.trec_evaluate(B.run_orders(spark, d), B.qrels_orders(spark, d)), set(MEASURES))


# ---- A1-A6, A20-A22, A25-A27 on the events ranking ---------------------------------------------

_RG = B.with_ctes(B.SQL_RANKING_EVENTS, B.SQL_GOLD_EVENTS, B.SQL_QUERIES_EVENTS)
_FIRST = """, pos AS (SELECT r.qid, r.rank FROM ranking r WHERE r.rank <= 10
                AND EXISTS (SELECT 1 FROM gold g WHERE g.qid = r.qid AND g.pid = r.pid)),
agg AS (SELECT qid, MIN(rank) AS f, SUM(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS h10 FROM pos GROUP BY qid),
ng AS (SELECT qid, COUNT(*) AS n FROM (SELECT DISTINCT qid, pid FROM gold) GROUP BY qid),
per AS (SELECT q.qid,
          CASE WHEN a.f <= 10 THEN 1.0 / a.f ELSE 0 END AS mrr_10,
          CAST(CASE WHEN a.f <= 5 THEN 1.0 ELSE 0 END AS DOUBLE) AS success_5,
          CAST(CASE WHEN a.f <= 10 THEN 1.0 ELSE 0 END AS DOUBLE) AS success_10,
          CASE WHEN ng.n > 0 THEN COALESCE(a.h10, 0) * 1.0 / ng.n ELSE 0 END AS recall_10
        FROM queries q LEFT JOIN agg a ON q.qid = a.qid LEFT JOIN ng ON q.qid = ng.qid)
"""


def _qm(spark, d):
    return M.query_metrics(B.ranking_events(spark, d), B.gold_events(spark, d), B.queries_events(spark, d),
                           mrr_depths=(10,), success_depths=(5, 10), recall_depths=(10,))


@register("A1_mrr_at", _RG + _FIRST + "SELECT qid, round(mrr_10, 6) AS mrr_10 FROM per")
def a1(spark, d):
    return _r(_qm(spark, d).select("qid", "mrr_10"), {"mrr_10"})


@register("A2_success_at", _RG + _FIRST + "SELECT qid, success_5, success_10 FROM per")
def a2(spark, d):
    return _qm(spark, d).select("qid", "success_5", "success_10")


@register("A3_recall_at", _RG + _FIRST + "SELECT qid, round(recall_10, 6) AS recall_10 FROM per")
def a3(spark, d):
    return _r(_qm(spark, d).select("qid", "recall_10"), {"recall_10"})


A1_A3_MEAN = _RG + _FIRST + """SELECT round(AVG(mrr_10), 6) AS mrr_10, round(AVG(success_5), 6) AS success_5,
  round(AVG(success_10), 6) AS success_10, round(AVG(recall_10), 6) AS recall_10 FROM per"""


@register("A1_A3_mean_metrics", A1_A3_MEAN)
def a1_a3_mean(spark, d):
    m = M.mean_metrics(_qm(spark, d))
    return _r(m, set(m.columns))


@register("A4_recall_max_depth", _RG + """, top AS (SELECT DISTINCT qid, pid FROM ranking WHERE score > 20),
g AS (SELECT DISTINCT qid, pid FROM gold),
per AS (SELECT g.qid, COUNT(*) AS ng, SUM(CASE WHEN t.pid IS NOT NULL THEN 1 ELSE 0 END) AS found
        FROM g LEFT JOIN top t ON g.qid = t.qid AND g.pid = t.pid GROUP BY g.qid)
SELECT round(AVG(found * 1.0 / GREATEST(ng, 1)), 3) AS recall_max_depth FROM per""")
def a4(spark, d):
    top = B.ranking_events(spark, d).filter("score > 20")      # rankings of unlike depth, none cut
    return M.recall_max_depth(top, B.gold_events(spark, d))


_LAB = B.with_ctes(B.SQL_RANKING_EVENTS, B.SQL_QUERIES_EVENTS,
                   "lab AS (SELECT r.qid, r.rank, CASE WHEN e.event_type = 'purchase' THEN 1 ELSE 0 END AS label "
                   "FROM ranking r JOIN events e ON r.pid = e.event_id)")


def _labelled(spark, d):
    from ..session import table
    e = table(spark, d, "events").select(F.col("event_id").alias("pid"),
                                         (F.col("event_type") == "purchase").cast("int").alias("label"))
    return B.ranking_events(spark, d).join(e, "pid")


@register("A5_em_success_counts", _LAB + """, cuts AS (SELECT * FROM (VALUES (1),(5),(10),(20),(30),(50),(100),(1000),(-1)) t(cutoff)),
per AS (SELECT c.cutoff, l.qid, COUNT(*) AS cnt FROM lab l JOIN cuts c ON (c.cutoff < 0 OR l.rank <= c.cutoff)
        WHERE l.label = 1 GROUP BY c.cutoff, l.qid),
tot AS (SELECT cutoff, COUNT(*) AS succ, SUM(cnt) AS cnt FROM per GROUP BY cutoff),
nj AS (SELECT COUNT(*) AS nj FROM queries), nr AS (SELECT COUNT(DISTINCT qid) AS nr FROM lab)
SELECT CAST(c.cutoff AS BIGINT) AS cutoff, round(COALESCE(t.succ, 0) * 1.0 / nj, 6) AS success,
       round(COALESCE(t.cnt, 0) * 1.0 / nj, 6) AS counts, CAST(nj <> nr AS BIGINT) AS mismatch
FROM cuts c LEFT JOIN tot t ON c.cutoff = t.cutoff, nj, nr""")
def a5(spark, d):
    out = M.em_success_counts(_labelled(spark, d), B.queries_events(spark, d))
    return _r(out.withColumn("mismatch", F.col("mismatch").cast("long")), {"success", "counts"})


_CURVE_SQL = """, fh AS (SELECT qid, MIN(CASE WHEN label = 1 THEN rank END) AS f FROM lab GROUP BY qid),
ks AS (SELECT range AS k FROM range(1, 21)),
pr AS (SELECT f AS k, COUNT(*) AS c FROM fh WHERE f IS NOT NULL GROUP BY f),
cum AS (SELECT ks.k, SUM(COALESCE(pr.c, 0)) OVER (ORDER BY ks.k ROWS UNBOUNDED PRECEDING) AS cc
        FROM ks LEFT JOIN pr ON ks.k = pr.k)
SELECT CAST(k AS BIGINT) AS k, round(cc * 1.0 / (SELECT COUNT(*) FROM fh), 6) AS accuracy FROM cum"""


@register("A6_topk_hit_accuracy", _LAB + _CURVE_SQL)
def a6(spark, d):
    from ..operators.ranking import first_hit
    fh = first_hit(_labelled(spark, d).withColumn("hit", F.col("label") == 1), "hit")
    return _r(M.first_hit_curve(fh, 20), {"accuracy"})


@register("W9_first_hit", _LAB + " SELECT qid, CAST(MIN(CASE WHEN label = 1 THEN rank END) AS BIGINT) AS first_hit_rank FROM lab GROUP BY qid")
def w9(spark, d):
    from ..operators.ranking import first_hit
    return first_hit(_labelled(spark, d).withColumn("hit", F.col("label") == 1), "hit")


@register("A7_topk_hit_accuracy_tables", _LAB.replace(
    "lab AS (", "lab0 AS (") .replace("FROM ranking r JOIN events e ON r.pid = e.event_id)",
                                      "FROM ranking r JOIN events e ON r.pid = e.event_id), "
                                      "tabhit AS (SELECT event_id // 4 AS table_id, MAX(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS th FROM events GROUP BY 1), "
                                      "lab AS (SELECT l.qid, l.rank, t.th AS label FROM lab0 l JOIN ranking r ON l.qid = r.qid AND l.rank = r.rank "
                                      "JOIN tabhit t ON r.pid // 4 = t.table_id)") + _CURVE_SQL)
def a7(spark, d):
    """Whole-table curve: a hit at a chunk when any chunk of its table (event_id div 4) matches."""
    from ..operators.qa import table_level_hits
    from ..operators.ranking import first_hit
    from ..session import table
    chunks = table(spark, d, "events").select(
        F.col("event_id").alias("pid"), F.floor(F.col("event_id") / 4).cast("long").alias("table_id"),
        (F.col("event_type") == "purchase").alias("hit"))
    ranked = B.ranking_events(spark, d).join(chunks.select("pid", "table_id"), "pid")
    hits = table_level_hits(ranked, chunks)
    fh = first_hit(hits, "table_hit")
    return _r(M.first_hit_curve(fh, 20), {"accuracy"})


@register("A20_margin_report", """SELECT round(AVG(CASE WHEN event_type = 'purchase' THEN value END), 6) AS avg_pos,
 round(AVG(CASE WHEN event_type <> 'purchase' THEN value END), 6) AS avg_neg,
 round(AVG(CASE WHEN event_type = 'purchase' THEN value END) - AVG(CASE WHEN event_type <> 'purchase' THEN value END), 6) AS margin
 FROM events""")
def a20(spark, d):
    from ..session import table
    e = table(spark, d, "events").select(F.col("value").alias("score"), (F.col("event_type") == "purchase").alias("is_pos"))
    return _r(M.margin_report(e), {"avg_pos", "avg_neg", "margin"})


@register("A21_group_by_key", B.with_ctes(B.SQL_RANKING_EVENTS) + """SELECT qid, string_agg(CAST(pid AS VARCHAR), ',' ORDER BY rank) AS pids,
 CAST(COUNT(*) AS BIGINT) AS n FROM ranking GROUP BY qid""")
def a21(spark, d):
    from ..operators.ranking import group_ranked
    g = group_ranked(B.ranking_events(spark, d))
    return g.select("qid", F.array_join(F.transform("items", lambda x: x["pid"].cast("string")), ",").alias("pids"),
                    F.size("items").cast("long").alias("n"))


@register("A21_check_pregrouped", """WITH n AS (SELECT user_id, row_number() OVER (ORDER BY event_id) AS i FROM events)
SELECT user_id FROM n GROUP BY user_id HAVING MAX(i) - MIN(i) + 1 <> COUNT(*)""")
def a21_strict(spark, d):
    from ..operators.ranking import check_pregrouped
    from ..session import table
    return check_pregrouped(table(spark, d, "events"), "user_id", "event_id")


@register("A22_ranking_stats", B.with_ctes(B.SQL_RANKING_EVENTS, B.SQL_GOLD_EVENTS) + """, per AS (SELECT qid, COUNT(*) AS k FROM ranking GROUP BY qid),
pos AS (SELECT qid, COUNT(*) AS p FROM (SELECT DISTINCT qid, pid FROM gold) GROUP BY qid)
SELECT CAST(MAX(k) AS BIGINT) AS max_k, round(AVG(k), 6) AS avg_k, round(AVG(COALESCE(p, 0)), 6) AS avg_positives
FROM per LEFT JOIN pos ON per.qid = pos.qid""")
def a22(spark, d):
    return _r(M.ranking_stats(B.ranking_events(spark, d), B.gold_events(spark, d)), {"avg_k", "avg_positives"})


@register("A26_running_metrics", _RG + _FIRST + """SELECT qid, round(mrr_10, 6) AS mrr_10,
 round(SUM(mrr_10) OVER (ORDER BY qid ROWS UNBOUNDED PRECEDING) / (row_number() OVER (ORDER BY qid)), 6) AS running_mrr_10 FROM per""")
def a26(spark, d):
    from ..operators.ranking import zip_index
    per = zip_index(_qm(spark, d).select("qid", "mrr_10"), ["qid"], "idx")
    out = M.running_metrics(per, "idx", ["mrr_10"]).drop("idx")
    return _r(out, {"mrr_10", "running_mrr_10"})


@register("A27_check_rankings", B.with_ctes(B.SQL_RANKING_EVENTS, B.SQL_GOLD_EVENTS) + """SELECT
 (SELECT COUNT(*) FROM (SELECT qid, pid FROM ranking WHERE rank <= 3)) AS dup_ranked_pids,
 (SELECT COUNT(*) FROM (SELECT DISTINCT qid, pid FROM gold WHERE pid % 7 = 0)) AS dup_gold_pids""")
def a27(spark, d):
    r, g = B.ranking_events(spark, d), B.gold_events(spark, d)
    return M.check_rankings(r.unionAll(r.filter("rank <= 3")), g.unionAll(g.filter("pid % 7 = 0")))     # rows put in twice


@register("A16_nway_cross_entropy", """WITH s AS (SELECT user_id AS qid, value / 10.0 AS score,
   row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events),
 m AS (SELECT qid, MAX(score) AS mx FROM s GROUP BY qid),
 l AS (SELECT s.qid, m.mx + ln(SUM(exp(s.score - m.mx))) AS lse FROM s JOIN m ON s.qid = m.qid GROUP BY s.qid, m.mx)
SELECT l.qid, round(l.lse - s.score, 6) AS loss FROM l JOIN s ON l.qid = s.qid AND s.pos = 0""")
def a16(spark, d):
    from pyspark.sql import Window
    from ..session import table
    e = table(spark, d, "events")
    s = e.select(F.col("user_id").alias("qid"), (F.col("value") / 10.0).alias("score"),
                 (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("pos"))
    return _r(M.nway_cross_entropy(s), {"loss"})


@register("A17_distillation_kl", """WITH t AS (SELECT user_id AS qid, value / 10.0 AS student,
   CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10.0 * 0.5 AS tt FROM events),
 mt AS (SELECT qid, MAX(tt) AS m1, MAX(student) AS m2 FROM t GROUP BY qid),
 z AS (SELECT t.qid, mt.m1 + ln(SUM(exp(t.tt - mt.m1))) AS zt, mt.m2 + ln(SUM(exp(t.student - mt.m2))) AS zs
       FROM t JOIN mt ON t.qid = mt.qid GROUP BY t.qid, mt.m1, mt.m2),
 j AS (SELECT t.tt - z.zt AS lpt, t.student - z.zs AS lps, t.qid FROM t JOIN z ON t.qid = z.qid)
SELECT round(SUM(exp(lpt) * (lpt - lps)) / COUNT(DISTINCT qid), 6) AS kl FROM j""")
def a17(spark, d):
    from ..session import table
    e = table(spark, d, "events")
    s = e.select(F.col("user_id").alias("qid"), (F.col("value") / 10.0).alias("student"),
                 (F.get_json_object("props", "$.k").cast("double") / 10.0).alias("teacher"))
    return _r(M.distillation_kl(s, alpha=0.5), {"kl"})
