"""Registered queries: ranking/window/batching (W*), samples and sets (L*, G*, D16)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranking as W
from ..operators import sets as S
from ..session import table
from . import bindings as B
from .registry import register


@register("W1_rank_by_score", B.with_ctes(B.SQL_RANKING_EVENTS) + "SELECT qid, pid, CAST(rank AS BIGINT) AS rank FROM ranking")
def w1(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("pid"), F.col("value").alias("score"))
    return W.rank_by_score(e, "qid", "score", "pid", hot_rows=W.HOT_ROWS).select("qid", "pid", "rank")


@register("W1_rank_by_score_hot", "SELECT event_type AS qid, event_id AS pid, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events")
def w1_hot(spark, d):
    """A handful of keys hold all rows, so each is above this limit and is ranked in slices."""
    e = table(spark, d, "events").select(F.col("event_type").alias("qid"), F.col("event_id").alias("pid"), F.col("value").alias("score"))
    return W.rank_by_score(e, "qid", "score", "pid", hot_rows=64).select("qid", "pid", "rank")


@register("W2_topk_per_query", B.with_ctes(B.SQL_RANKING_EVENTS) + "SELECT qid, pid, CAST(rank AS BIGINT) AS rank FROM ranking WHERE rank <= 5")
def w2(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("pid"),
                                         F.col("value").alias("score"))
    return W.topk_per_query(e, 5, "qid", "score", "pid").select("qid", "pid", "rank")


@register("W3_check_contiguous_ranks", """WITH r AS (SELECT user_id AS qid, CAST(rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS BIGINT) AS rank FROM events)
SELECT DISTINCT qid, rank FROM (
  SELECT qid, rank FROM r x WHERE rank <> 1 AND NOT EXISTS (SELECT 1 FROM r y WHERE y.qid = x.qid AND y.rank = x.rank - 1)
  UNION ALL SELECT qid, rank FROM r GROUP BY qid, rank HAVING COUNT(*) > 1)""")
def w3(spark, d):
    e = table(spark, d, "events")
    r = e.select(F.col("user_id").alias("qid"),
                 F.rank().over(Window.partitionBy("user_id").orderBy(F.col("value").desc())).cast("long").alias("rank"))
    return W.check_contiguous_ranks(r)


_DOCS_IDX = "idx AS (SELECT doc_id, n_chars, source, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)"


@register("W4_assign_batches", B.with_ctes(_DOCS_IDX) + "SELECT doc_id, CAST(i // 64 AS BIGINT) AS batch, CAST(i % 64 AS BIGINT) AS pos_in_batch FROM idx")
def w4(spark, d):
    return W.assign_batches(table(spark, d, "documents").select("doc_id"), 64, ["doc_id"])


@register("W4_assign_batches_drop_last", B.with_ctes(_DOCS_IDX) + """SELECT doc_id, CAST(i // 64 AS BIGINT) AS batch, CAST(i % 64 AS BIGINT) AS pos_in_batch FROM idx
WHERE i // 64 < (SELECT COUNT(*) FROM documents) // 64""")
def w4b(spark, d):
    return W.assign_batches(table(spark, d, "documents").select("doc_id"), 64, ["doc_id"], drop_last=True)


@register("W5_length_sorted_batches", """SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS orig_idx,
 CAST(row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS BIGINT) AS sorted_idx,
 CAST((row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 32 AS BIGINT) AS batch FROM documents""")
def w5(spark, d):
    return W.length_sorted_batches(table(spark, d, "documents").select("doc_id", "n_chars"), F.col("n_chars"),
                                   "doc_id", 32).select("doc_id", "orig_idx", "sorted_idx", "batch")


@register("W6_assign_shards_range", B.with_ctes(_DOCS_IDX) + """SELECT doc_id, CAST(i // GREATEST(CAST(ceil((SELECT COUNT(*) FROM documents) / 7.0) AS BIGINT), 1) AS BIGINT) AS shard FROM idx""")
def w6(spark, d):
    return W.assign_shards_range(table(spark, d, "documents").select("doc_id"), 7, ["doc_id"])


@register("W7_assign_shards_round_robin", B.with_ctes(_DOCS_IDX) + """SELECT doc_id, CAST(i % 3 AS BIGINT) AS shard,
 CAST(i // LEAST(25000, 1 + (SELECT COUNT(*) FROM documents) // 3) AS BIGINT) AS chunk FROM idx""")
def w7(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    out = W.assign_shards_round_robin(docs, 3, ["doc_id"])
    n = docs.agg(F.count(F.lit(1)).alias("_n")).select(W.chunk_size(F.col("_n"), 3).alias("_cs"))
    idx = W.zip_index(out, ["doc_id"], "_i").crossJoin(F.broadcast(n))
    return idx.select("doc_id", "shard", F.floor(F.col("_i") / F.col("_cs")).cast("long").alias("chunk"))


_MV_LENS = "lens AS (SELECT vec_id // 8 AS pid, COUNT(*) AS doclen FROM embeddings GROUP BY 1)"


@register("W8_running_offsets", B.with_ctes(_MV_LENS) + """SELECT CAST(pid AS BIGINT) AS pid, CAST(doclen AS BIGINT) AS doclen,
 CAST(COALESCE(SUM(doclen) OVER (ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM lens""")
def w8(spark, d):
    lens = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 8).cast("long").alias("pid")).agg(
        F.count(F.lit(1)).alias("doclen"))
    return W.running_offsets(lens, "doclen", ["pid"])


@register("W8_running_offsets_by_group", """SELECT doc_id, source, CAST(COALESCE(SUM(n_chars) OVER (PARTITION BY source ORDER BY doc_id
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM documents""")
def w8b(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return W.running_offsets(docs, "n_chars", ["doc_id"], partition_by=["source"]).select("doc_id", "source", "offset")


@register("W12_epoch_shuffle", "SELECT doc_id, md5('9:' || doc_id) AS shuffle_key FROM documents")
def w12(spark, d):
    return W.epoch_shuffle(table(spark, d, "documents").select("doc_id"), "doc_id", seed=7, epoch=2)


_SRC_BATCH = """sb AS (SELECT source, CAST(COUNT(*) AS BIGINT) AS nd, CAST(ceil(COUNT(*) / 10.0) AS BIGINT) AS n_batches FROM documents GROUP BY source),
ns AS (SELECT COUNT(*) AS k FROM sb)"""


@register("W13_mix_sources", B.with_ctes(_SRC_BATCH) + """, slots AS (SELECT source, n_batches, CAST(floor(100 * (1.0 / k)) AS BIGINT) AS n_slots FROM sb, ns)
SELECT source, CAST(s AS BIGINT) AS slot, CAST(s % n_batches AS BIGINT) AS batch FROM slots, LATERAL unnest(range(0, n_slots)) t(s)""")
def w13(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    per = W.running_in_keys(docs, ["source"], ["doc_id"], out="_i")
    batches = per.select("source", F.floor(F.col("_i") / 10).cast("long").alias("batch")).distinct()
    nsrc = docs.select("source").distinct()
    rates = nsrc.crossJoin(nsrc.agg(F.count(F.lit(1)).alias("_k"))).select("source", (1.0 / F.col("_k")).alias("rate"))
    return W.mix_sources(batches, rates, 100).select("source", "slot", "batch")


@register("W14_fill_short_shard", """WITH b AS (SELECT source AS shard, doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS BIGINT) AS batch FROM documents),
per AS (SELECT shard, COUNT(DISTINCT batch) AS nb FROM b GROUP BY shard),
mx AS (SELECT MAX(nb) AS mx FROM per),
first AS (SELECT * FROM b WHERE batch = 0),
copies AS (SELECT f.shard, f.doc_id, CAST(p.nb + c AS BIGINT) AS batch, TRUE AS filled
           FROM first f JOIN per p ON f.shard = p.shard, mx, LATERAL unnest(range(0, mx.mx - p.nb)) t(c))
SELECT shard, doc_id, batch, CAST(filled AS BIGINT) AS filled FROM (SELECT shard, doc_id, batch, FALSE AS filled FROM b UNION ALL SELECT * FROM copies)""")
def w14(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("shard"), "doc_id")
    b = W.running_in_keys(docs, ["shard"], ["doc_id"], out="_i")
    b = b.select("shard", "doc_id", F.floor(F.col("_i") / 8).cast("long").alias("batch"))
    out = W.fill_short_shard(b)
    return out.select("shard", "doc_id", "batch", F.col("filled").cast("long").alias("filled"))


# ---- L*, G*, D16 ---------------------------------------------------------------------------------

@register("L1_random_split", "SELECT doc_id, CASE WHEN CAST('0x' || substr(md5('1:' || doc_id), 1, 8) AS BIGINT) % 100 < 90 THEN 'train' ELSE 'dev' END AS split FROM documents")
def l1(spark, d):
    return S.random_split(table(spark, d, "documents").select("doc_id"), "doc_id", 90, seed=1)


@register("L2_five_fold_roles", """SELECT f, qid, CAST(qid % 5 AS BIGINT) AS fold,
 CASE WHEN ((qid % 5 - f) % 5 + 5) % 5 <= 2 THEN 'train' WHEN ((qid % 5 - f) % 5 + 5) % 5 = 3 THEN 'dev' ELSE 'test' END AS role
 FROM (SELECT DISTINCT user_id AS qid FROM events), (SELECT range AS f FROM range(0, 5))""")
def l2(spark, d):
    q = B.queries_events(spark, d)
    fs = spark.range(0, 5).withColumnRenamed("id", "f")
    return S.five_fold_roles(q.crossJoin(F.broadcast(fs)), F.col("qid") % 5, F.col("f")).select("f", "qid", "fold", "role")


@register("L3_sample_size", "SELECT CAST(COUNT(*) AS BIGINT) AS n, CAST(LEAST(1 + floor(16 * sqrt(120 * COUNT(*))), COUNT(*)) AS BIGINT) AS sample_size FROM documents")
def l3(spark, d):
    n = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"))
    return n.select("n", S.sample_size_col(F.col("n")).alias("sample_size"))


@register("L3_hash_sample", """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('123:' || doc_id), doc_id) AS r FROM documents)
 WHERE r <= (SELECT LEAST(1 + floor(16 * sqrt(120 * COUNT(*))), COUNT(*)) FROM documents)""")
def l3b(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return S.hash_sample(docs, "doc_id", S.sample_size(docs.count()), seed=123)


@register("L4_heldout_split", """SELECT vec_id, row_number() OVER (ORDER BY md5('0:' || vec_id), vec_id) <=
 (SELECT least(floor(COUNT(*) * 0.05), 50000) FROM embeddings) AS heldout FROM embeddings""")
def l4(spark, d):
    return S.heldout_split(table(spark, d, "embeddings").select("vec_id"), "vec_id")


@register("L6_cap_sample", "SELECT event_id, user_id FROM events ORDER BY md5('5:' || event_id), event_id LIMIT 1000")
def l6(spark, d):
    return S.hash_sample(table(spark, d, "events").select("event_id", "user_id"), "event_id", 1000, seed=5)


@register("L7_row_range", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i >= 100 AND i < 300")
def l7(spark, d):
    return S.row_range(table(spark, d, "documents").select("doc_id"), ["doc_id"], 100, 300)


@register("L5_mini_corpus", B.with_ctes(B.SQL_RANKING_EVENTS) + """, q AS (SELECT DISTINCT user_id AS qid FROM events),
qs AS ((SELECT qid FROM q ORDER BY md5('12345:' || qid), qid LIMIT 300) UNION (SELECT qid FROM q ORDER BY md5('12345:' || qid), qid LIMIT 20)),
top AS (SELECT qid, pid, rank FROM ranking WHERE rank <= 5 AND qid IN (SELECT qid FROM qs)),
m AS (SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS new_pid FROM (SELECT DISTINCT pid FROM top))
SELECT qid, pid, new_pid, rank FROM top JOIN m USING (pid)""")
def l5(spark, d):
    rk = B.ranking_events(spark, d)
    q = B.queries_events(spark, d)
    qs, mapping, top = S.mini_corpus(q, q, rk, factor=1, topk=5, maxdev=20)
    return top.select("qid", "pid", "new_pid", "rank")


@register("G1_union_folds", "SELECT DISTINCT user_id AS qid, CAST(user_id % 5 AS BIGINT) AS fold FROM events WHERE user_id % 5 IN (0, 1, 2)")
def g1(spark, d):
    q = B.queries_events(spark, d).withColumn("fold", (F.col("qid") % 5).cast("long"))
    return S.union_folds([q.filter(F.col("fold") == f) for f in (0, 1, 2)])


@register("G2_union_sources", """SELECT 'doc:' || CAST(doc_id AS VARCHAR) AS id, length(text) AS n FROM documents
 UNION ALL SELECT 'page:' || CAST(page_id AS VARCHAR) AS id, length(html) AS n FROM pages""")
def g2(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.length("html").cast("long").alias("n"))
    return S.union_sources({"doc:": docs, "page:": pages})


_FIRSTWORD = "lower(regexp_extract({c}, '^[^ ]+', 0))"


@register("G3_question_overlap", f"""SELECT DISTINCT {_FIRSTWORD.format(c='text')} AS w FROM benchmark
 INTERSECT SELECT DISTINCT {_FIRSTWORD.format(c='text')} AS w FROM documents""")
def g3(spark, d):
    fw = F.lower(F.regexp_extract(F.col("text"), "^[^ ]+", 0)).alias("w")
    return S.question_overlap(table(spark, d, "benchmark").select(fw), table(spark, d, "documents").select(fw))


@register("G4_queries_without_positives", "SELECT DISTINCT user_id AS qid FROM events EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase'")
def g4(spark, d):
    return S.without_positives(B.queries_events(spark, d), B.gold_events(spark, d))


@register("G4_documents_without_good_label", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def g4_labels(spark, d):
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    return S.without_positives(table(spark, d, "documents").select("doc_id").distinct(), good, "doc_id")


@register("G5_distinct_tables", "SELECT text, MIN(doc_id) AS doc_id FROM documents GROUP BY text")
def g5(spark, d):
    return S.distinct_first(table(spark, d, "documents").select("text", "doc_id"), ["text"], "doc_id")


# folds with two faults: users divisible by 10 are in fold 0 and fold 4, odd ones of fold 3 are in none
@register("D16_fold_assignment_check", """SELECT (SELECT COUNT(DISTINCT user_id) FROM events WHERE user_id % 10 = 0) AS multi_fold,
 (SELECT COUNT(DISTINCT user_id) FROM events WHERE user_id % 5 = 3 AND user_id % 2 = 1) AS missing""")
def d16(spark, d):
    q = B.queries_events(spark, d)
    member = [F.col("qid") % 5 == f for f in range(5)]
    member[3], member[4] = member[3] & (F.col("qid") % 2 == 0), member[4] | (F.col("qid") % 10 == 0)
    folds = [q.filter(m).withColumn("fold", F.lit(f)) for f, m in enumerate(member)]
    return S.fold_assignment_check(S.union_folds(folds), q)
