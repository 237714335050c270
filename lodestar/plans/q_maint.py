"""Registered queries: index maintenance (V30-V33, K11) and the two streams (ST1, ST2)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import index as I
from ..session import scratch_dir, table
from . import bindings as B
from .q_index import BASE, codec, tokens
from .registry import register

_PIDS = "p AS (SELECT vec_id // 8 AS pid, COUNT(*) AS doclen, MIN(CASE WHEN vec_id % 8 = 0 THEN label END) AS first_label FROM embeddings GROUP BY 1)"


def _base_and_new(spark, d):
    t = tokens(spark, d)
    base = I.build_index(t.filter(F.col("pid") % 2 == 0), codec(spark, d))
    new = t.filter(F.col("pid") % 2 == 1).select(F.col("pid").alias("local_id"), "tok_pos", "embedding")
    return base, new


@register("V30_index_add", f"""WITH {_PIDS}, m AS (SELECT MAX(pid) AS mx FROM p WHERE pid % 2 = 0)
SELECT pid AS local_id, CAST(mx + row_number() OVER (ORDER BY pid) AS BIGINT) AS pid, CAST(doclen AS BIGINT) AS doclen FROM p, m WHERE pid % 2 = 1""")
def v30(spark, d):
    base, new = _base_and_new(spark, d)
    ix, mapping = I.index_add(base, new)
    return mapping.join(ix.doclens, "pid").select("local_id", "pid", "doclen")


def _removed(spark, d):
    e = table(spark, d, "embeddings")
    return e.filter((F.col("vec_id") % 8 == 0) & (F.col("label") == 3)).select(F.floor(F.col("vec_id") / 8).cast("long").alias("pid"))


@register("V31_index_remove", f"SELECT pid, CAST(CASE WHEN first_label = 3 THEN 0 ELSE doclen END AS BIGINT) AS doclen FROM {_PIDS.split(' AS (')[0]} ".replace(
    "SELECT pid", f"WITH {_PIDS} SELECT pid"))
def v31(spark, d):
    from .q_index import index
    return I.index_remove(index(spark, d), _removed(spark, d)).doclens


_CHUNKS = f"""WITH {_PIDS}, dl AS (SELECT pid, CASE WHEN first_label = 3 THEN 0 ELSE doclen END AS doclen, pid // 16 AS chunk FROM p),
meta AS (SELECT chunk, MIN(pid) AS passage_offset, COUNT(*) AS num_passages, SUM(doclen) AS num_embeddings FROM dl GROUP BY chunk)"""


def _meta(spark, d):
    """The index without its odd passages written in chunks of 16, then the odd ones added and the removed ones taken away on disk."""
    from .q_index import index
    ix, path = index(spark, d), scratch_dir(spark, "v32")
    odd = F.col("pid") % 2 == 1

    def half(cond):
        return I.Index(ix.codec, ix.codes.filter(cond), ix.ivf.filter(cond), ix.doclens.filter(cond))

    I.write_index(half(~odd), path, chunk_size=16)
    I.persist_changes(spark, path, _removed(spark, d).filter(~odd), half(odd), chunk_size=16)
    I.persist_changes(spark, path, _removed(spark, d).filter(odd), chunk_size=16)
    back = I.read_index(spark, path)
    found = back.codes.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))     # lengths as the written codes have them
    lengths = back.doclens.join(found, "pid", "left").select("pid", F.coalesce("n", F.lit(0)).cast("long").alias("doclen"))
    return I.chunk_metadata(I.assign_chunks(lengths, 16))


@register("V32_index_persist", _CHUNKS + """ SELECT CAST(chunk AS BIGINT) AS chunk, passage_offset, CAST(num_passages AS BIGINT) AS num_passages,
 CAST(num_embeddings AS BIGINT) AS num_embeddings,
 CAST(COALESCE(SUM(num_embeddings) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS embedding_offset FROM meta""")
def v32(spark, d):
    return _meta(spark, d).select("chunk", "passage_offset", "num_passages", "num_embeddings", "embedding_offset")


@register("V33_index_check", _CHUNKS + """ SELECT CAST(0 AS BIGINT) AS missing_chunks, CAST(0 AS BIGINT) AS offset_gaps""")
def v33(spark, d):
    m = _meta(spark, d)
    n = tokens(spark, d).select("pid").distinct().count()
    return I.index_check(m, (n + 15) // 16)


@register("V33_index_check_gap", _CHUNKS + """, m AS (SELECT * FROM meta WHERE chunk <> 1)
SELECT (SELECT COUNT(*) FROM meta) - (SELECT COUNT(*) FROM m) AS missing_chunks, (SELECT COUNT(*) FROM (SELECT passage_offset,
 lag(passage_offset + num_passages) OVER (ORDER BY chunk) AS e FROM m) WHERE e <> passage_offset) AS offset_gaps""")
def v33_gap(spark, d):
    n = tokens(spark, d).select("pid").distinct().count()
    return I.index_check(_meta(spark, d).filter("chunk <> 1"), (n + 15) // 16)


@register("K11_write_index", BASE + """SELECT CAST(pid // 16 AS BIGINT) AS chunk, COUNT(*) AS n, CAST(SUM(code) AS BIGINT) AS codes,
 COUNT(DISTINCT pid) AS passages FROM asg GROUP BY 1""")
def k11(spark, d):
    from .q_index import index
    path = scratch_dir(spark, "k11")
    ix = index(spark, d)
    I.write_index(ix, path, mode="overwrite", chunk_size=16)
    I.write_index(ix, path, mode="resume")      # nothing left to write: every chunk is present
    back = I.read_index(spark, path).codes.withColumn("chunk", F.floor(F.col("pid") / 16).cast("long"))
    return back.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("code").alias("codes"), F.count_distinct("pid").alias("passages"))


@register("ST1_stream_index", f"WITH {_PIDS} SELECT pid, CAST(CASE WHEN first_label = 3 THEN 0 ELSE doclen END AS BIGINT) AS doclen FROM p")
def st1(spark, d):
    from ..streaming.index_stream import read_streamed_index, stream_index
    base = scratch_dir(spark, "st1")
    src = os.path.join(base, "source")
    t = tokens(spark, d).withColumn("op", F.lit("add"))
    t = t.select("op", "pid", "tok_pos", F.col("embedding").cast("array<double>").alias("embedding"))
    t.repartitionByRange(3, "pid").write.parquet(src)
    rem = _removed(spark, d).select(F.lit("remove").alias("op"), "pid", F.lit(None).cast("long").alias("tok_pos"),
                                    F.lit(None).cast("array<double>").alias("embedding"))
    rem.coalesce(1).write.mode("append").parquet(src)
    stream_index(spark, src, t.schema, codec(spark, d), os.path.join(base, "index"), os.path.join(base, "ckpt"))
    _, dl = read_streamed_index(spark, os.path.join(base, "index"))
    return dl


@register("ST2_stream_metrics", B.with_ctes(B.SQL_RANKING_EVENTS) + """, lab AS (SELECT r.qid, r.rank, CASE WHEN e.event_type = 'purchase' THEN 1 ELSE 0 END AS label
  FROM ranking r JOIN events e ON r.pid = e.event_id),
a AS (SELECT qid, MIN(CASE WHEN label = 1 THEN rank END) AS f, SUM(CASE WHEN label = 1 AND rank <= 10 THEN 1 ELSE 0 END) AS h, SUM(label) AS n FROM lab GROUP BY qid)
SELECT qid, round(CASE WHEN f <= 10 THEN 1.0 / f ELSE 0 END, 6) AS mrr_10, CAST(CASE WHEN f <= 10 THEN 1.0 ELSE 0 END AS DOUBLE) AS success_10,
 round(CASE WHEN n > 0 THEN h * 1.0 / n ELSE 0 END, 6) AS recall_10 FROM a""")
def st2(spark, d):
    from ..streaming.metrics_stream import current_metrics, stream_metrics
    base = scratch_dir(spark, "st2")
    src = os.path.join(base, "source")
    e = table(spark, d, "events").select(F.col("event_id").alias("pid"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").cast("int").alias("label"))
    rows = B.ranking_events(spark, d).join(e, "pid").select("qid", "pid", "rank", "label", "ts")
    rows.repartitionByRange(4, "ts").write.parquet(src)
    stream_metrics(spark, src, rows.schema, os.path.join(base, "out"), os.path.join(base, "ckpt"), watermark="3650 days")  # files come in any order
    m = current_metrics(spark, os.path.join(base, "out"))
    return m.select("qid", F.round("mrr_10", 6).alias("mrr_10"), "success_10", F.round("recall_10", 6).alias("recall_10"))
