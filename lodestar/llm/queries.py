"""The registered queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import (chat, conversation_repair, jaccard_join, knn_quality, license_scan, mixing, periodic_runs, pii, quality_rules, sharding, simhash,
               spotsigs, tokens)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


@register("op2_pii")
def op2(spark, sf_dir):
    return pii.scan_documents(table(spark, sf_dir, "documents"))


@register("op4_mixing")
def op4(spark, sf_dir):
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


@register("op7_license_scan")
def op7(spark, sf_dir):
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))


@register("op10_sharding")
def op10(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@register("op3_quality_rules")
def op3(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


_SAID = r"\### Assistant: </turn> ok"


@register("op5_chat_format", f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}'),
e AS (SELECT *, replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|') AS r,
 replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|') AS t FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length('<|turn|>') + length(r) + length('<|says|>') + length(t) + length('<|end|>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""")
def op5(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", _SAID), (-7, 1, "assistant", _SAID)], talks.schema)
    return chat.digest_chat(chat.format_chat(chat.as_parts(talks.unionByName(extra))))


@register("op9_spotsigs")
def op9(spark, sf_dir):
    return spotsigs.fingerprint_documents(table(spark, sf_dir, "documents"))


@register("op1_sentencepiece")
def op1(spark, sf_dir):
    return tokens.encode_documents(table(spark, sf_dir, "documents"))


@register("op8_jaccard_join", r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))
 WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(d, o) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.d, b.y FROM r JOIN b ON r.o = b.x)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.o), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.d = w.doc_id GROUP BY w.doc_id""")
def op8(spark, sf_dir):
    return jaccard_join.link_documents(table(spark, sf_dir, "documents"))


@register("op6_knn_quality")
def op6(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return knn_quality.score_documents(table(spark, sf_dir, "documents"), labels)


@register("op11_simhash")
def op11(spark, sf_dir):
    return simhash.link_documents(table(spark, sf_dir, "documents"))


@register("op12_periodic_runs")
def op12(spark, sf_dir):
    docs = periodic_runs.with_planted_runs(table(spark, sf_dir, "documents"))
    return periodic_runs.digest_runs(periodic_runs.collapse_runs(docs))


@register("op13_conversation_repair")
def op13(spark, sf_dir):
    return conversation_repair.repair_conversations(conversation_repair.with_damage(table(spark, sf_dir, "conversations")))
