"""Registered queries: sources (S*) and sinks (K*). Each writes its input in the reference's
format from the test tables into a fresh folder under the shared checkpoint folder, reads it
back with the reader under test and returns the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import strip_control
from ..operators.weak import teacher_examples
from ..session import scratch_dir, table
from ..sources import readers as RD
from ..sources import sinks as SK
from .q_metrics import A1_A3_MEAN
from .registry import register

R = 6
P1 = "replace(replace(replace({x}, chr(13), ' '), chr(10), ' '), chr(9), ' ')"


def p1(x):
    return P1.format(x=x)


def _bench(spark, d):
    return table(spark, d, "benchmark")


@register("S1_read_queries", f"SELECT item_id AS qid, {p1('text')} AS query FROM benchmark")
def s1(spark, d):
    path = scratch_dir(spark, "s1")
    SK.write_tsv(_bench(spark, d), path, ["item_id", strip_control("text"), F.lit("ignored")])
    return RD.read_queries(spark, path)


@register("S2_read_qas_jsonl", "SELECT item_id AS qid, text AS question, CAST(len(string_split(text, ' ')) AS BIGINT) AS n FROM benchmark")
def s2(spark, d):
    path = scratch_dir(spark, "s2")
    _bench(spark, d).select(F.col("item_id").alias("qid"), F.col("text").alias("question"),
                            F.split("text", " ").alias("answers")).write.json(path)
    df = RD.read_qas_jsonl(spark, path)
    return df.select("qid", "question", F.size("answers").cast("long").alias("n"))


@register("S3_read_collection", f"SELECT doc_id AS pid, source || ' | ' || {p1('text')} AS passage FROM documents")
def s3(spark, d):
    path = scratch_dir(spark, "s3")
    docs = table(spark, d, "documents")
    SK.write_tsv(docs, path, ["doc_id", strip_control("text"), "source"])
    coll = RD.read_collection(spark, path, with_title=True)
    if RD.collection_density_violations(coll).limit(1).count():
        raise ValueError("collection pids are not line numbers")
    return coll


@register("S4_read_qrels_binary", "SELECT DISTINCT user_id AS qid, event_id AS pid FROM events WHERE event_type = 'purchase'")
def s4(spark, d):
    path = scratch_dir(spark, "s4")
    e = table(spark, d, "events").filter(F.col("event_type") == "purchase")
    rows = e.select("user_id", F.lit(0), "event_id", F.lit(1))
    SK.write_tsv(rows.unionByName(rows), path, ["user_id", "0", "event_id", "1"])
    q, bad = RD.read_qrels_binary(spark, path)
    if bad.limit(1).count():
        raise ValueError("qrels columns 2/4 must be 0/1")
    return q


@register("S5_read_qrels_graded", """SELECT CAST(user_id AS VARCHAR) AS qid, CAST(event_id AS VARCHAR) AS docid,
 CAST(CASE WHEN event_type IN ('purchase', 'click') THEN 2 ELSE 0 END AS INTEGER) AS rel FROM events""")
def s5(spark, d):
    path = scratch_dir(spark, "s5")
    e = table(spark, d, "events")
    first = e.select("user_id", "event_id", F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1)
                     .otherwise(0).alias("rel"))
    second = e.filter(F.col("event_type") == "click").select("user_id", "event_id", F.lit(2).alias("rel"))
    SK.write_tsv(first.unionByName(second).coalesce(1), path, ["user_id", F.lit("0"), "event_id", "rel"])
    return RD.read_qrels_graded(spark, path)


@register("S6_read_fold_qrels", """SELECT user_id AS qid, event_id AS did, CAST(CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS INTEGER) AS rel,
 CASE WHEN user_id % 5 <= 2 THEN 'train' WHEN user_id % 5 = 3 THEN 'valid' ELSE 'test' END AS split FROM events WHERE event_type IN ('purchase', 'click')""")
def s6(spark, d):
    base = scratch_dir(spark, "s6")
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", 2)
                                         .when(F.col("event_type") == "click", 1).otherwise(0).alias("rel"))
    paths = {}
    for split, cond in (("train", F.col("user_id") % 5 <= 2), ("valid", F.col("user_id") % 5 == 3), ("test", F.col("user_id") % 5 == 4)):
        paths[split] = f"{base}/{split}"
        SK.write_tsv(e.filter(cond), paths[split], ["user_id", F.lit("0"), "event_id", "rel"])
    return RD.read_fold_qrels(spark, paths)


_CONV = """pairs AS (SELECT u.conv_id * 1000 + u.turn AS qid, a.conv_id * 1000 + a.turn AS pid, {pu} AS query, {pa} AS passage
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')""".format(
    pu=p1("u.text"), pa=p1("a.text"))


def _conv_pairs(spark, d):
    from .q_weak import _conv_pairs as cp
    return cp(spark, d)


@register("S7_read_topk", f"WITH {_CONV} SELECT qid, pid, query, passage FROM pairs")
def s7(spark, d):
    path = scratch_dir(spark, "s7")
    SK.write_tsv(_conv_pairs(spark, d), path, ["qid", "pid", strip_control("query"), strip_control("passage")])
    rows, bad = RD.read_topk(spark, path)
    if bad.limit(1).count():
        raise ValueError("inconsistent top-k file")
    return rows


@register("S8_read_topk_pids", """SELECT user_id AS qid, CAST(COUNT(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS n_pos,
 COALESCE(array_to_string(list(event_id ORDER BY event_id) FILTER (WHERE event_type = 'purchase'), ','), '') AS positives FROM events GROUP BY user_id""")
def s8(spark, d):
    path = scratch_dir(spark, "s8")
    e = table(spark, d, "events")
    SK.write_tsv(e, path, ["user_id", "event_id", "value", (F.col("event_type") == "purchase").cast("int")])
    _, pos = RD.read_topk_pids(spark, path, has_label=True)
    return pos.select("qid", F.size("positives").cast("long").alias("n_pos"), F.array_join("positives", ",").alias("positives"))


@register("S9_read_ranking", """SELECT user_id AS qid, event_id AS pid, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS BIGINT) AS rank,
 CAST(value AS DOUBLE) AS score FROM events""")
def s9(spark, d):
    from .bindings import ranking_events
    path = scratch_dir(spark, "s9")
    SK.write_ranking(ranking_events(spark, d).select("qid", "pid", "rank", "score"), path, provenance={"source": "events"})
    return RD.read_ranking(spark, path)


@register("S10_read_trec_run", """SELECT CAST(user_id AS VARCHAR) AS qid, CAST(event_id AS VARCHAR) AS docid,
 CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS rank, CAST(value AS DOUBLE) AS score, 'run' AS tag FROM events""")
def s10(spark, d):
    from .bindings import ranking_events
    path = scratch_dir(spark, "s10")
    r = ranking_events(spark, d)
    SK.write_tsv(r, path, ["qid", F.lit("Q0"), "pid", "rank", "score", F.lit("run")])
    return RD.read_trec_run(spark, path)


@register("S11_read_examples", """SELECT user_id AS qid, array_to_string((list(event_id ORDER BY value DESC, event_id))[1:3], ',') AS pids FROM events GROUP BY user_id""")
def s11(spark, d):
    from ..operators.weak import teacher_examples
    path = scratch_dir(spark, "s11")
    e = table(spark, d, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("pid"), F.col("value").alias("score"))
    SK.write_examples(teacher_examples(e, nway=8), path)
    ex = RD.read_examples(spark, path, nway=3)
    return ex.select("qid", F.array_join(F.transform("pids", lambda x: x["pid"].cast("string")), ",").alias("pids"))


@register("S12_read_text_triples", f"""WITH t AS (SELECT conv_id, turn, {p1('text')} AS text, role FROM conversations)
SELECT u.text AS query, a.text AS positive, n.text AS negative FROM t u JOIN t a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
 JOIN t n ON n.conv_id = u.conv_id AND n.turn = u.turn + 3 WHERE u.role = 'user' AND a.role = 'assistant'""")
def s12(spark, d):
    path = scratch_dir(spark, "s12")
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", strip_control("text").alias("text"))
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("positive"))
    n = c.select("conv_id", (F.col("turn") - 3).alias("turn"), F.col("text").alias("negative"))
    SK.write_tsv(u.join(a, ["conv_id", "turn"]).join(n, ["conv_id", "turn"]), path, ["query", "positive", "negative"])
    return RD.read_text_triples(spark, path)


@register("S13_read_ctx_csv", f"""SELECT 'doc:' || CAST(doc_id AS VARCHAR) AS id, regexp_replace({p1('text')}, '^"+|"+$', '', 'g') AS text, source AS title FROM documents""")
def s13(spark, d):
    path = scratch_dir(spark, "s13")
    docs = table(spark, d, "documents")
    header = spark.createDataFrame([("id", "text", "title")], "doc_id string, text string, source string")
    SK.write_tsv(docs, path, ["doc_id", strip_control("text"), "source"])
    SK.write_tsv(header, path, ["doc_id", "text", "source"], mode="append")     # the reader skips it by its id
    return RD.read_ctx_csv(spark, path, id_prefix="doc:")


@register("S14_read_qa_csv", f"""SELECT {p1('text')} AS question, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_answers FROM benchmark""")
def s14(spark, d):
    path = scratch_dir(spark, "s14")
    b = _bench(spark, d)
    SK.write_tsv(b, path, [strip_control("text"), F.to_json(F.split("text", " "))])
    q = RD.read_qa_csv(spark, path)
    return q.select("question", F.size("answers").cast("long").alias("n_answers"))


@register("S15_read_qa_jsonl", "SELECT text AS question, CAST(CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_answers, CAST(item_id AS VARCHAR) AS id FROM benchmark")
def s15(spark, d):
    path = scratch_dir(spark, "s15")
    b = _bench(spark, d)
    b.select(F.col("text").alias("question"), F.when(F.col("item_id") % 2 == 0, F.array("text")).alias("answers"),
             F.col("item_id").cast("string").alias("id")).write.json(path)
    q = RD.read_qa_jsonl(spark, path)
    return q.select("question", F.size("answers").cast("long").alias("n_answers"), "id")


@register("S16_read_kilt_qa", "SELECT CAST(item_id AS VARCHAR) AS id, text AS question, lower(text) AS answer FROM benchmark")
def s16(spark, d):
    path = scratch_dir(spark, "s16")
    b = _bench(spark, d)
    b.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("input"),
             F.array(F.struct(F.lower("text").alias("answer")), F.struct(F.lit(None).cast("string").alias("answer"))).alias("output")) \
        .write.json(path)
    q = RD.read_kilt_qa(spark, path)
    return q.select("id", "question", F.get("answers", 0).alias("answer"))


@register("S16_read_kilt_qa_csv", f"""SELECT CAST(k.item_id AS VARCHAR) AS id, {p1('k.text')} AS question, {p1('q.text')} AS answers
 FROM benchmark k JOIN benchmark q ON {p1('k.text')} = {p1('q.text')} WHERE q.item_id % 2 = 0""")
def s16_csv(spark, d):
    """A QA file that answers the questions of every second KILT record, matched by question text."""
    kilt, path = scratch_dir(spark, "s16-kilt"), scratch_dir(spark, "s16-csv")
    b = _bench(spark, d).withColumn("text", strip_control("text"))
    b.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("input")).write.json(kilt)
    SK.write_tsv(b.filter("item_id % 2 = 0"), path, [F.col("text"), F.to_json(F.split("text", " "))])
    return RD.read_kilt_qa_csv(spark, path, kilt).select("id", "question", F.array_join("answers", " ").alias("answers"))


@register("S17_read_asr_qa", f"SELECT CAST(item_id AS VARCHAR) AS id, lower(trim({p1('text')})) AS question FROM benchmark")
def s17(spark, d):
    path = scratch_dir(spark, "s17")
    b = _bench(spark, d)
    b.select(F.concat(strip_control("text"), F.lit("(None-"), F.col("item_id").cast("string"), F.lit(")")).alias("value")).write.text(path)
    orig = b.select(F.col("item_id").alias("id"), F.array("text").alias("answers"))
    return RD.read_asr_qa(spark, path, orig).select("id", "question")


@register("S18_read_biencoder_json", """SELECT 'user ' || CAST(user_id AS VARCHAR) AS question,
 CAST(COUNT(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS n_pos, CAST(COUNT(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS n_neg,
 CAST(COUNT(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS n_hard FROM events GROUP BY user_id HAVING COUNT(*) FILTER (WHERE event_type = 'purchase') > 0""")
def s18(spark, d):
    path = scratch_dir(spark, "s18")
    e = table(spark, d, "events")

    def ctxs(t):
        return F.collect_list(F.when(F.col("event_type") == t, F.struct(F.col("event_id").cast("string").alias("id"),
                                                                         F.col("event_type").alias("title"), F.col("props").alias("text"),
                                                                         F.col("value").alias("score"))))
    s = e.groupBy("user_id").agg(ctxs("purchase").alias("positive_ctxs"), ctxs("view").alias("negative_ctxs"),
                                 ctxs("click").alias("hard_negative_ctxs"))
    s.select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("question"), F.array().cast("array<string>").alias("answers"),
             "positive_ctxs", "negative_ctxs", "hard_negative_ctxs").write.json(path)
    df = RD.read_biencoder_jsonl(spark, path, exclude_gold=True)
    return df.select("question", F.size("positive_ctxs").cast("long").alias("n_pos"), F.size("negative_ctxs").cast("long").alias("n_neg"),
                     F.size("hard_negative_ctxs").cast("long").alias("n_hard"))


@register("S19_read_encoded_vectors", """SELECT CASE WHEN label < 5 THEN 'a:' ELSE 'b:' END || CAST(vec_id AS VARCHAR) AS id, CAST(len(embedding) AS BIGINT) AS dim FROM embeddings""")
def s19(spark, d):
    base = scratch_dir(spark, "s19")
    e = table(spark, d, "embeddings")
    e.filter(F.col("label") < 5).select(F.col("vec_id").cast("string").alias("id"), "embedding").write.parquet(f"{base}/a")
    e.filter(F.col("label") >= 5).select(F.concat(F.lit("b:"), F.col("vec_id").cast("string")).alias("id"), "embedding").write.parquet(f"{base}/b")
    v = RD.read_encoded_vectors(spark, [f"{base}/a", f"{base}/b"], ["a:", "b:"])
    return v.select("id", F.size("embedding").cast("long").alias("dim"))


@register("S20_read_id_text", f"SELECT doc_id AS id, {p1('text')} AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def s20(spark, d):
    path = scratch_dir(spark, "s20")
    docs = table(spark, d, "documents")
    SK.write_header_tsv(docs.select(F.col("doc_id").alias("id"), strip_control("text").alias("text")), path)
    return RD.read_id_text(spark, path, table(spark, d, "labels").select(F.col("doc_id").alias("id")))


@register("S21_read_token_tables_jsonl")
def s21(spark, d):
    from ..functions.text import tokenize
    path = scratch_dir(spark, "s21")
    p = table(spark, d, "pages")
    toks = tokenize(F.col("html"))
    p.select(toks.alias("tokens"), F.transform(toks, lambda t: F.when(t.startswith("<") | (t == "<"), 1).otherwise(0)).alias("html_mask"),
             F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title")).write.json(path)
    return RD.read_token_tables_jsonl(spark, path).select("title", F.size("tokens").alias("n_tokens"))


@register("S22_read_gold_passages", """WITH g AS (SELECT u.conv_id, u.text AS question, array_to_string(string_split(u.text, ' '), ' ') AS question_tokens,
  'Conv ' || CAST(u.conv_id AS VARCHAR) AS title, a.text AS context, CAST(u.conv_id * 1000 + u.turn AS VARCHAR) AS example_id, u.turn
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'),
k AS (SELECT question AS key, * FROM g UNION ALL SELECT question_tokens AS key, * FROM g),
b AS (SELECT key, lower(title) AS title, context, example_id, row_number() OVER (PARTITION BY key ORDER BY conv_id DESC, turn DESC) AS rn FROM k)
SELECT key, title, context, example_id FROM b WHERE rn = 1""")
def s22(spark, d):
    path = scratch_dir(spark, "s22")
    c = table(spark, d, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("context"))
    g = u.join(a, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.struct("question", F.array_join(F.split("question", " "), " ").alias("question_tokens"),
                                    F.concat(F.lit("Conv "), F.col("conv_id").cast("string")).alias("title"), "context",
                                    (F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("example_id")).alias("g"))
    recs = g.orderBy("conv_id", "turn").select(F.to_json("g").alias("j"))

    def as_doc(it):   # one {"data": [...]} document per task (the reference's file shape), bounded by the partition
        import pandas as pd
        parts = [x for pdf in it for x in pdf["j"].tolist()]
        if parts:
            yield pd.DataFrame({"value": ['{"data": [' + ",".join(parts) + "]}"]})
    recs.mapInPandas(as_doc, "value string").write.text(path)
    return RD.read_gold_passages(spark, path)


@register("S23_read_portal_metadata", """SELECT CAST(p_partkey AS VARCHAR) AS dataset_id, p_name AS title, CAST(2 AS BIGINT) AS n_tags FROM part""")
def s23(spark, d):
    path = scratch_dir(spark, "s23")
    p = table(spark, d, "part")
    recs = p.select(F.to_json(F.struct(
        F.col("p_partkey").cast("string").alias("dataset_id"), F.col("p_name").alias("title"), F.col("p_type").alias("description"),
        F.col("p_brand").alias("author"), F.to_json(F.array(F.col("p_brand"), F.concat(F.lit("size:"), F.col("p_size").cast("string")))).alias("tags"),
        F.concat(F.lit("http://example.org/"), F.col("p_partkey").cast("string")).alias("url"))).alias("j"))

    def as_array(it):   # one JSON array per task (the portal's file shape), bounded by the partition
        import pandas as pd
        parts = [x for pdf in it for x in pdf["j"].tolist()]
        if parts:
            yield pd.DataFrame({"value": ["[" + ",".join(parts) + "]"]})
    recs.mapInPandas(as_array, "value string").write.text(path)
    m = RD.read_portal_metadata(spark, path)
    return m.select("dataset_id", "title", F.size("tags").cast("long").alias("n_tags"))


@register("S24_read_rdf_tables", """SELECT 'dataset_summary' AS t, CAST(COUNT(*) AS BIGINT) AS n FROM orders UNION ALL
 SELECT 'pid', COUNT(*) FROM lineitem UNION ALL SELECT 'rdf_term', COUNT(*) FROM lineitem UNION ALL
 SELECT 'rdf_term_deduplicate', COUNT(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) UNION ALL SELECT 'snippet', COUNT(*) FROM orders""")
def s24(spark, d):
    base = scratch_dir(spark, "s24")
    li = table(spark, d, "lineitem")
    o = table(spark, d, "orders")
    o.select(F.col("o_orderkey").alias("dataset_id"), F.col("o_orderstatus").alias("title")).write.parquet(f"{base}/dataset_summary")
    li.select(F.col("l_orderkey").alias("dataset_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file_id")).write.parquet(f"{base}/pid")
    li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file_id"), F.col("l_partkey").alias("id")).write.parquet(f"{base}/rdf_term")
    li.select(F.col("l_orderkey").alias("dataset_id"), F.col("l_partkey").alias("id")).distinct().write.parquet(f"{base}/rdf_term_deduplicate")
    o.select(F.col("o_orderkey").alias("dataset_id"), F.lit("").alias("snippet")).write.parquet(f"{base}/snippet")
    tabs = RD.read_rdf_tables(spark, base)
    out = None
    for name, df in tabs.items():
        x = df.agg(F.count(F.lit(1)).cast("long").alias("n")).select(F.lit(name).alias("t"), "n")
        out = x if out is None else out.unionByName(x)
    return out


@register("S25_read_source_by_name", """SELECT 'doc:' || CAST(doc_id AS VARCHAR) AS id, CAST(length(text) AS INTEGER) AS n FROM documents
 UNION ALL SELECT 'page:' || CAST(page_id AS VARCHAR), CAST(length(html) AS INTEGER) FROM pages""")
def s25(spark, d):
    RD.register_source("documents", lambda s: table(s, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"),
                                                                                  F.col("text")))
    RD.register_source("pages", lambda s: table(s, d, "pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("id"),
                                                                          F.col("html").alias("text")))
    return RD.read_source_by_name(spark, ["documents", "pages"]).select("id", F.length("text").alias("n"))


@register("S25_read_source_glob", """SELECT 'documents' AS name, CAST(doc_id AS BIGINT) AS id, CAST(length(text) AS INTEGER) AS n FROM documents
 UNION ALL SELECT 'pages', CAST(page_id AS BIGINT), CAST(length(html) AS INTEGER) FROM pages""")
def s25_glob(spark, d):
    """Names that are a glob over Parquet folders and a folder of JSON lines, beside each other."""
    path = scratch_dir(spark, "s25")
    docs = table(spark, d, "documents").select(F.lit("documents").alias("name"), F.col("doc_id").alias("id"), F.length("text").alias("n"))
    for part in (0, 1):
        docs.filter(F.pmod("id", F.lit(2)) == part).write.parquet(f"{path}/docs-{part}.parquet")
    table(spark, d, "pages").select(F.lit("pages").alias("name"), F.col("page_id").alias("id"), F.length("html").alias("n")).write.json(f"{path}/pages.jsonl")
    typed = lambda name: RD.read_source_by_name(spark, name).select("name", F.col("id").cast("long").alias("id"), F.col("n").cast("int").alias("n"))
    return typed(f"{path}/docs-*.parquet").unionByName(typed(f"{path}/pages.jsonl"))


@register("S27_read_index", "SELECT vec_id // 8 AS pid, CAST(COUNT(*) AS BIGINT) AS doclen FROM embeddings GROUP BY 1")
def s27(spark, d):
    from ..operators import index as I
    from .q_index import index
    path = scratch_dir(spark, "s27")
    I.write_index(index(spark, d), path)
    ix = I.read_index(spark, path)
    return ix.doclens


# ---- sinks ------------------------------------------------------------------------------------

@register("K1_write_ranking", """SELECT user_id AS qid, event_id AS pid, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS BIGINT) AS rank,
 CAST(value AS DOUBLE) AS score FROM events""")
def k1(spark, d):
    return s9(spark, d)


@register("K2_write_examples", """SELECT '[' || user_id || ',' || string_agg('[' || event_id || ',' || CAST(value AS DOUBLE) || ']', ',' ORDER BY value DESC, event_id) || ']' AS value
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3 GROUP BY user_id""")
def k2(spark, d):
    path = scratch_dir(spark, "k2")
    e = table(spark, d, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("pid"), F.col("value").cast("double").alias("score"))
    SK.write_examples(teacher_examples(e, 3), path)      # three-way examples
    return spark.read.text(path)


def _qa_hits(spark, d):
    from ..operators.qa import answer_in_passage
    from .q_qa import _pairs
    return answer_in_passage(_pairs(spark, d), "string")


from .q_qa import _ENC  # noqa: E402


@register("K3_write_results_nested", f"""WITH {_ENC} SELECT qid, CAST(COUNT(*) AS BIGINT) AS n_ctxs,
 string_agg(CAST(pid AS VARCHAR), ',' ORDER BY rank) AS ids, md5(string_agg(text, '|' ORDER BY rank)) AS texts FROM top JOIN documents ON pid = doc_id GROUP BY qid""")
def k3(spark, d):
    path = scratch_dir(spark, "k3")
    hits = _qa_hits(spark, d).select("qid", "pid", "rank", "score", "has_answer")
    passages = table(spark, d, "documents").select(F.col("doc_id").alias("pid"), F.col("source").alias("title"), "text")
    qs = _bench(spark, d).select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.array("text").alias("answers"))
    SK.write_json(SK.results_nested(hits, qs, passages), path)
    back = spark.read.json(path)
    return back.select("qid", F.size("ctxs").cast("long").alias("n_ctxs"), F.array_join(F.transform("ctxs", lambda c: c["id"]), ",").alias("ids"),
                       F.md5(F.array_join(F.transform("ctxs", lambda c: c["text"]), "|")).alias("texts"))


@register("K4_write_results_from_meta", f"""WITH {_ENC} SELECT qid, CAST(COUNT(*) AS BIGINT) AS n_ctxs, string_agg(source, ',' ORDER BY rank) AS titles,
 md5(string_agg(text, '|' ORDER BY rank)) AS texts FROM top JOIN documents ON pid = doc_id GROUP BY qid""")
def k4(spark, d):
    path = scratch_dir(spark, "k4")
    hits = _qa_hits(spark, d).select("qid", "pid", "rank", "score", "has_answer", F.col("source").alias("title"), "text")
    qs = _bench(spark, d).select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.array("text").alias("answers"))
    out = SK.results_nested(hits, qs).withColumn("ctxs", F.transform("ctxs", lambda c: c.withField("is_wiki", c["title"].startswith("src"))))
    SK.write_json(out, path)
    back = spark.read.json(path)
    return back.select("qid", F.size("ctxs").cast("long").alias("n_ctxs"), F.array_join(F.transform("ctxs", lambda c: c["title"]), ",").alias("titles"),
                       F.md5(F.array_join(F.transform("ctxs", lambda c: c["text"]), "|")).alias("texts"))


from .q_text import _TRIPLES_SQL  # noqa: E402
from .q_weak import _GEN_SQL  # noqa: E402


@register("K6_write_compact_docs", _TRIPLES_SQL)
def k6(spark, d):
    from .q_text import content_documents_from_orders
    path = scratch_dir(spark, "k6")
    SK.write_compact_docs(content_documents_from_orders(spark, d), path)
    return spark.read.options(**RD.TSV).schema("dataset_id long, document string").csv(path).fillna("", ["document"])


@register("K7_write_predictions", f"WITH {_GEN_SQL} SELECT doc_id AS dataset_id, prediction FROM g")
def k7(spark, d):
    from .q_weak import _generated
    path = scratch_dir(spark, "k7")
    SK.write_predictions(_generated(spark, d).withColumnRenamed("doc_id", "dataset_id"), path)
    return spark.read.schema("dataset_id long, prediction string").json(path)


@register("K8_write_teacher_scores", """SELECT '[' || user_id || ',[' || string_agg('[' || CAST(value AS DOUBLE) || ',' || event_id || ']', ',' ORDER BY value DESC, event_id) || ']]' AS value
 FROM events GROUP BY user_id""")
def k8(spark, d):
    path = scratch_dir(spark, "k8")
    e = table(spark, d, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("pid"), F.col("value").cast("double").alias("score"))
    SK.write_teacher_scores(teacher_examples(e), path)
    return spark.read.text(path)


@register("K9_write_metrics", A1_A3_MEAN)
def k9(spark, d):
    from .q_metrics import _qm
    from ..operators.metrics import mean_metrics
    path = scratch_dir(spark, "k9")
    nested = SK.metrics_nested(mean_metrics(_qm(spark, d)))
    SK.write_json(nested, path)
    back = spark.read.json(path)
    return back.select(*[F.col(f"{m}.`{c}`").alias(f"{m}_{c}") for m in ("mrr", "success", "recall") for c in back.schema[m].dataType.names]).select(
        *[F.round(c, 6).alias(c) for c in ("mrr_10", "success_5", "success_10", "recall_10")])


@register("K12_write_ctxmatch_shards", """SELECT CAST(shard AS INTEGER) AS shard, COUNT(*) AS n FROM (SELECT (row_number() OVER (ORDER BY u.conv_id * 1000 + u.turn) - 1) // 100 AS shard
 FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant') GROUP BY shard""")
def k12(spark, d):
    path = scratch_dir(spark, "k12")
    pairs = _conv_pairs(spark, d).select(F.col("qid").alias("id"), F.col("query").alias("question"), F.col("passage").alias("context"))
    SK.write_ctxmatch_shards(pairs, path, shard_size=100)
    return spark.read.json(path).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@register("K13_write_qas_tsv", f"""SELECT row_number() OVER (ORDER BY {p1('text')}) AS id, {p1('text')} AS question,
 '["' || CAST(item_id AS VARCHAR) || '"]' AS answers FROM benchmark""")
def k13(spark, d):
    path = scratch_dir(spark, "k13")
    qas = _bench(spark, d).select(strip_control("text").alias("question"), F.array(F.col("item_id").cast("string")).alias("answers"))
    SK.write_qas_tsv(qas, path)
    return spark.read.options(**RD.TSV).schema("id long, question string, answers string").csv(path)


@register("K14_write_collection", f"SELECT doc_id AS pid, {p1('text')} AS passage FROM documents")
def k14(spark, d):
    path = scratch_dir(spark, "k14")
    SK.write_collection(table(spark, d, "documents").select(F.col("doc_id").alias("pid"), F.col("text").alias("passage")), path)
    return RD.read_collection(spark, path)


@register("K15_write_vectors", """SELECT CAST(shard AS INTEGER) AS shard, COUNT(*) AS n FROM (SELECT (row_number() OVER (ORDER BY vec_id) - 1) // CAST(ceil((SELECT COUNT(*) FROM embeddings) / 4.0) AS BIGINT) AS shard FROM embeddings) GROUP BY shard""")
def k15(spark, d):
    path = scratch_dir(spark, "k15")
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    SK.write_vectors(v, path, 4)
    return spark.read.parquet(path).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
