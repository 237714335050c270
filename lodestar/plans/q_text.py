"""Registered queries: text functions (P*), documents (P2, P3, J4, D1) on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as DOC
from ..operators.ranking import running_in_keys
from ..session import table
from .registry import register

# DuckDB forms of the same column functions ---------------------------------------------------------
TOK = r"regexp_extract_all({x}, '[\p{{L}}\p{{N}}\p{{M}}]+|[^\p{{Z}}\p{{C}}]')"
PUNCT_RE = r"""'[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]'"""


def sql_tok(x: str) -> str:
    return TOK.format(x=x)


def sql_norm_answer(x: str) -> str:
    t = f"regexp_replace(lower({x}), {PUNCT_RE}, '', 'g')"
    for _ in range(3):
        t = rf"regexp_replace({t}, '(^|[^\p{{L}}\p{{N}}_])(a|an|the)([^\p{{L}}\p{{N}}_]|$)', '\1 \3', 'g')"
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


def _docs(spark, d):
    """Documents for per-row text work; a scan with fewer splits than cores is spread first."""
    from ..operators.vectors import spread_scan
    return spread_scan(table(spark, d, "documents"))


@register("P1_strip_control", "SELECT doc_id, replace(replace(replace(text, chr(13), ' '), chr(10), ' '), chr(9), ' ') AS t FROM documents")
def p1(spark, d):
    return _docs(spark, d).select("doc_id", T.strip_control("text").alias("t"))


_META_SQL = """SELECT p_partkey AS dataset_id, '[CLS] ' || concat_ws(' [SEP] ', p_name, p_type, nullif(p_brand, 'Brand#13'), NULL) || ' [SEP]' AS document FROM part"""


def _summary(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("dataset_id"), F.col("p_name").alias("title"),
                    F.col("p_type").alias("description"),
                    F.when(F.col("p_brand") != "Brand#13", F.col("p_brand")).alias("tags"),
                    F.lit(None).cast("string").alias("author"))


@register("P2_metadata_document", _META_SQL)
def p2(spark, d):
    return DOC.metadata_documents(_summary(spark, d))


@register("D1_distant_supervision", """SELECT p_partkey AS positive_id, p_name AS query,
 '[CLS] ' || concat_ws(' [SEP] ', p_type, nullif(p_brand, 'Brand#13'), NULL) || ' [SEP]' AS document FROM part WHERE p_name IS NOT NULL""")
def d1(spark, d):
    return DOC.distant_supervision(_summary(spark, d))


_TRIPLES_SQL = """WITH tr AS (
  SELECT l.l_orderkey AS dataset_id,
         row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey) AS pos,
         trim(concat_ws(' ', COALESCE(o.o_orderpriority, ''), COALESCE(p.p_name, ''), COALESCE(s.s_name, ''))) AS txt
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey),
tt AS (SELECT dataset_id, pos, array_to_string(({tok})[1:45], ' ') AS t FROM tr),
docs AS (SELECT dataset_id, '[CLS]' || string_agg(' ' || t || ' [SEP]', '' ORDER BY pos) AS document FROM tt GROUP BY dataset_id)
SELECT o.o_orderkey AS dataset_id, COALESCE(d.document, '') AS document FROM orders o LEFT JOIN docs d ON o.o_orderkey = d.dataset_id
WHERE o.o_orderstatus IS NOT NULL""".format(tok=sql_tok("lower(txt)"))


#: Lines of orders that a task joins and sorts.
TASK_LINES = 500_000


def content_documents_from_orders(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    p = table(spark, d, "part").select("p_partkey", "p_name")
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    # as many tasks as the lines ask for, so that no task sorts more of them as the tables grow
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-li.count() // TASK_LINES))
    lines = (li.repartition(n, "l_partkey").join(p, li.l_partkey == p.p_partkey, "left")
             .repartition(n, "l_suppkey").join(s, F.col("l_suppkey") == s.s_suppkey, "left").repartition(n, "l_orderkey"))
    # a line's place is told by what orders it: lines that agree in all three have the same labels
    triples = (lines.join(o, F.col("l_orderkey") == o.o_orderkey)
               .select(F.col("l_orderkey").alias("dataset_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"),
                       F.col("o_orderpriority").alias("sub_label"), F.col("p_name").alias("pre_label"),
                       F.col("s_name").alias("obj_label")))
    datasets = o.select(F.col("o_orderkey").alias("dataset_id"), F.col("o_orderstatus").alias("title"))
    return DOC.content_document(triples, datasets, 45)


@register("P3_content_document", _TRIPLES_SQL)
def p3(spark, d):
    return content_documents_from_orders(spark, d)


@register("J4_term_label_lookup", """WITH pid AS (SELECT l_orderkey AS dataset_id, l_orderkey * 10 + l_linenumber AS file_id FROM lineitem),
rdf_term AS (SELECT l.l_orderkey * 10 + l.l_linenumber AS file_id, l.l_partkey AS id, p.p_name AS label FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
dedup AS (SELECT DISTINCT l.l_orderkey AS dataset_id, l.l_partkey AS id, upper(p.p_name) AS label FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
terms AS (SELECT DISTINCT l_orderkey AS dataset_id, l_partkey AS id FROM lineitem),
files AS (SELECT dataset_id, COUNT(*) AS nf, MIN(file_id) AS file_id FROM pid GROUP BY dataset_id)
SELECT t.dataset_id, t.id, r.label FROM terms t JOIN files f ON t.dataset_id = f.dataset_id
  LEFT JOIN rdf_term r ON r.file_id = f.file_id AND r.id = t.id WHERE f.nf = 1
UNION ALL
SELECT t.dataset_id, t.id, x.label FROM terms t JOIN files f ON t.dataset_id = f.dataset_id
  LEFT JOIN dedup x ON x.dataset_id = t.dataset_id AND x.id = t.id WHERE f.nf > 1""")
def j4(spark, d):
    li = table(spark, d, "lineitem")
    p = table(spark, d, "part").select("p_partkey", "p_name")
    pid = li.select(F.col("l_orderkey").alias("dataset_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file_id"))
    lp = li.join(p, li.l_partkey == p.p_partkey)
    rdf_term = lp.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file_id"),
                         F.col("l_partkey").alias("id"), F.col("p_name").alias("label"))
    dedup = lp.select(F.col("l_orderkey").alias("dataset_id"), F.col("l_partkey").alias("id"),
                      F.upper("p_name").alias("label")).distinct()
    terms = li.select(F.col("l_orderkey").alias("dataset_id"), F.col("l_partkey").alias("id")).distinct()
    return DOC.term_label_lookup(terms, pid, rdf_term, dedup)


@register("P3_explode_snippet", """SELECT l_orderkey AS dataset_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos,
 l_orderkey AS sub, CAST(l_linenumber AS BIGINT) AS pre, l_partkey AS obj FROM lineitem""")
def p3_snippet(spark, d):
    """Snippets ``"s p o,s p o"`` of an order's lines, parsed back into term ids."""
    from ..operators.documents import explode_snippet
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    line = F.concat_ws(" ", "l_orderkey", "l_linenumber", "l_partkey")
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("t"))))
    snippets = li.groupBy(F.col("l_orderkey").alias("dataset_id")).agg(F.array_join(F.transform(lines, lambda x: x["t"]), ",").alias("snippet"))
    return explode_snippet(snippets)


@register("P4_truncate_tokens", f"SELECT doc_id, array_to_string(({sql_tok('text')})[1:45], ' ') AS t FROM documents")
def p4(spark, d):
    return _docs(spark, d).select("doc_id", T.truncate_tokens(T.tokenize("text"), 45).alias("t"))


@register("P5_normalize_question", """SELECT conv_id, turn, CASE WHEN suffix(replace(text, '’', ''''), '?') THEN replace(text, '’', '''')
 ELSE replace(text, '’', '''') || '?' END AS q FROM conversations WHERE role = 'user'""")
def p5(spark, d):
    c = table(spark, d, "conversations").filter(F.col("role") == "user")
    return c.select("conv_id", "turn", T.normalize_question("text", "?").alias("q"))


@register("P6_normalize_passage", """SELECT doc_id, regexp_replace(regexp_replace(replace(replace(text, chr(10), ' '), '’', ''''), '^"', ''), '"$', '') AS t FROM documents""")
def p6(spark, d):
    return _docs(spark, d).select("doc_id", T.normalize_passage("text").alias("t"))


@register("P7_prefix_query_token", "SELECT item_id, '[unused0] ' || text AS q FROM benchmark")
def p7(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.prefix_query_token("text", "[unused0]").alias("q"))


@register("P8_prefix_id", """SELECT id FROM (SELECT 'doc:' || CAST(doc_id AS VARCHAR) AS id FROM documents
 UNION ALL SELECT 'doc:' || CAST(doc_id AS VARCHAR) FROM documents)""")
def p8(spark, d):
    once = _docs(spark, d).select(T.prefix_id("doc_id", "doc:").alias("id"))
    twice = once.select(T.prefix_id("id", "doc:").alias("id"))  # idempotent
    return once.unionByName(twice)


@register("P9_nfd")
def p9(spark, d):
    return _docs(spark, d).select("doc_id", T.nfd("text").alias("t"), F.length(T.nfd("text")).alias("n"))


@register("P10_normalize_answer", f"SELECT doc_id, {sql_norm_answer('text')} AS t FROM documents")
def p10(spark, d):
    return _docs(spark, d).select("doc_id", T.normalize_answer("text").alias("t"))


@register("P11_exact_match", f"""WITH x AS (SELECT doc_id, text, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS nxt FROM documents)
SELECT doc_id, CAST(CASE WHEN {sql_norm_answer('text')} = {sql_norm_answer('nxt')} THEN 1 ELSE 0 END AS BIGINT) AS em FROM x WHERE nxt IS NOT NULL""")
def p11(spark, d):
    docs = _docs(spark, d)
    at = running_in_keys(docs.select("doc_id", "source"), ["source"], ["doc_id"], out="at")
    pairs = at.alias("a").join(at.alias("b"), F.expr("a.source <=> b.source and b.at = a.at + 1")).select("a.doc_id", F.col("b.doc_id").alias("next_id"))
    after = docs.select(F.col("doc_id").alias("next_id"), F.col("text").alias("nxt")).filter(F.col("nxt").isNotNull())
    x = pairs.join(after, "next_id").join(docs.select("doc_id", "text"), "doc_id")
    return x.select("doc_id", T.exact_match("text", "nxt").cast("long").alias("em"))


@register("P12_tokenize", f"""SELECT doc_id, CAST(len({sql_tok('text')}) AS BIGINT) AS n_tokens, array_to_string({sql_tok('text')}, ' ') AS tokens,
 array_to_string(list_transform({sql_tok('text')}, lambda t: lower(t)), ' ') AS lower_tokens FROM documents""")
def p12(spark, d):
    toks = T.tokenize("text")
    return _docs(spark, d).select("doc_id", F.size(toks).cast("long").alias("n_tokens"),
                                  F.array_join(toks, " ").alias("tokens"),
                                  F.array_join(T.tokenize("text", lower=True), " ").alias("lower_tokens"))


@register("P13_token_offsets", f"""WITH t AS (SELECT doc_id, text, len({sql_tok('text')}) AS n,
 regexp_extract(text, '^[\\pZ\\pC]*((?:(?:[\\pL\\pN\\pM]+|[^\\pZ\\pC])[\\pZ\\pC]*){{1,10}})', 1) AS cap FROM documents)
SELECT doc_id, CAST(n AS BIGINT) AS n_tokens, trim(CASE WHEN n <= 10 THEN regexp_replace(cap, '[\\pZ\\pC]+$', '') ELSE cap END) AS first10,
 CAST(length(regexp_replace(text, '[\\pZ\\pC]+$', '')) AS INTEGER) AS last_end FROM t""")
def p13(spark, d):
    sp = T.token_spans("text")
    return _docs(spark, d).select("doc_id", F.size(sp).cast("long").alias("n_tokens"),
                                  T.untokenize(sp, 0, 10).alias("first10"),
                                  F.coalesce(F.try_element_at(sp, F.lit(-1))["end"], F.when(sp.isNotNull(), 0)).alias("last_end"))  # no token: 0


@register("P14_ngrams", f"""SELECT item_id, array_to_string(flatten(list_transform(range(0, len(t)),
 lambda s: list_transform(range(1, least(2, len(t) - s) + 1), lambda l: array_to_string(t[s + 1:s + l], ' ')))), '|') AS grams
 FROM (SELECT item_id, {sql_tok('text')} AS t FROM benchmark)""")
def p14(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.array_join(T.ngrams(T.tokenize("text"), 2), "|").alias("grams"))


@register("P15_query_template", f"""SELECT item_id, array_to_string(list_concat(body, list_transform(range(0, GREATEST(32 - len(body), 0)), lambda i: '[MASK]')), ' ') AS ids
 FROM (SELECT item_id, list_concat(['[CLS]', '[Q]'], ({sql_tok('text')})[1:29], ['[SEP]']) AS body FROM benchmark)""")
def p15(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.array_join(T.query_template(T.tokenize("text"), 32), " ").alias("ids"))


@register("P16_query_context_append", f"""SELECT item_id, CAST(len(list_concat(q, c[2:512 - 32 + 1 + 1])) AS BIGINT) AS n,
 array_to_string(list_concat(q, c[2:512 - 32 + 1 + 1]), ' ') AS ids
 FROM (SELECT b.item_id, list_concat(['[CLS]', '[Q]'], ({sql_tok('b.text')})[1:29], ['[SEP]']) AS q,
       list_concat(['[CLS]', '[D]'], ({sql_tok('d.text')})[1:217], ['[SEP]']) AS c
       FROM benchmark b JOIN documents d ON b.item_id = d.doc_id)""")
def p16(spark, d):
    b = table(spark, d, "benchmark")
    docs = _docs(spark, d).select(F.col("doc_id").alias("item_id"), F.col("text").alias("ctx"))
    x = b.join(docs, "item_id")
    q = F.concat(F.array(F.lit(T.CLS), F.lit(T.Q_MARKER)), F.slice(T.tokenize("text"), 1, 29), F.array(F.lit(T.SEP)))
    ids = T.query_context_append(q, T.doc_template(T.tokenize("ctx"), 220), 32)
    return x.select("item_id", F.size(ids).cast("long").alias("n"), F.array_join(ids, " ").alias("ids"))


@register("P17_doc_template", f"""SELECT doc_id, array_to_string(list_concat(['[CLS]', '[D]'], ({sql_tok('text')})[1:217], ['[SEP]']), ' ') AS ids FROM documents""")
def p17(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(T.doc_template(T.tokenize("text"), 220), " ").alias("ids"))


_PUNCT_LIST = ", ".join("'" + ch.replace("'", "''") + "'" for ch in T.PUNCTUATION)


@register("P18_mask_tokens", f"""SELECT doc_id, CAST(len(list_filter({sql_tok('text')}, lambda t: NOT list_contains([{_PUNCT_LIST}, '[MASK]'], t))) AS BIGINT) AS doclen FROM documents""")
def p18(spark, d):
    kept = T.mask_tokens(T.tokenize("text"), list(T.PUNCTUATION))
    return _docs(spark, d).select("doc_id", F.size(kept).cast("long").alias("doclen"))


@register("P19_pad_or_cut", f"""SELECT item_id, array_to_string(CASE WHEN len(t) < 16 THEN list_concat(t, list_transform(range(0, 16 - len(t)), lambda i: '[PAD]'))
 ELSE list_concat(t[1:15], ['[SEP]']) END, ' ') AS ids FROM (SELECT item_id, {sql_tok('text')} AS t FROM benchmark)""")
def p19(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.array_join(T.pad_or_cut(T.tokenize("text"), 16, "[PAD]", "[SEP]"), " ").alias("ids"))


_PAIRS = """pairs AS (SELECT u.conv_id, u.turn, {tu} AS qt, {ta} AS pt FROM conversations u JOIN conversations a
  ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')""".format(
    tu=sql_tok("u.text"), ta=sql_tok("a.text"))


def _pairs(spark, d):
    c = table(spark, d, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("q"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("p"))
    return u.join(a, ["conv_id", "turn"])


@register("P20_segment_ids", "WITH " + _PAIRS + """ SELECT conv_id, turn, CAST(len(qt) + 1 AS BIGINT) AS seg0,
 CAST(len(pt) AS BIGINT) AS seg1 FROM pairs""")
def p20(spark, d):
    x = _pairs(spark, d).select("conv_id", "turn", F.concat(T.tokenize("q"), F.array(F.lit(T.SEP)), T.tokenize("p")).alias("ids"))
    seg = T.segment_ids(F.col("ids"), T.SEP)
    return x.select("conv_id", "turn", F.aggregate(seg, F.lit(0).cast("long"), lambda a, s: a + (1 - s)).alias("seg0"),
                    F.aggregate(seg, F.lit(0).cast("long"), lambda a, s: a + s).alias("seg1"))


@register("P21_pair_concat", "WITH " + _PAIRS + " SELECT conv_id, turn, CAST(len(qt) AS BIGINT) AS offset, CAST(len(qt) + len(pt) AS BIGINT) AS n FROM pairs")
def p21(spark, d):
    x = _pairs(spark, d).select("conv_id", "turn", T.pair_concat(T.tokenize("q"), T.tokenize("p")).alias("pc"))
    return x.select("conv_id", "turn", F.col("pc.offset").cast("long").alias("offset"), F.size("pc.ids").cast("long").alias("n"))


@register("P22_window_around_token", f"""SELECT doc_id, array_to_string(t[CASE WHEN p > 64 THEN p - 64 + 1 ELSE 1 END:CASE WHEN p > 64 THEN p ELSE 64 END], ' ') AS w
 FROM (SELECT doc_id, t, list_position(t, '.') AS p FROM (SELECT doc_id, {sql_tok('text')} AS t FROM documents))""")
def p22(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(T.window_around_token(T.tokenize("text"), ".", 64), " ").alias("w"))


@register("P23_marker_position", f"SELECT doc_id, CAST(GREATEST(COALESCE(list_position({sql_tok('text')}, '.'), 0) - 1, 0) AS BIGINT) AS pos FROM documents")
def p23(spark, d):
    return _docs(spark, d).select("doc_id", T.marker_position(T.tokenize("text"), ".").alias("pos"))


@register("P24_background_text", "SELECT conv_id, string_agg(text, ' [SEP] ' ORDER BY turn) AS background FROM conversations GROUP BY conv_id")
def p24(spark, d):
    from ..operators.weak import background_text
    c = table(spark, d, "conversations")
    lists = c.select(F.col("conv_id").alias("qid"), F.col("turn").alias("pos"), F.col("turn").alias("pid"))
    passages = c.select(F.col("turn").alias("pid"), "conv_id", F.col("text").alias("passage"))
    return background_text(lists, passages, extra_key="conv_id").withColumnRenamed("qid", "conv_id")


@register("P25_dedupe_keep_order", f"""SELECT item_id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ' ') AS toks
 FROM (SELECT item_id, {sql_tok('text')} AS t FROM benchmark)""")
def p25(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.dedupe_keep_order(T.tokenize("text")), " ").alias("toks"))


@register("P26_linearize_row", """SELECT conv_id, turn, array_to_string(string_split(text, chr(10)), ', ') AS row_text,
 CAST(list_sum(list_transform(string_split(text, chr(10)), lambda c: len(string_split(c, ' ')))) AS BIGINT) AS words FROM conversations""")
def p26(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.split("text", "\n").alias("cells"))
    return c.select("conv_id", "turn", T.linearize_row(F.col("cells")).alias("row_text"),
                    T.row_word_count(F.col("cells")).cast("long").alias("words"))


@register("P27_table_text_for_match", """SELECT conv_id, string_agg(array_to_string(string_split(text, chr(10)), ' . '), '' ORDER BY turn) || ' . ' AS t
 FROM conversations GROUP BY conv_id""")
def p27(spark, d):
    c = table(spark, d, "conversations")
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.split("text", "\n").alias("cells")))).alias("r"))
    return rows.select("conv_id", T.table_text_for_match(F.transform("r", lambda x: x["cells"])).alias("t"))


@register("P28_explode_text_fields", """SELECT p_partkey AS dataset_id, p_name AS target, '[CLS] ' || concat_ws(' [SEP] ', p_type, nullif(p_brand, 'Brand#13')) || ' [SEP]' AS text FROM part
 UNION ALL SELECT p_partkey, p_name, p_type FROM part""")
def p28(spark, d):
    s = _summary(spark, d)
    x = s.select("dataset_id", F.col("title").alias("target"),
                 F.explode(F.array(T.metadata_document("description", "tags", "author"), F.col("description"))).alias("text"))
    return x


@register("P29_mask_target_padding", f"""SELECT item_id, array_to_string(list_transform(ids, lambda x, i: CASE WHEN COALESCE(list_position(ids, 1), 0) > 0 AND i > list_position(ids, 1) THEN -100 ELSE x END), ' ') AS labels
 FROM (SELECT item_id, list_transform({sql_tok('text')}, lambda t: CAST(length(t) AS INTEGER)) AS ids FROM benchmark)""")
def p29(spark, d):
    ids = F.transform(T.tokenize("text"), lambda t: F.length(t))
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.mask_target_padding(ids, 1), " ").alias("labels"))


# every third piece continues a word; spans of one piece at unlike places
@register("P30_subword_merge_span", f"""WITH t AS (SELECT item_id, item_id % 7 AS s, len({sql_tok('text')}) AS n FROM benchmark)
SELECT item_id, CAST(s - CASE WHEN s % 3 = 1 THEN 1 ELSE 0 END AS INTEGER) AS start,
 CAST(s + CASE WHEN (s + 1) % 3 = 1 AND s + 1 < n THEN 1 ELSE 0 END AS INTEGER) AS "end" FROM t""")
def p30(spark, d):
    b = table(spark, d, "benchmark")
    pieces = F.transform(T.tokenize("text"), lambda t, i: F.when(i % 3 == 1, F.concat(F.lit("##"), t)).otherwise(t))
    x = b.select("item_id", pieces.alias("t"))
    at = (F.col("item_id") % 7).cast("int")
    sp = T.subword_merge_span(F.col("t"), at, at)
    return x.select("item_id", sp["start"].alias("start"), sp["end"].alias("end"))


@register("P31_ragged_to_padded", f"""WITH t AS (SELECT conv_id, turn, len({sql_tok('text')}) AS n FROM conversations),
m AS (SELECT conv_id, MAX(n) AS mx FROM t GROUP BY conv_id)
SELECT t.conv_id, t.turn, CAST(m.mx AS BIGINT) AS padded_len, CAST(t.n AS BIGINT) AS mask_sum FROM t JOIN m ON t.conv_id = m.conv_id""")
def p31(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", T.tokenize("text").alias("t"))
    mx = F.max(F.size("t")).over(Window.partitionBy("conv_id"))
    x = c.withColumn("_mx", mx)
    return x.select("conv_id", "turn", F.size(T.ragged_pad(F.col("t"), F.col("_mx"), "[PAD]")).cast("long").alias("padded_len"),
                    F.aggregate(T.mask_of(F.col("t"), F.col("_mx")), F.lit(0).cast("long"), lambda a, v: a + v).alias("mask_sum"))
