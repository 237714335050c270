"""Registered queries: table extraction, chunking, linearisation, answer cells, corpus stats
(T1-T3, D11, A23, G5 on tables). ``pages`` hold no ``<table>`` markup, so besides the default
table tags the same extractor is run with list markup (``ul``/``li``) to exercise it on real rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables as TB
from ..session import table
from .registry import register

LIST_TAGS = dict(table_tags=("ul",), row_tags=("li",), cell_tags=("li",))
#: Wider than list markup, so that tables nest and hold several cells: each ``nav`` or ``ul`` is a table.
NEST_TAGS = dict(table_tags=("nav", "ul", "article"), row_tags=("li", "p", "h1"), cell_tags=("li", "p", "a", "h1"))

#: DuckDB: list tables of all pages. ``items``: one row per list item; the pages' lists do not nest.
LISTS = r"""
toks AS (SELECT page_id AS doc_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
         unnest(regexp_extract_all(html, '<[^>]+>|[^<\s]+')) AS token,
         generate_subscripts(regexp_extract_all(html, '<[^>]+>|[^<\s]+'), 1) AS pos FROM pages),
tags AS (SELECT *, regexp_matches(token, '^<[^>]+>$') AS tag, lower(regexp_extract(token, '^<\s*/?\s*([^\s/>]+)', 1)) AS name,
         regexp_matches(token, '^<\s*/') AS closing FROM toks),
depths AS (SELECT *, CASE WHEN tag AND name = 'ul' THEN CASE WHEN closing THEN -1 ELSE 1 END ELSE 0 END AS step FROM tags),
sums AS (SELECT *, sum(step) OVER (PARTITION BY doc_id ORDER BY pos) AS s,
         sum(CASE WHEN step = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS tab FROM depths),
rowed AS (SELECT *, sum(CASE WHEN tag AND name = 'li' AND NOT closing THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, tab ORDER BY pos) AS item
          FROM sums WHERE s > 0 OR step = -1),
items AS (SELECT doc_id, tab - 1 AS table_id, item, coalesce(string_agg(token, ' ' ORDER BY pos) FILTER (WHERE NOT tag), '') AS line
          FROM rowed WHERE item > 0 GROUP BY ALL),
captions AS (SELECT doc_id, tab - 1 AS table_id, trim(any_value(title) || coalesce(' ' || string_agg(token, ' ' ORDER BY pos) FILTER (WHERE NOT tag AND item = 0), '')) AS caption
             FROM rowed GROUP BY ALL),
every_table AS (SELECT c.doc_id, c.table_id, c.caption, coalesce(i.n_rows, 0) AS n_rows, coalesce(i.filled, 0) AS filled FROM captions c LEFT JOIN
  (SELECT doc_id, table_id, count(*) AS n_rows, count(*) FILTER (WHERE line <> '') AS filled FROM items GROUP BY ALL) i USING (doc_id, table_id)),
kept AS (SELECT * FROM every_table WHERE filled > 1),
lines AS (SELECT doc_id, table_id, caption, item, line, length(line) - length(replace(line, ' ', '')) + 1 AS words,
          row_number() OVER (PARTITION BY doc_id, table_id ORDER BY item) AS k
          FROM items JOIN kept USING (doc_id, table_id) WHERE length(line) > 1)
"""


def _docs(spark, d):
    p = table(spark, d, "pages")
    return p.select(F.col("page_id").alias("doc_id"), TB.markup_tokens(F.col("html")).alias("tokens"),
                    F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), "html")


def list_tables(spark, d):
    return TB.extract_tables(_docs(spark, d), **LIST_TAGS)


#: DuckDB: nested tables of all pages by windows over tokens: depth is a running sum of table tags that is held at
#: zero from below, a token's table the last one opened at its depth, row and cell running counts in that table.
NESTED = r"""
toks AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '<[^>]+>|[^<\s]+')) AS token,
         generate_subscripts(regexp_extract_all(html, '<[^>]+>|[^<\s]+'), 1) AS pos FROM pages),
tags AS (SELECT *, regexp_matches(token, '^<[^>]+>$') AS tag, lower(regexp_extract(token, '^<\s*/?\s*([^\s/>]+)', 1)) AS name,
         regexp_matches(token, '^<\s*/') AS closing FROM toks),
steps AS (SELECT *, CASE WHEN tag AND name IN ('nav', 'ul', 'article') THEN CASE WHEN closing THEN -1 ELSE 1 END ELSE 0 END AS step FROM tags),
sums AS (SELECT *, sum(step) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM steps),
deep AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY pos)) + CASE WHEN step < 0 THEN 1 ELSE 0 END AS depth FROM sums),
owned AS (SELECT *, last_value(CASE WHEN step > 0 THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id, depth ORDER BY pos) AS start
          FROM deep WHERE depth > 0),
rowed AS (SELECT *, sum(CASE WHEN tag AND NOT closing AND name IN ('li', 'p', 'h1') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, start ORDER BY pos) AS r
          FROM owned WHERE start IS NOT NULL),
cells AS (SELECT *, CASE WHEN r > 0 THEN sum(CASE WHEN tag AND NOT closing AND name IN ('li', 'p', 'a', 'h1') THEN 1 ELSE 0 END)
          OVER (PARTITION BY doc_id, start, r ORDER BY pos) ELSE 0 END AS c FROM rowed),
heads AS (SELECT doc_id, start, depth, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS table_id FROM cells WHERE pos = start),
around AS (SELECT h.doc_id, h.start, o.depth AS level, max(o.start) AS o_start, max(o.table_id) AS o_id FROM heads h
           JOIN heads o ON o.doc_id = h.doc_id AND o.depth < h.depth AND o.start < h.start GROUP BY ALL),
told AS (SELECT a.start, a.level, t.* EXCLUDE (start), arg_max(t.r, t.pos) OVER w AS now_r, arg_max(t.c, t.pos) OVER w AS now_c
         FROM around a JOIN cells t ON t.doc_id = a.doc_id AND t.start = a.o_start AND t.pos < a.start
         WINDOW w AS (PARTITION BY a.doc_id, a.start, a.level)),
parts AS (SELECT doc_id, start, level, coalesce(' ' || string_agg(token, ' ' ORDER BY pos) FILTER (WHERE NOT tag AND c = 0), '')
          || CASE WHEN max(now_c) > 0 THEN ' | ' || coalesce(string_agg(token, ' ' ORDER BY pos) FILTER (WHERE NOT tag AND c > 0 AND r = now_r AND c = now_c), '') ELSE '' END AS part
          FROM told GROUP BY ALL),
leads AS (SELECT doc_id, start, string_agg(part, '' ORDER BY level) AS lead FROM parts GROUP BY ALL),
parents AS (SELECT doc_id, start, arg_max(o_id, level) AS parent_table_id FROM around GROUP BY ALL),
sizes AS (SELECT doc_id, start, coalesce(' ' || string_agg(token, ' ' ORDER BY pos) FILTER (WHERE NOT tag AND c = 0), '') AS said, max(r) AS n_rows,
          count(DISTINCT (r, c)) FILTER (WHERE c > 0) AS n_cells, count(DISTINCT r) FILTER (WHERE c > 0 AND NOT tag) AS filled FROM cells GROUP BY ALL),
nested AS (SELECT doc_id, table_id, parent_table_id, depth, n_rows, n_cells, filled,
           trim(regexp_extract(html, '<title>(.*?)</title>', 1) || coalesce(lead, '') || said, ' ') AS caption
           FROM heads JOIN sizes USING (doc_id, start) LEFT JOIN leads USING (doc_id, start) LEFT JOIN parents USING (doc_id, start)
           JOIN pages ON page_id = doc_id)
"""


@register("T1_extract_tables", f"WITH {NESTED} SELECT doc_id, table_id, parent_table_id, caption, CAST(n_rows AS INTEGER) AS n_rows, "
          "CAST(n_cells AS INTEGER) AS n_cells FROM nested WHERE filled > 1")
def t1(spark, d):
    t = TB.extract_tables(_docs(spark, d), **NEST_TAGS)
    return t.select("doc_id", "table_id", "parent_table_id", "caption", F.size("rows").alias("n_rows"),
                    F.size(F.flatten("rows")).alias("n_cells"))


# the user's visitor here: cells of more than one word, as their words' number and longest word's length
@register("T1_visit_cells", f"""WITH {NESTED} SELECT doc_id, table_id, CAST(r - 1 AS INTEGER) AS row, CAST(c - 1 AS INTEGER) AS cell,
  CAST(count(*) * 1000 + max(length(token)) AS BIGINT) AS value
FROM cells JOIN heads USING (doc_id, start) JOIN nested USING (doc_id, table_id) WHERE NOT tag AND c > 0 AND filled > 1 GROUP BY ALL HAVING count(*) > 1""")
def t1v(spark, d):
    def visit(tokens, row, cell):
        return len(tokens) * 1000 + max(map(len, tokens)) if len(tokens) > 1 else None

    return TB.visit_cells(_docs(spark, d), visit, "long", **NEST_TAGS)


@register("T1_extract_tables_lists", f"WITH {LISTS} SELECT doc_id, table_id, CAST(NULL AS BIGINT) AS parent_table_id, caption, n_rows FROM kept")
def t1l(spark, d):
    return list_tables(spark, d).select("doc_id", "table_id", "parent_table_id", "caption", F.size("rows").alias("n_rows"))


# chunks of the fold: rows go round the header's words, so a recursive walk numbers them
@register("T2_split_table_chunks", f"""
WITH RECURSIVE {LISTS},
walk(doc_id, table_id, k, head, words, chunk, next_words, next_chunk) AS (
  SELECT doc_id, table_id, k, words, words, CAST(0 AS BIGINT), words, CAST(0 AS BIGINT) FROM lines WHERE k = 1
  UNION ALL
  SELECT l.doc_id, l.table_id, l.k, w.head, l.words, w.next_chunk,
         CASE WHEN w.next_words + l.words >= 8 THEN w.head ELSE w.next_words + l.words END,
         w.next_chunk + CASE WHEN w.next_words + l.words >= 8 THEN 1 ELSE 0 END
  FROM walk w JOIN lines l ON l.doc_id = w.doc_id AND l.table_id = w.table_id AND l.k = w.k + 1)
SELECT l.doc_id, l.table_id, w.chunk, any_value(l.caption) || chr(10) || any_value(h.line) || chr(10) || string_agg(l.line, chr(10) ORDER BY l.k) AS text,
       count(*) + 1 AS n_rows
FROM walk w JOIN lines l USING (doc_id, table_id, k) JOIN lines h ON h.doc_id = l.doc_id AND h.table_id = l.table_id AND h.k = 1
WHERE w.k > 1 GROUP BY l.doc_id, l.table_id, w.chunk""")
def t2(spark, d):
    return TB.split_table_chunks(list_tables(spark, d), max_words=8)


# the answer rows are those that hold a word of the page's first link; here the third item, if there is one
@register("T3_linearize_table", f"""
WITH {LISTS},
ranked AS (SELECT *, CASE WHEN k = 1 THEN 0 WHEN item = 3 THEN 1 ELSE 2 END AS phase FROM lines),
totals AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY doc_id, table_id ORDER BY phase, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked)
SELECT doc_id, table_id, string_agg(line, chr(10) ORDER BY phase, k) AS text FROM totals
WHERE phase < 2 OR before < 3 GROUP BY doc_id, table_id""")
def t3(spark, d):
    return list_tables(spark, d).select("doc_id", "table_id", TB.linearize_table(F.col("rows"), F.array(F.lit(2)), 3).alias("text"))


@register("D11_answer_cells", f"""
WITH {LISTS},
answers AS (SELECT DISTINCT page_id AS doc_id, nfd_lower(a) AS answer FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS a FROM pages) WHERE a <> ''),
places AS (SELECT doc_id, table_id, item - 1 AS row, 0 AS col, line AS text FROM items JOIN kept USING (doc_id, table_id)
           UNION ALL SELECT doc_id, table_id, -1, -1, caption FROM kept)
SELECT DISTINCT doc_id, table_id, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col FROM places JOIN answers USING (doc_id)
WHERE contains(' ' || nfd_lower(text) || ' ', ' ' || answer || ' ')""".replace("nfd_lower(a)", "lower(nfc_normalize(a))").replace("nfd_lower(text)", "lower(nfc_normalize(text))"))
def d11(spark, d):
    ans = _docs(spark, d).select("doc_id", F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1).alias("answers"))
    return TB.answer_cells(list_tables(spark, d).join(ans, "doc_id"))


# a question is a page with its links as answers: its own tables are the gold page's, the first tables of the four pages
# after it its ranking
@register("D7_with_gold_tables", f"""
WITH {LISTS},
answers AS (SELECT DISTINCT page_id AS qid, lower(nfc_normalize(a)) AS answer FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS a FROM pages) WHERE a <> ''),
places AS (SELECT doc_id, table_id, item - 1 AS row, 0 AS col, line AS text FROM items JOIN kept USING (doc_id, table_id)
           UNION ALL SELECT doc_id, table_id, -1, -1, caption FROM kept),
hits AS (SELECT DISTINCT a.qid, p.doc_id, p.table_id, p.row, p.col FROM answers a JOIN places p ON p.doc_id BETWEEN a.qid AND a.qid + 4
         WHERE (p.doc_id = a.qid OR p.table_id = 0) AND contains(' ' || lower(nfc_normalize(p.text)) || ' ', ' ' || a.answer || ' ')),
found AS (SELECT qid, doc_id, table_id, string_agg(row || '.' || col, ' ' ORDER BY row, col) AS cells FROM hits GROUP BY ALL),
ranked AS (SELECT p.page_id AS qid, k.doc_id, k.table_id FROM pages p JOIN kept k ON k.doc_id BETWEEN p.page_id + 1 AND p.page_id + 4 AND k.table_id = 0),
pos AS (SELECT qid, string_agg(doc_id || '/' || table_id, ',' ORDER BY doc_id = qid, doc_id, table_id) AS positive_ids,
        string_agg(cells, ',' ORDER BY doc_id = qid, doc_id, table_id) AS answer_pos FROM found GROUP BY qid),
neg AS (SELECT qid, string_agg(doc_id || '/' || table_id, ',' ORDER BY doc_id) AS hard_negative_ids FROM ranked ANTI JOIN found USING (qid, doc_id, table_id) GROUP BY qid)
SELECT qid, coalesce(positive_ids, '') AS positive_ids, coalesce(answer_pos, '') AS answer_pos, coalesce(hard_negative_ids, '') AS hard_negative_ids
FROM pos FULL JOIN neg USING (qid)""")
def d7g(spark, d):
    from ..operators.weak import assemble_training_tables
    questions = _docs(spark, d).select(F.col("doc_id").alias("qid"), F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1).alias("answers"),
                                       F.explode(F.sequence(F.lit(0), F.lit(4))).alias("rank"))
    met = questions.withColumn("doc_id", F.col("qid") + F.col("rank")).join(list_tables(spark, d), "doc_id").filter("rank = 0 or table_id = 0")
    met = TB.answer_positions(met, keys=("qid", "doc_id", "table_id")).withColumn("pid", F.concat_ws("/", "doc_id", "table_id"))
    ranked, gold = met.filter("rank > 0").withColumnRenamed("rank", "pos"), met.filter("rank = 0").withColumnRenamed("table_id", "tpos")
    out = assemble_training_tables(ranked.filter("has_answer"), ranked.filter("not has_answer"), gold)
    cells = F.transform("answer_pos", lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(".", x["row"], x["col"])), " "))
    return out.select("qid", F.array_join("positive_ids", ",").alias("positive_ids"), F.array_join(cells, ",").alias("answer_pos"),
                      F.array_join("hard_negative_ids", ",").alias("hard_negative_ids"))


@register("A23_table_corpus_stats", f"""
WITH {LISTS}
SELECT CAST(0 AS BIGINT) AS with_issue, count(*) FILTER (WHERE table_id > 0) AS nested, count(*) FILTER (WHERE filled <= 1) AS single_row,
       count(*) FILTER (WHERE filled > 1) AS regular, CAST(coalesce(sum(n_rows) FILTER (WHERE filled > 1), 0) AS BIGINT) AS total_rows FROM every_table""")
def a23(spark, d):
    return TB.table_corpus_stats(_docs(spark, d), **LIST_TAGS)


@register("G5_distinct_tables_by_text", f"""
WITH {LISTS},
texts AS (SELECT doc_id, table_id, caption, string_agg(line, chr(1) ORDER BY item) AS text FROM items JOIN kept USING (doc_id, table_id) GROUP BY ALL)
SELECT doc_id, table_id FROM (SELECT doc_id, table_id, row_number() OVER (PARTITION BY caption, text ORDER BY doc_id, table_id) AS r FROM texts) WHERE r = 1""")
def g5t(spark, d):
    return TB.distinct_tables(list_tables(spark, d))
