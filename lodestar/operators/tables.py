"""Tables from token/markup streams (T1-T3, D11, A23, G5 for tables).

A document's stream is read once, in its own row, with a stack of open tables: no row per token, no
shuffle, and work linear in the tokens (a nested table copies its parent's caption so far, which is
its output). Only documents that open a table leave the JVM. Nested tables are flattened with
``parent_table_id`` (Spark has no recursive types). Chunks, lines, answers and statistics are
DataFrame functions over the tables.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import nfd, nfd_array

# fixed value that must equal the reference's
ISSUES_BANNER = "( hide ) This section has multiple issues"


def markup_tokens(html: F.Column) -> F.Column:
    """Tags and words of an HTML string as one token stream (tags keep their ``<...>``)."""
    return F.regexp_extract_all(html, F.lit(r"<[^>]+>|[^<\s]+"), 0)


def has_issues(tokens: str | Column, banner: str = ISSUES_BANNER) -> Column:
    """Does the whole document hold the banner of pages with issues?"""
    return F.coalesce(F.array_join(tokens, " ").contains(banner), F.lit(False))


#: What a tag opens, as bits (one tag may open a row and its first cell).
_TABLE, _ROW, _CELL = 1, 2, 4
#: Tokens after which the tables found so far are sent on.
_FLUSH_TOKENS = 1 << 18
_MARKUP = re.compile(r"<[^>]+>")
_NAME = re.compile(r"<\s*(/?)\s*([^\s/>]+)")


class _Table:
    """A table while its stream is read: ``lead`` is what its caption starts with, ``said`` its own words outside
    cells, ``rows`` the words of each cell of each row."""

    __slots__ = ("number", "parent", "lead", "said", "rows")

    def __init__(self, number: int, parent: int | None, lead: str):
        self.number, self.parent, self.lead = number, parent, lead
        self.said: list[str] = []
        self.rows: list[list[list[str]]] = []

    def cell(self) -> list[str] | None:
        return self.rows[-1][-1] if self.rows and self.rows[-1] else None

    def caption(self) -> str:
        return self.lead + (" " + " ".join(self.said) if self.said else "")

    def filled_rows(self) -> int:
        return sum(any(w != "" for cell in row for w in cell) for row in self.rows)


def _tables_of(tokens: Iterable[str | None], marks: Iterable[bool | None] | None, title: str, roles: dict[str, int]) -> list[_Table]:
    """Tables of one token stream in the order of their starts: one pass with a stack of the open ones."""
    found: list[_Table] = []
    stack: list[_Table] = []
    for token, mark in zip(tokens, itertools.repeat(None) if marks is None else marks):
        if token is None:
            continue
        if not (_MARKUP.fullmatch(token) if marks is None else mark):
            if stack:
                into = stack[-1].cell()
                (stack[-1].said if into is None else into).append(token)
            continue
        tag = _NAME.match(token)
        role = roles.get(tag[2].lower(), 0) if tag else 0
        if role and tag[1]:
            if role & _TABLE and stack:
                stack.pop()
        elif role:
            if role & _TABLE:
                outer, lead = (stack[-1], stack[-1].caption()) if stack else (None, title)
                if outer is not None and outer.cell() is not None:
                    lead += " | " + " ".join(outer.cell())
                stack.append(_Table(len(found), outer.number if outer else None, lead))
                found.append(stack[-1])
            if stack and role & _ROW:
                stack[-1].rows.append([])
            if stack and role & _CELL and stack[-1].rows:
                stack[-1].rows[-1].append([])
    return found


def _map_tables(docs: DataFrame, emit: Callable[[int | None, list[_Table]], Iterable[tuple]], schema: StructType, id_col: str, tokens: str,
                title: str, table_tags, row_tags, cell_tags, issue_banner: str | None, html_mask: str | None) -> DataFrame:
    """The rows that ``emit(doc_id, tables)`` gives for each document. Documents with the banner, and those
    that open no table, never leave the JVM."""
    if issue_banner:
        docs = docs.filter(~has_issues(tokens, issue_banner))
    opens = r"(?i)^<\s*(" + "|".join(re.escape(t) for t in table_tags) + r")([\s/>]|$)"
    docs = docs.filter(F.exists(tokens, lambda x: x.rlike(opens)))
    roles: dict[str, int] = {}
    for role, tags in ((_TABLE, table_tags), (_ROW, row_tags), (_CELL, cell_tags)):
        for t in tags:
            roles[t.lower()] = roles.get(t.lower(), 0) | role
    arrow = to_arrow_schema(schema)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seen = [], 0
            for i in range(batch.num_rows):
                words = batch.column("tokens")[i].as_py()
                marks = batch.column("marks")[i].as_py() if html_mask else None
                if html_mask and len(marks or ()) < len(words):
                    marks = (marks or []) + [None] * (len(words) - len(marks or ()))
                rows.extend(emit(batch.column("doc_id")[i].as_py(), _tables_of(words, marks, batch.column("title")[i].as_py(), roles)))
                seen += len(words)
                if seen > _FLUSH_TOKENS:
                    yield packed(rows)
                    rows, seen = [], 0
            if rows:
                yield packed(rows)

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(tokens).cast("array<string>").alias("tokens"),
                       F.coalesce(F.col(title), F.lit("")).alias("title"),
                       *([F.col(html_mask).cast("array<boolean>").alias("marks")] if html_mask else []))
    return thin.mapInArrow(run, schema)


def extract_tables(docs: DataFrame, id_col: str = "doc_id", tokens: str = "tokens", title: str = "title",
                   table_tags=("table",), row_tags=("tr",), cell_tags=("td", "th"), issue_banner: str | None = ISSUES_BANNER,
                   html_mask: str | None = None, keep_small: bool = False) -> DataFrame:
    """T1 over many documents ``(id, tokens, title)``: one row per table ``doc_id, table_id, parent_table_id,
    caption, rows, nested, filled_rows``.

    * ``html_mask`` names a column that says which tokens are markup; without it, ``<...>`` tokens are.
    * text in a row belongs to its last cell, also after the cell's or row's end; text before belongs to
      the caption, which starts with the title, or for a nested table with the parent's caption so
      far, ``" | "`` and the parent's current cell so far.
    * documents with the issues banner are dropped; tables with at most one row that holds a token are
      dropped unless ``keep_small``.
    * null tokens are skipped, null or empty streams hold no table, rows that repeat an id give tables each."""
    def emit(doc_id, found):
        for t in found:
            filled = t.filled_rows()
            if keep_small or filled > 1:
                rows = [[" ".join(cell) for cell in row] for row in t.rows]
                yield doc_id, t.number, t.parent, t.caption().strip(" "), rows, t.parent is not None, filled

    schema = StructType.fromDDL("doc_id long, table_id long, parent_table_id long, caption string, rows array<array<string>>, "
                                "nested boolean, filled_rows int")
    return _map_tables(docs, emit, schema, id_col, tokens, title, table_tags, row_tags, cell_tags, issue_banner, html_mask)


def visit_cells(docs: DataFrame, visit: Callable[[list[str], int, int], object], returns: str = "string", captions: bool = False,
                id_col: str = "doc_id", tokens: str = "tokens", title: str = "title", table_tags=("table",), row_tags=("tr",),
                cell_tags=("td", "th"), issue_banner: str | None = ISSUES_BANNER, html_mask: str | None = None,
                keep_small: bool = False) -> DataFrame:
    """A user's visitor over the cells of all tables: ``visit(tokens, row, cell)`` is called once for each cell, and with
    ``captions`` first for each caption's tokens as ``(tokens, -1, -1)``. Where it gives something other than ``None`` there
    is a row ``doc_id, table_id, row, cell, value`` (``returns``: the value's Spark type)."""
    def emit(doc_id, found):
        for t in found:
            if not keep_small and t.filled_rows() <= 1:
                continue
            title_words = [(-1, -1, t.caption().split())] if captions else []
            for r, c, words in itertools.chain(title_words, ((r, c, cell) for r, row in enumerate(t.rows) for c, cell in enumerate(row))):
                value = visit(words, r, c)
                if value is not None:
                    yield doc_id, t.number, r, c, value

    schema = StructType.fromDDL(f"doc_id long, table_id long, row int, cell int, value {returns}")
    return _map_tables(docs, emit, schema, id_col, tokens, title, table_tags, row_tags, cell_tags, issue_banner, html_mask)


def row_text(cells: Column) -> Column:
    """The cells of a row joined by a comma and a blank."""
    return F.array_join(cells, ", ")


def row_words(cells: Column) -> Column:
    """Words of a row: the blank-separated parts of its cells."""
    return F.aggregate(cells, F.lit(0), lambda n, c: n + F.size(F.split(c, " ")))


def _filled_lines(rows: Column) -> Column:
    """``(place, line, words)`` of the rows whose text has more than one character."""
    lines = F.transform(rows, lambda r, i: F.struct(i.alias("place"), row_text(r).alias("line"), row_words(r).alias("words")))
    return F.filter(lines, lambda x: F.length(x["line"]) > 1)


def split_table_chunks(tables: DataFrame, max_words: int = 100) -> DataFrame:
    """The first filled row is the header of every chunk; rows follow until the chunk's words reach
    ``max_words``; a tail with more than the header is a chunk too. ``text`` is the caption and the chunk's lines.

    A fold over a table's rows numbers the chunks; lines of one chunk meet in an aggregate."""
    t = tables.withColumn("_lines", _filled_lines(F.col("rows"))).filter(F.size("_lines") > 1)
    t = t.withColumn("_head", F.element_at("_lines", 1))
    start = F.struct(F.lit(0).alias("chunk"), F.col("_head.words").alias("words"), F.array().cast("array<int>").alias("ids"))

    def add(state, x):
        words = state["words"] + x["words"]
        ids = F.concat(state["ids"], F.array(state["chunk"]))
        full = words >= max_words
        return F.struct((state["chunk"] + full.cast("int")).alias("chunk"),
                        F.when(full, F.col("_head.words")).otherwise(words).alias("words"), ids.alias("ids"))

    t = t.withColumn("_ids", F.aggregate(F.slice("_lines", F.lit(2), F.size("_lines") - 1), start, add)["ids"])
    body = t.select("doc_id", "table_id", "caption", F.col("_head.line").alias("_header"), F.explode(F.arrays_zip(
        F.slice("_lines", F.lit(2), F.size("_lines") - 1).alias("x"), F.col("_ids").alias("chunk"))).alias("e"))
    chunks = body.groupBy("doc_id", "table_id", F.col("e.chunk").cast("long").alias("chunk")).agg(
        F.first("caption").alias("caption"), F.first("_header").alias("_header"),
        F.array_sort(F.collect_list(F.struct(F.col("e.x.place").alias("place"), F.col("e.x.line").alias("line")))).alias("_body"))
    lines = F.concat(F.array(F.coalesce("caption", F.lit("")), F.col("_header")), F.transform("_body", lambda x: x["line"]))
    return chunks.select("doc_id", "table_id", "chunk", F.array_join(lines, "\n").alias("text"),
                         (F.size("_body") + 1).cast("long").alias("n_rows"))


def linearize_table(rows: Column, answer_rows: Column, max_words: int) -> Column:
    """The first filled row, then the rows that hold answers (``answer_rows``: their places from 0, in
    order), then the other filled rows. A phase goes on until the words reach ``max_words``; the row that
    reaches it is kept. The first answer row is always kept."""
    lines = F.transform(rows, lambda r, i: F.struct(i.alias("place"), row_text(r).alias("line"), row_words(r).alias("words")))
    filled = F.filter(lines, lambda x: F.length(x["line"]) > 1)
    head = F.get(filled, F.lit(0))
    wanted = F.array_distinct(F.coalesce(answer_rows, F.array().cast("array<int>")))
    answers = F.filter(F.transform(wanted, lambda p: F.get(lines, p)), lambda x: x.isNotNull() & ((x["place"] != head["place"]) | head.isNull()))
    others = F.filter(filled, lambda x: (x["place"] != head["place"]) & ~F.array_contains(wanted, x["place"]))
    start = F.struct(F.coalesce(head["line"], F.lit("")).alias("text"), F.coalesce(head["words"], F.lit(0)).alias("words"), F.lit(False).alias("any"))

    def add(first_always):
        def step(s, x):
            more = (s["words"] < max_words) | (~s["any"] if first_always else F.lit(False))
            glue = F.when(s["text"] == "", "").otherwise("\n")
            return F.struct(F.when(more, F.concat(s["text"], glue, x["line"])).otherwise(s["text"]).alias("text"),
                            (s["words"] + F.when(more, x["words"]).otherwise(0)).alias("words"), F.lit(True).alias("any"))
        return step

    return F.aggregate(others, F.aggregate(answers, start, add(True)), add(False))["text"]


def answer_cells(tables: DataFrame, answers: str = "answers", keys: tuple[str, ...] = ("doc_id", "table_id")) -> DataFrame:
    """``(doc_id, table_id, row, col)`` of the cells in which an answer's blank-separated tokens stand one
    after another, both NFD and lower-cased; the caption is ``(-1, -1)``. Empty answers match nothing.
    ``keys`` are the columns that tell rows apart, such as a question's id where tables meet several questions."""
    def padded(text):
        return F.concat(F.lit(" "), F.lower(text), F.lit(" "))

    wanted = F.transform(F.filter(nfd_array(F.col(answers)), lambda a: a != ""), padded)
    t = tables.select(*keys, "caption", "rows", wanted.alias("_want"))
    places = F.flatten(F.transform("rows", lambda r, i: F.transform(r, lambda c, j: F.struct(
        i.cast("int").alias("row"), j.cast("int").alias("col"), c.alias("text")))))
    title = F.array(F.struct(F.lit(-1).alias("row"), F.lit(-1).alias("col"), F.coalesce("caption", F.lit("")).alias("text")))
    cells = t.select(*keys, "_want", F.explode(F.concat(title, places)).alias("c"))
    cells = cells.select(*keys, F.col("c.row").alias("row"), F.col("c.col").alias("col"), "_want", padded(nfd(F.col("c.text"))).alias("_text"))
    return cells.filter(F.exists("_want", lambda w: F.col("_text").contains(w))).select(*keys, "row", "col")


def answer_positions(tables: DataFrame, answers: str = "answers", keys: tuple[str, ...] = ("doc_id", "table_id")) -> DataFrame:
    """``tables`` with ``answer_pos`` (the cells of :func:`answer_cells` in order) and ``has_answer``; ``keys`` are unique."""
    found = answer_cells(tables, answers, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row", "col"))).alias("answer_pos"))
    none = F.array().cast("array<struct<row:int,col:int>>")
    return (tables.join(found, list(keys), "left").withColumn("has_answer", F.col("answer_pos").isNotNull())
            .withColumn("answer_pos", F.coalesce("answer_pos", none)))


def table_corpus_stats(docs: DataFrame, **options) -> DataFrame:
    """A23 over documents, before any table is dropped: documents with issues, tables that are not their
    document's first, tables with at most one filled row, the other ones, and the rows of these."""
    issues = docs.agg(F.coalesce(F.sum(has_issues(options.get("tokens", "tokens")).cast("long")), F.lit(0)).alias("with_issue"))
    tables = extract_tables(docs, keep_small=True, **options)
    regular = F.col("filled_rows") > 1

    def count(cond):
        return F.coalesce(F.sum(cond.cast("long")), F.lit(0))

    stats = tables.agg(count(F.col("table_id") > 0).alias("nested"), count(~regular).alias("single_row"), count(regular).alias("regular"),
                       F.coalesce(F.sum(F.when(regular, F.size("rows"))), F.lit(0)).cast("long").alias("total_rows"))
    return issues.crossJoin(stats)  # one row each


def distinct_tables(tables: DataFrame) -> DataFrame:
    """G5 on tables: the first table (by document, then place) of each caption and text."""
    key = F.md5(F.to_json(F.struct("caption", "rows")))
    return tables.withColumn("_key", key).groupBy("_key").agg(F.min(F.struct("doc_id", "table_id")).alias("f")).select("f.doc_id", "f.table_id")
