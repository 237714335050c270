"""Column functions for text and token arrays (P*).

All are built-in Spark expressions (codegen'd, JVM-side) except ``nfd``, which has no Spark
built-in: it is an Arrow-batched ``pandas_udf`` that only touches non-ASCII values.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# ---- fixed values that must equal the reference's -------------------------------------------------
# Token pattern: a run of letters/digits/marks, or any single character that is not a separator
# or control/other character.
TOKEN_PATTERN = r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]"
# Articles removed by answer normalisation.
ARTICLES_PATTERN = r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])"
# Document and query markers.
CLS, SEP, MASK, Q_MARKER, D_MARKER = "[CLS]", "[SEP]", "[MASK]", "[Q]", "[D]"
# ASCII punctuation (Python's string.punctuation).
PUNCTUATION = string.punctuation
# ------------------------------------------------------------------------------------------------


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_control(c: str | Column) -> Column:
    """CR, LF and TAB each become one space; null stays null."""
    return F.translate(_c(c), "\r\n\t", "   ")


def metadata_document(*fields: str | Column) -> Column:
    """``"[CLS] " + " [SEP] ".join(non-null fields) + " [SEP]"``; fields are P1-cleaned."""
    return F.concat(F.lit(CLS + " "), F.concat_ws(" " + SEP + " ", *[strip_control(f) for f in fields]),
                    F.lit(" " + SEP))


def tokenize(c: str | Column, lower: bool = False) -> Column:
    """tokens = letter/digit/mark runs, or single non-space non-control characters."""
    toks = F.regexp_extract_all(_c(c), F.lit(TOKEN_PATTERN), 0)
    return F.transform(toks, lambda t: F.lower(t)) if lower else toks


def truncate_tokens(tokens: Column, n: int) -> Column:
    """The first ``n`` tokens joined by one space."""
    return F.array_join(F.slice(tokens, 1, n), " ")


def normalize_question(c: str | Column, suffix: str | None = None) -> Column:
    """P5: right single quote to apostrophe; optional suffix appended when absent."""
    q = F.regexp_replace(_c(c), "’", "'")
    if suffix:
        q = F.when(q.endswith(suffix), q).otherwise(F.concat(q, F.lit(suffix)))
    return q


def normalize_passage(c: str | Column) -> Column:
    """Newline to space, right quote to apostrophe, drop one leading and one trailing ``"``."""
    t = F.regexp_replace(F.regexp_replace(_c(c), "\n", " "), "’", "'")
    t = F.regexp_replace(t, '^"', "")
    return F.regexp_replace(t, '"$', "")


def prefix_query_token(q: str | Column, token: str) -> Column:
    """``token + ' ' + query``."""
    return F.concat_ws(" ", F.lit(token), _c(q))


def prefix_id(c: str | Column, prefix: str) -> Column:
    """Add ``prefix`` unless the id already starts with it (idempotent)."""
    s = _c(c).cast("string")
    return F.when(s.startswith(prefix), s).otherwise(F.concat(F.lit(prefix), s))


@F.pandas_udf(StringType())
def _nfd_udf(s: pd.Series) -> pd.Series:
    def one(x):
        if x is None or x.isascii():
            return x
        return unicodedata.normalize("NFD", x)
    return s.map(one)


@F.pandas_udf(ArrayType(StringType()))
def _nfd_array_udf(s: pd.Series) -> pd.Series:
    def one(arr):
        if arr is None:
            return None
        return [x if x is None or x.isascii() else unicodedata.normalize("NFD", x) for x in arr]
    return s.map(one)


def nfd_array(c: str | Column) -> Column:
    """P9 over an array of strings (Python UDFs cannot sit inside higher-order lambdas)."""
    return _nfd_array_udf(_c(c))


def nfd(c: str | Column) -> Column:
    """Unicode NFD (no Spark built-in). The Arrow UDF is given a null in place of an ASCII text, so
    only other texts cross to Python."""
    col = _c(c)
    plain = col.rlike("^[\\x00-\\x7F]*$")
    return F.when(plain, col).otherwise(_nfd_udf(F.when(~plain, col)))


def normalize_answer(c: str | Column) -> Column:
    """P10: lower, drop ASCII punctuation, articles to a space, collapse blanks (in this order)."""
    t = F.lower(_c(c))
    t = F.translate(t, PUNCTUATION, "")
    t = F.regexp_replace(t, ARTICLES_PATTERN, " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def exact_match(pred: str | Column, gold: str | Column) -> Column:
    """Equality after ``normalize_answer``."""
    return normalize_answer(pred) == normalize_answer(gold)


_SPAN_TYPE = ArrayType(StructType([StructField("token", StringType()), StructField("start", IntegerType()),
                                   StructField("end", IntegerType()), StructField("ws", StringType())]))


SPAN_CHARS = 1 << 18    # characters whose spans are held at once


@F.pandas_udf(_SPAN_TYPE)
def _token_spans_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Each text is cut into pieces (a token and the gap behind it); offsets are running sums of lengths. A token's span takes
    many times its text, so a batch of texts goes out in parts of about ``SPAN_CHARS`` characters."""
    import numpy as np
    import regex
    piece = regex.compile(f"({TOKEN_PATTERN})([\\p{{Z}}\\p{{C}}]*)")      # whatever else there is begins a token

    def one(text):
        if text is None:
            return None
        pieces = piece.findall(text)
        if not pieces:
            return []
        at = len(text) - sum([len(t) + len(gap) for t, gap in pieces])   # the text may begin with a gap
        pieces[-1] = (pieces[-1][0], "")                                 # no blank behind the last token
        spans = []
        for t, gap in pieces:
            end = at + len(t)
            spans.append({"token": t, "start": at, "end": end, "ws": t + gap})
            at = end + len(gap)
        return spans

    for s in batches:
        part = np.cumsum([0 if t is None else len(t) for t in s]) // SPAN_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(s)]
        for a, b in zip(cuts, cuts[1:]):
            yield s.iloc[a:b].map(one)


def token_spans(text: str | Column) -> Column:
    """``array<struct<token, start, end, ws>>``: tokens with 0-based character offsets (end
    exclusive) and the token text followed by its trailing whitespace (``ws``). Arrow-batched: running
    offsets have no linear built-in form."""
    return _token_spans_udf(_c(text))


def untokenize(spans: Column, start: int = 0, end: int | None = None) -> Column:
    """Text-with-space of tokens ``start..end-1`` joined back, trailing space trimmed."""
    part = F.slice(spans, start + 1, (end if end is not None else 1 << 30) - start)
    return F.trim(F.array_join(F.transform(part, lambda t: t["ws"]), ""))


def ngrams(tokens: Column, n: int, keep=None) -> Column:
    """All n-grams of length 1..n ordered by start then length, joined by spaces.
    ``keep`` is an optional ``Column -> Column`` predicate on the n-gram's token array."""
    size = F.size(tokens)

    def grams_at(s):
        lens = F.sequence(F.lit(1), F.least(F.lit(n), size - s))
        return F.transform(lens, lambda ln: F.slice(tokens, s + 1, ln))

    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    arrays = F.flatten(F.transform(starts, grams_at))
    if keep is not None:
        arrays = F.filter(arrays, keep)
    return F.transform(arrays, lambda a: F.array_join(a, " "))


def query_template(tokens: Column, maxlen: int) -> Column:
    """``[CLS] [Q] tokens [SEP]`` padded with ``[MASK]`` to ``maxlen`` (tokens cut to fit)."""
    body = F.concat(F.array(F.lit(CLS), F.lit(Q_MARKER)), F.slice(tokens, 1, maxlen - 3), F.array(F.lit(SEP)))
    return F.concat(body, F.array_repeat(F.lit(MASK), F.greatest(F.lit(maxlen) - F.size(body), F.lit(0))))


def query_context_append(q_ids: Column, ctx_ids: Column, maxlen: int, total: int = 512) -> Column:
    """Query ids followed by the context ids without their first token, cut to
    ``total - maxlen + 1`` context ids."""
    return F.concat(q_ids, F.slice(ctx_ids, 2, total - maxlen + 1))


def doc_template(tokens: Column, maxlen: int) -> Column:
    """``[CLS] [D] tokens [SEP]`` with tokens cut so the whole is at most ``maxlen``."""
    return F.concat(F.array(F.lit(CLS), F.lit(D_MARKER)), F.slice(tokens, 1, maxlen - 3), F.array(F.lit(SEP)))


def mask_tokens(tokens: Column, skiplist: list[str], pad: str = MASK) -> Column:
    """Drop pad and skiplist (punctuation) tokens; ``size`` of the result is the doclen."""
    skip = F.array(*[F.lit(s) for s in [*skiplist, pad]])
    return F.filter(tokens, lambda t: ~F.array_contains(skip, t))


def pad_or_cut(ids: Column, maxlen: int, pad, sep) -> Column:
    """Pad right to ``maxlen``; when at least full, cut and set the last id to ``sep``."""
    n = F.size(ids)
    padded = F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(F.lit(maxlen) - n, F.lit(0))))
    cut = F.concat(F.slice(ids, 1, maxlen - 1), F.array(F.lit(sep)))
    return F.when(n < maxlen, padded).otherwise(cut)


def segment_ids(ids: Column, sep) -> Column:
    """P20: 0 up to and including the first ``sep``, 1 after (no sep: all 0). Linear: two repeats."""
    first = F.array_position(ids, F.lit(sep))
    n0 = F.when(first > 0, first).otherwise(F.size(ids)).cast("int")
    return F.concat(F.array_repeat(F.lit(0), n0), F.array_repeat(F.lit(1), (F.size(ids) - n0).cast("int")))


def pair_concat(q_ids: Column, p_ids: Column, spans: Column | None = None) -> Column:
    """``struct(ids, offset[, spans])``: the pair's ids, where the passage starts, and the passage's spans
    (``array<struct<start, end>>``) moved by that offset."""
    fields = [F.concat(q_ids, p_ids).alias("ids"), F.size(q_ids).alias("offset")]
    if spans is not None:
        # one variable for both arrays, so that neither is worked out again for each span
        both = F.array(F.struct(F.size(q_ids).alias("n"), spans.alias("s")))
        moved = F.transform(both, lambda x: F.transform(x["s"], lambda v: F.struct(
            (v["start"] + x["n"]).alias("start"), (v["end"] + x["n"]).alias("end"))))
        fields.append(F.element_at(moved, 1).alias("spans"))
    return F.struct(*fields)


def window_around_token(ids: Column, tok, maxlen: int) -> Column:
    """Cut to ``maxlen``; when the marker falls outside the first ``maxlen`` ids, move the
    window to end right after the marker (the random shift of the reference is fixed to 0)."""
    pos = F.array_position(ids, F.lit(tok))
    start = F.when(pos > maxlen, pos - maxlen + 1).otherwise(1)
    return F.slice(ids, start, maxlen)


def marker_position(ids: Column, tok) -> Column:
    """0-based position of ``tok``, else 0."""
    return F.greatest(F.array_position(ids, F.lit(tok)) - 1, F.lit(0)).cast("long")


def dedupe_keep_order(arr: Column) -> Column:
    """P25: distinct elements, first occurrence order."""
    return F.array_distinct(arr)


def linearize_row(cells: Column) -> Column:
    """Cells joined by ``', '``."""
    return F.array_join(cells, ", ")


def row_word_count(cells: Column) -> Column:
    """Words of a row = sum of single-space split sizes of its cells."""
    return F.aggregate(cells, F.lit(0), lambda acc, c: acc + F.size(F.split(c, " ")))


def table_text_for_match(rows: Column, caption: Column | None = None) -> Column:
    """Each row's cells joined by ``' . '``, rows concatenated with no separator, one
    ``' . '`` at the end; with ``caption`` the caption comes first (second form)."""
    body = F.concat(F.array_join(F.transform(rows, lambda r: F.array_join(r, " . ")), ""), F.lit(" . "))
    return body if caption is None else F.concat(caption, F.lit(" . "), body)


def mask_target_padding(ids: Column, end_id) -> Column:
    """Label ids after the first ``end_id`` become -100 (linear: slice + repeat)."""
    pos = F.array_position(ids, F.lit(end_id))
    keep = F.when(pos > 0, pos).otherwise(F.size(ids)).cast("int")
    return F.concat(F.slice(ids, 1, keep), F.array_repeat(F.lit(-100), (F.size(ids) - keep).cast("int")))


def ragged_pad(arr: Column, maxlen: Column, pad) -> Column:
    """Pad an array to ``maxlen`` (the group's longest); the mask is ``mask_of``."""
    return F.concat(arr, F.array_repeat(F.lit(pad), (maxlen - F.size(arr)).cast("int")))


def mask_of(arr: Column, maxlen: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(1), F.size(arr)),
                    F.array_repeat(F.lit(0), (maxlen - F.size(arr)).cast("int")))


def subword_merge_span(tokens: Column, start: Column, end: Column) -> Column:
    """Move a span's start left and its end right over ``##`` continuation pieces
    (0-based inclusive positions); returns ``struct(start, end)``."""
    n = F.size(tokens)
    is_cont = F.transform(tokens, lambda t: t.startswith("##"))
    # start: walk left while the token at start is a continuation piece
    new_start = F.aggregate(F.sequence(F.lit(0), F.greatest(start, F.lit(0))), start,
                            lambda s, _: F.when((s > 0) & F.element_at(is_cont, s + 1), s - 1).otherwise(s))
    # end: walk right while the next token is a continuation piece
    new_end = F.aggregate(F.sequence(F.lit(0), F.greatest(n - end, F.lit(0))), end,
                          lambda e, _: F.when((e + 1 < n) & F.coalesce(F.element_at(is_cont, e + 2), F.lit(False)),
                                              e + 1).otherwise(e))
    return F.struct(new_start.alias("start"), new_end.alias("end"))
