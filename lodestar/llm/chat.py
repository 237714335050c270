"""Chat formatting: typed content parts are flattened into one text per conversation, with a loss mask.

A message's content is a list of parts ``(kind, text, uri, units)``. A visitor turns each part into
text: a text part into itself, escaped; an image, audio or document part into an ordered placeholder
``<|image 0|>`` that names its entry in the conversation's list of attachments, which records its
kind, reference and the number of tokens it expands to. Parts of an unknown kind count as text.

Template: ``<|turn|>role<|says|>content<|end|>`` for each message. Control strings all begin with
``<|``; inside texts and roles a backslash is doubled and ``<|`` becomes ``<\\|``, so no text can
forge a control string and :func:`parse` gives every text back exactly.

The loss mask covers the content of the assistant's messages, not the markers round it.

DataFrame functions only. Escaping and placeholders are worked out row by row before the shuffle;
offsets come from a running sum over the same partitioning that gathers a conversation. A
conversation's formatted text is one value, so one conversation is gathered in one row (that is
the result asked for); nothing else is.

Defined cases: null text, role or uri is the empty text; a null ``conv_id`` is a conversation of its
own; messages with the same turn follow each other by role, then content; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Tokens that one unit of an attachment expands to: image tiles, seconds of audio, pages of a document.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def as_parts(messages: DataFrame) -> DataFrame:
    """A plain ``text`` column as a list with one text part."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                    F.lit(None).cast("string").alias("uri"), F.lit(None).cast("long").alias("units"))
    return messages.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("")).isin(*UNIT_TOKENS)


def _tokens(part: Column) -> Column:
    per = F.lit(0)
    for kind, n in UNIT_TOKENS.items():
        per = F.when(part["kind"] == kind, F.lit(n)).otherwise(per)
    return (per * F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(0))).cast("long")


def _visit(parts: Column, first: Column) -> Column:
    """The parts as escaped text, attachments numbered from ``first`` in their order."""
    flagged = F.transform(parts, lambda p: F.struct(p.alias("p"), _is_attachment(p).alias("a")))

    def text(x, i, given):
        number = first + F.size(F.filter(F.slice(given, F.lit(1), i), lambda y: y["a"]))
        return F.when(x["a"], F.concat(F.lit("<|"), x["p"]["kind"], F.lit(" "), number.cast("string"), F.lit("|>"))).otherwise(
            escape(F.coalesce(x["p"]["text"], F.lit(""))))

    return F.array_join(F.element_at(F.transform(F.array(flagged), lambda g: F.transform(g, lambda x, i: text(x, i, g))), 1), "")


def format_chat(messages: DataFrame) -> DataFrame:
    """One row per conversation from ``messages(conv_id, turn, role, parts)``.

    Returns ``conv_id, formatted, spans, attachments, expanded_tokens``: ``spans`` has for each message
    the start and length (code points) of its content in ``formatted`` and whether it bears loss;
    ``attachments`` has ``number, kind, uri, tokens`` in order.
    """
    rows = messages.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce("parts", F.array().cast(messages.schema["parts"].dataType)).alias("parts"))
    rows = rows.withColumn("_held", F.filter("parts", _is_attachment))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", F.xxhash64("parts"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = (rows.withColumn("_n", F.row_number().over(order))
            .withColumn("_number", F.coalesce(F.sum(F.size("_held")).over(before), F.lit(0))))
    rows = rows.withColumn("_head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS)))
    rows = rows.withColumn("_body", _visit(F.col("parts"), F.col("_number")))
    size = F.char_length("_head") + F.char_length("_body") + len(END)
    rows = rows.withColumn("_size", size.cast("long"))
    rows = rows.withColumn("_at", F.coalesce(F.sum("_size").over(before), F.lit(0)) + F.char_length("_head"))
    held = F.transform("_held", lambda p, i: F.struct(
        (F.col("_number") + i).cast("long").alias("number"), p["kind"].alias("kind"),
        F.coalesce(p["uri"], F.lit("")).alias("uri"), _tokens(p).alias("tokens")))
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("_n"), F.concat("_head", "_body", F.lit(END)).alias("piece"),
        F.struct(F.col("_at").cast("long").alias("start"), F.char_length("_body").cast("long").alias("length"),
                 (F.col("role") == "assistant").alias("loss")).alias("span"), held.alias("held")))).alias("m"))
    return gathered.select(
        "conv_id", F.array_join(F.transform("m", lambda x: x["piece"]), "").alias("formatted"),
        F.transform("m", lambda x: x["span"]).alias("spans"),
        F.flatten(F.transform("m", lambda x: x["held"])).alias("attachments"),
        F.aggregate(F.flatten(F.transform("m", lambda x: x["held"])), F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"))


def parse(formatted: Column) -> Column:
    """The messages of a formatted text: an array of ``(role, content)``, the content still escaped."""
    pieces = F.split(formatted, r"<\|end\|>")

    def message(piece):
        cut = F.split(F.substring(piece, len(TURN) + 1, 1 << 30), r"<\|says\|>")
        return F.struct(unescape(F.element_at(cut, 1)).alias("role"), F.element_at(cut, 2).alias("content"))

    return F.transform(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), message)


def digest_chat(formatted: DataFrame) -> DataFrame:
    """Digests of the messages and of the text under the loss mask, read back from ``formatted``."""
    rows = formatted.select("conv_id", "formatted", "spans", parse(F.col("formatted")).alias("p"))
    # the mask's spans are taken up in order with the messages; a span that does not fit its message counts as a fault
    rows = rows.withColumn("m", F.zip_with("p", "spans", lambda p, s: F.struct(
        p["role"].alias("role"), unescape(p["content"]).alias("text"), s["loss"].alias("loss"),
        (F.char_length(p["content"]) == s["length"]).alias("fits"))))
    masked = F.array_join(F.transform(F.filter("m", lambda x: x["loss"] & x["fits"]), lambda x: x["text"]), "")
    told = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return rows.withColumn("l", masked).select(
        "conv_id", F.size("m").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("l").cast("long").alias("loss_chars"), F.sha2("l", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
