"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets: sources in order of their name share all words by weight; a target stops at
   ``max_epochs`` times its source's size and the excess is shared anew by weight.
2. Quotas: each source's documents lie end to end in a seeded order and are cut into blocks of
   ``block_tokens`` words. The blocks to take are allocated to sources by the highest quotients
   ``target / (2 k + 1)``, then the words of each source's blocks to its shards in the same way, so that
   a block's words count in every shard they lie in.
3. Selection: in a shard the quota is taken in whole rounds plus an arc of words that starts at a
   seeded block. A document's share is the overlap of its words with the arc, so the number of
   blocks costs nothing.

Scale: documents are only read as ``(doc_id, source, size)``; sources are split into shards by a hash
of ``doc_id``, as many as leave about ``cell_rows`` of its own documents in each, so a
source with a third of all rows is ordered in many tasks. Only one row per source, or per source
and shard, is ever gathered.

Defined cases: null source is a source of its own, last in order; null text has size 0 and takes
nothing; null ``doc_id`` and repeated rows are documents like others; sources without words get
target 0; an empty table gives an empty result; no document is taken more than ``max_epochs`` times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, cut_lineage, text_of, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
CELL_ROWS = 2048
BLOCK_TOKENS = 8


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size)`` rows plus ``target``: shares by weight under the cap.

    The end of all resharing is ``min(cap, level * weight)`` for one water level. Sorted by
    ``cap / weight``, the capped sources come first; the level after capping the first ``j`` is
    ``(total - caps) / (weights left)``, and a source is capped while the level before it is above
    its ratio.
    """
    name = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    ranked = Window.orderBy("_ratio", "_at")
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    upto = ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("_at") - 1) % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("_at", F.row_number().over(name))
        .withColumn("_w", w).withColumn("_cap", F.col("source_size") * float(max_epochs))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                    / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
        .withColumn("_capped", F.min(F.col("_level") > F.col("_ratio")).over(upto))
        .withColumn("_first_free", F.first(F.when(~F.col("_capped"), F.col("_level")), ignorenulls=True).over(
            ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select("source", "_key", "source_size", "_at",
                F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_first_free") * F.col("_w")).alias("target"))
    )


def highest_quotients(parties: DataFrame, by: list[str], weight: str, seats: Column, order: str, out: str) -> DataFrame:
    """Sainte-Lague within each ``by`` group: ``out`` seats for each row of ``parties``.

    The seats that all quotients above a safe divisor give are counted directly; only the
    quotients near the last seat (about two for each row) are listed and ranked.
    """
    group = Window.partitionBy(*by)
    rows = parties.withColumn("_seats", seats.cast("double")).withColumn("_m", F.count("*").over(group))
    rows = rows.withColumn("_sum", F.sum(F.col(weight).cast("double")).over(group))
    share = F.col(weight) / F.col("_sum")
    some = F.col("_sum") > 0
    rows = rows.withColumn("_low", F.when(some, F.greatest(F.lit(0.0), F.floor(
        share * F.greatest(F.lit(0.0), F.col("_seats") - F.col("_m") / 2 - 1) + 0.5))).otherwise(0.0).cast("long"))
    rows = rows.withColumn("_high", F.when(some, F.floor(
        share * (F.col("_seats") + F.col("_m") / 2 + 1) + 0.5)).otherwise(0).cast("long"))
    rows = rows.withColumn("_left", F.col("_seats") - F.sum("_low").over(group))
    listed = (rows.where(F.col("_high") > F.col("_low"))
              .withColumn("_k", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)))
              .withColumn("_rank", F.row_number().over(
                  Window.partitionBy(*by).orderBy(F.desc(F.col(weight) / (2 * F.col("_k") + 1)), order))))
    won = listed.where(F.col("_rank") <= F.col("_left")).groupBy(*by, order).agg(F.count("*").alias("_won"))
    return (rows.join(won, [*by, order], "left")
            .withColumn(out, F.col("_low") + F.coalesce("_won", F.lit(0)))
            .drop("_seats", "_m", "_sum", "_low", "_high", "_left", "_won"))


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
        cell_rows: int = CELL_ROWS, block_tokens: int = BLOCK_TOKENS, seed: int = 17) -> DataFrame:
    """``sizes(doc_id, source, size, ...)`` plus ``source_size, target, taken`` and the arc's parts.

    ``taken = rounds * size + part``; ``part`` words are the document's words from ``part_from``
    (from 0) on, going on at its first word if it wraps (``part_from + part > size``).
    """
    b = F.lit(block_tokens)
    # one key that is never null, so that windows and joins on it share a single shuffle
    docs = (sizes.withColumn("_order", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))))
            .withColumn("_key", F.concat_ws(":", F.col("source").isNull().cast("string"), "source")))
    # only sources of several shards are listed: one row for every cell_rows documents at most
    several = cut_lineage(docs.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") >= cell_rows))
    docs = (docs.join(F.broadcast(several), "_key", "left")
            .withColumn("_shard", F.pmod(F.xxhash64("_order"), F.coalesce(F.floor(F.col("_n") / cell_rows) + 1, F.lit(1)))).drop("_n"))
    cells = cut_lineage(docs.groupBy("source", "_key", "_shard").agg(F.sum("size").alias("cell_size")))
    sources = cells.groupBy("source", "_key").agg(F.sum("cell_size").alias("source_size"))
    targets = cut_lineage(source_targets(sources, weights, max_epochs))  # small tables, each used more than once
    seats = F.round(F.sum("target").over(Window.partitionBy()) / b)
    quotas = cut_lineage(highest_quotients(targets.withColumn("_all", F.lit(0)), ["_all"], "target", seats, "_at", "quota").drop("_all"))
    cells = cells.join(quotas.drop("source"), "_key")
    cells = highest_quotients(cut_lineage(cells), ["_at"], "cell_size", F.col("quota") * b, "_shard", "cell_quota")
    cells = cells.withColumn("cell_quota", F.least("cell_quota", F.col("cell_size") * max_epochs))
    # rounds over the whole shard, then an arc of words from a seeded block
    some = F.col("cell_size") > 0
    cells = (cells.withColumn("rounds", F.when(some, F.floor(F.col("cell_quota") / F.col("cell_size"))).otherwise(0))
             .withColumn("_rest", F.col("cell_quota") - F.col("rounds") * F.col("cell_size"))
             .withColumn("_from", F.when(some, F.pmod(
                 F.xxhash64(F.lit(seed), "source", "_shard"), F.ceil(F.col("cell_size") / b))).otherwise(0)))
    cells = cells.select("_key", "_shard", "source_size", "target", "cell_size", "rounds", "_rest", "_from")
    order = Window.partitionBy("_key", "_shard").orderBy("_order", "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("_in", F.coalesce(F.sum("size").over(order), F.lit(0)))
    return _overlaps(docs.join(cells, ["_key", "_shard"]), b)


def _overlaps(rows: DataFrame, b: Column) -> DataFrame:
    """Words of each document that lie in the arc, on the shard's line of words."""
    size = F.col("cell_size")
    # the arc in words of the shard's line, which closes to a circle
    rows = rows.withColumn("_len", F.col("_rest").cast("long")).withColumn("_begin", (F.col("_from") * b).cast("long"))
    first, last = F.col("_in"), F.col("_in") + F.col("size")

    def cover(lo, hi):
        return F.greatest(F.lit(0), F.least(last, hi) - F.greatest(first, lo))

    tail = cover(F.col("_begin"), F.least(F.col("_begin") + F.col("_len"), size))
    head = cover(F.lit(0), F.col("_begin") + F.col("_len") - size)
    rows = rows.withColumn("_tail", tail).withColumn("_head", F.when(F.col("_begin") + F.col("_len") > size, head).otherwise(0))
    rows = (rows.withColumn("part", F.col("_tail") + F.col("_head"))
            .withColumn("part_from", F.when(F.col("_tail") > 0, F.greatest(F.col("_begin") - first, F.lit(0))).otherwise(0)))
    return (rows.withColumn("taken", (F.col("rounds") * F.col("size") + F.col("part")).cast("long"))
            .drop("_order", "_shard", "_in", "_key", "cell_size", "_rest", "_from", "_len", "_begin", "_tail", "_head"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, source, rounds, part, part_from``."""
    source = docs["source"] if "source" in docs.columns else F.lit(None).cast("string")
    sizes = cut_lineage(docs.select("doc_id", source.cast("string").alias("source"), word_count(text_of(docs)).alias("size")))
    return mix(sizes, **options).select("doc_id", "size", "source_size", "target", "taken", "source",
                                        F.col("rounds").cast("long").alias("rounds"), F.col("part").cast("long").alias("part"),
                                        F.col("part_from").cast("long").alias("part_from"))


def _cut(text: Column, size: Column, start: Column, length: Column) -> Column:
    """``length`` words of a text from word ``start`` on, with the white space before each; wraps to the first word."""
    words = F.split(text, rf"(?<={WORD_CLASS})(?={SPACE_CLASS})")
    tail = F.least(length, size - start)
    return F.concat(F.array_join(F.slice(words, (start + 1).cast("int"), tail.cast("int")), ""),
                    F.when((tail > 0) & (length > tail), "\n").otherwise(""), F.array_join(F.slice(words, F.lit(1), (length - tail).cast("int")), ""))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, whole or (at an arc's ends) in part.

    All columns are kept; ``n_chars``, if there, is set anew. The texts are shuffled once, to their
    source's shards.
    """
    source = docs["source"].cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("doc_id"),
                       source.alias("source"), word_count(text_of(docs)).alias("size"))
    taken = mix(rows, **options).where("taken > 0").select("row", "size", "rounds", "part", "part_from")
    whole = F.array_repeat(F.lit(True), F.col("rounds").cast("int"))
    copies = F.concat(whole, F.when(F.col("part") > 0, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")))
    out = taken.withColumn("whole", F.explode(copies))
    text = F.when(F.col("whole"), F.col("row.text")).otherwise(_cut(F.col("row.text"), F.col("size"), F.col("part_from"), F.col("part")))
    out = out.withColumn("cut", text)
    made = {"text": F.col("cut")} | ({"n_chars": F.char_length("cut").cast("long")} if "n_chars" in docs.columns else {})
    return out.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
