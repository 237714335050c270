"""Document fingerprints by SpotSigs: chains of content words that follow common-word anchors.

A spot signature is an anchor (a very common word) with the next two content words after it, of the
six words that follow. One more signature starts at the head of the text, so every text with a word has one.
A document's fingerprint is its set of signatures, 32-bit hashes in ascending order, written as
eight hex digits each. The likeness of two fingerprints is the Jaccard measure of the sets.

:func:`similar_pairs` joins a table with itself: sets are partitioned by length into bands as wide as
the threshold allows, so partners lie in the same or the next band, and inside a band only the
rarest signatures of each set are looked up (a pair above the threshold shares one of them), sizes
are compared next, and the full Jaccard measure is taken last. Equal sets are one row there.

:func:`with_next` gives every row its successor by ``doc_id`` without a global sort in one task:
bounds of ranges are taken once, a row's range is a pure function of its id, and the first row
of each range is also sent to the range before it.

DataFrame functions only. Defined cases: null texts are empty; a text without words has the empty
fingerprint, like only other empty ones (likeness 1); null ``doc_id`` comes first; rows with equal
``doc_id`` follow each other by text; an only row is its own successor; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bind, cut_lineage, shuffle_partitions, text_of

#: Anchors, the commonest words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in that is was it for on with as are by a this from be at or an have not which you "
    "der die das und von mit den ist zu im ein eine für auf nicht sich dem des als auch "
    "le la les de et un une que qui est dans pour du en pas au avec sur "
    "el los las y del se por con una su para es no al lo").split()
REACH = 6
_BLOCK = 64


def signatures(text: Column) -> Column:
    """Sorted array of the distinct signatures of a text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def chains(w):
        content = F.transform(w, lambda x: F.when(~x.isin(ANCHORS), F.xxhash64(x)))

        def from_content(c):
            at = F.filter(F.transform(c, lambda x, i: F.when(x.isNull(), i)), lambda i: i.isNotNull())
            spots = F.concat(F.array(F.lit(-1)), at)

            def chain(i):
                def sign(found):
                    return F.xxhash64(F.coalesce(F.get(w, i), F.lit("")), F.get(found, F.lit(0)), F.get(found, F.lit(1))).bitwiseAND(F.lit(0xFFFFFFFF))
                return bind(F.filter(F.slice(c, i + 2, F.lit(REACH)), lambda x: x.isNotNull()), sign)

            return F.transform(spots, chain)

        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(
            F.sort_array(F.array_distinct(bind(content, from_content))))

    return bind(words, chains)


def fingerprint(sigs: Column) -> Column:
    digits = F.transform(sigs, lambda x: F.substring(F.hex(x.bitwiseOR(F.lit(1 << 32))), 2, 8))
    return F.lower(F.array_join(digits, ""))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard measure of two signature sets; two empty sets are alike."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / every)


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds not above the key: coarse bounds first, then one block of fine ones."""
    if not bounds:
        return F.lit(0)
    every, coarse = F.lit(bounds), F.lit(bounds[_BLOCK - 1::_BLOCK]) if len(bounds) >= _BLOCK else None
    block = F.size(F.filter(coarse, lambda x: x <= key)) if coarse is not None else F.lit(0)
    return block * _BLOCK + F.size(F.filter(F.slice(every, block * _BLOCK + 1, F.lit(_BLOCK)), lambda x: x <= key))


def with_next(rows: DataFrame, key: str, more: list[str], also: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """``rows`` with ``also`` columns, plus ``next``: a struct of the ``more`` and ``also`` columns of the row that follows.

    Order is by ``key`` (long, not null), then ``more``. The ``also`` columns are worked out after the
    shuffle, once for each row, so they are not shuffled.
    """
    n = ranges or 4 * shuffle_partitions(rows.sparkSession)
    found = rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n).alias("b")).first()["b"] or []
    rows = rows.withColumn("_range", _range_of(F.col(key), sorted(set(found))))
    least = rows.groupBy("_range").agg(F.min(key).alias("_least"))  # a row for each range
    heads = (rows.withColumnRenamed("_range", "_own").join(F.broadcast(least.withColumnRenamed("_range", "_own")), "_own")
             .where(F.col(key) == F.col("_least")).groupBy("_own", key).agg(F.min(F.struct(*more)).alias("_head")))
    line = Window.orderBy("_own")
    heads = heads.select(
        F.col("_own").alias("_range"),
        F.coalesce(F.lead(F.struct(key, "_head")).over(line), F.first(F.struct(key, "_head")).over(
            line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_next"))
    fields = {f.name: f.dataType for f in rows.schema.fields}
    extra = heads.select("_range", *[
        (F.col("_next")["_head"][c] if c in more else F.lit(None)).cast(t).alias(c) for c, t in fields.items() if c != "_range"],
        F.lit(True).alias("_extra"))
    both = rows.withColumn("_extra", F.lit(False)).unionByName(extra).repartition(F.col("_range")).withColumns(also)
    order = Window.partitionBy("_range").orderBy("_extra", key, *more)
    return both.withColumn("next", F.lead(F.struct(*more, *also)).over(order)).where(~F.col("_extra")).drop("_extra", "_range")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how alike they and the next document's are.

    The edited text has its last quarter (code points, rounded down) replaced by as many first ones of
    the next document, or by all of it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    rows = rows.withColumn("_key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    rows = with_next(rows, "_key", ["text"], {"s": signatures(F.col("text"))})
    rows = rows.select("doc_id", "text", "s", F.col("next")["text"].alias("after"), F.col("next")["s"].alias("a"))
    n = F.char_length("text").cast("long")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.withColumn("n_chars", n).withColumn("edited", F.concat(
        F.substring("text", F.lit(1), n.cast("int") - quarter), F.substring("after", F.lit(1), quarter)))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "s", "a",
                       signatures(F.col("edited")).alias("e"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("s")).alias("fingerprint"),
        fingerprint(F.col("e")).alias("edited_fingerprint"), likeness(F.col("s"), F.col("e")).alias("near_edited"),
        likeness(F.col("s"), F.col("a")).alias("near_next"), F.size("s").cast("long").alias("n_signatures"))


def similar_pairs(docs: DataFrame, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: ``members(doc_id, class_id)`` of equal sets, ``pairs(left, right, likeness)`` of classes.

    Documents without signatures are members of no class.
    """
    rows = docs.select("doc_id", signatures(text_of(docs)).alias("s")).where(F.size("s") > 0)
    rows = rows.withColumn("_set", F.md5(F.array_join("s", ",")))
    members = cut_lineage(rows.groupBy("_set").agg(F.min("doc_id").alias("class_id")).join(rows.select("doc_id", "_set"), "_set").select("doc_id", "class_id"))
    sets = cut_lineage(rows.groupBy("_set").agg(F.min("doc_id").alias("id"), F.first("s").alias("s")).select("id", "s", F.size("s").alias("n")))
    spread = sets.select("id", "n", F.explode("s").alias("x"))
    rarity = spread.groupBy("x").agg(F.count("*").alias("df"))
    keep = F.col("n") - F.ceil(F.col("n") * threshold) + 1
    rare = Window.partitionBy("id").orderBy("df", "x")
    probes = spread.join(rarity.where("df > 1"), "x", "right")
    # signatures of one document come first by rarity, so only the rest of the prefix is looked up
    shared = probes.groupBy("id").agg(F.count("*").alias("k"))
    probes = (probes.withColumn("_r", F.row_number().over(rare)).join(shared, "id")
              .where(F.col("_r") <= keep - (F.col("n") - F.col("k"))))
    band = F.floor(F.log("n") / math.log(1 / threshold) + 1e-9)
    left = probes.select(F.col("id").alias("l"), F.col("n").alias("ln"), "x", F.explode(F.array(band, band + 1)).alias("band"))
    right = probes.select(F.col("id").alias("r"), F.col("n").alias("rn"), "x", band.alias("band"))
    found = (left.join(right, ["band", "x"]).where((F.col("ln") <= F.col("rn")) & (F.col("ln") >= threshold * F.col("rn")) & (F.col("l") != F.col("r")))
             .where((F.col("ln") < F.col("rn")) | (F.col("l") < F.col("r"))).select("l", "r").distinct())
    pairs = (found.join(sets.select(F.col("id").alias("l"), F.col("s").alias("ls")), "l")
             .join(sets.select(F.col("id").alias("r"), F.col("s").alias("rs")), "r")
             .withColumn("likeness", likeness(F.col("ls"), F.col("rs"))).where(F.col("likeness") >= threshold)
             .select(F.least("l", "r").alias("left"), F.greatest("l", "r").alias("right"), "likeness"))
    return members, pairs
