"""SimHash near-duplicates: every pair of fingerprints within four bits, by covering locality-sensitive hashing.

*Fingerprint.* The 4-word shingles of a text, repeats included, are hashed (XXH64 of the UTF-8 bytes, seed
42); a bit of the 64 is set if more than half of the hashes set it.

*Covering masks.* Bit ``i`` is given a non-zero vector ``c(i)`` of five bits, round robin over all 31. Table
``v`` (each non-zero vector of five bits) keeps the bits with ``<c(i), v> = 1`` modulo 2, half of them, and
buckets fingerprints by what is left. The vectors of any four differing bits span at most four dimensions,
so some ``v`` is at right angles to all four: in that table none of the differing bits is kept and the pair
shares a bucket. No pair within the radius can be missed.

*Buckets.* Equal fingerprints are one from the start. Buckets of two or more are counted, then dealt into
cells of bounded size, in which each bucket is compared whole (xor and population count) and answers with
the stars of its components: never with all pairs. A bucket above ``bucket`` fingerprints is never gathered:

1. its members are dealt by hash into parts of that size, which links most of a dense cluster;
2. buckets whose members now lie in one component are done, as further links would tell nothing;
3. in the others a pair differs only in bits that the table does not keep, so these are covered again by 31
   masks. Two levels leave 16 free bits at most, which bounds a bucket at 65,536 fingerprints.

*Hot keys.* Joins back to documents send the few fingerprints or components that hold over a 1,024th of the rows
(at most 1,024 of them) by broadcast and shuffle the others. Intermediate tables are thin (ids and
fingerprints) and written to the shared checkpoint folder, so a lost executor repeats little.

Defined cases: null and blank texts have the fingerprint zero and are linked like any other; fewer than four
words are one shingle; very long texts are hashed whole, in blocks; a null ``doc_id`` is no smallest id
(a component of nulls only has a null ``component_id``); repeated rows are repeated in the result; an
empty table gives an empty result; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, small_batches, text_of
from .jaccard_join import components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints of one bucket that are compared in one piece.
BUCKET = 2048
#: Rows of buckets that one task's group holds at a time.
CELL = 1 << 16
_BLOCK = 1 << 14


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of one text, as a signed number."""
    words = text.lower().split()  # bytes: A-Z and the six white-space characters only
    if not words:
        return 0
    whole = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0] + [e + 1 for e in ends[:-1]]
    if len(words) < SHINGLE:
        cuts = [(0, len(whole))]
    else:
        cuts = list(zip(starts, ends[SHINGLE - 1:]))
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(cuts), _BLOCK):
        hashes = b"".join([digest(whole[s:e], SEED) for s, e in cuts[at:at + _BLOCK]])
        votes += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * votes > len(cuts)).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        prints = [fingerprint(t.as_buffer().to_pybytes()) for t in batch.column("text").cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "fp"])


def covering_masks(free: int, radius: int = RADIUS) -> list[int]:
    """Masks of which one keeps none of any ``radius`` of the bits of ``free``, and which keep half of them each."""
    bits = [i for i in range(64) if free >> i & 1]
    tables = (1 << (radius + 1)) - 1
    code = {bit: 1 + k % tables for k, bit in enumerate(bits)}
    return [sum(1 << bit for bit in bits if (code[bit] & v).bit_count() % 2) for v in range(1, tables + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _compare(radius: int):
    """Per cell: stars of the components of each bucket, found by comparing all its pairs in place."""
    def run(rows: pa.Table) -> pa.Table:
        table, kept, fp = (rows.column(c).to_numpy() for c in ("t", "m", "fp"))
        order = np.lexsort((fp, kept, table))
        table, kept, fp = table[order], kept[order], fp[order]
        n = len(fp)
        head = np.ones(n, bool)
        head[1:] = (table[1:] != table[:-1]) | (kept[1:] != kept[:-1])
        starts = np.flatnonzero(head)
        end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
        parent = np.arange(n)
        left, step, bits = np.arange(n), 0, fp.view(np.uint64)
        while True:
            step += 1
            left = left[left + step < end[left]]
            if not len(left):
                break
            near = left[np.bitwise_count(bits[left] ^ bits[left + step]) <= radius]
            near = near[parent[near] != parent[near + step]]
            for i in near.tolist():
                a, b = i, i + step
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[max(a, b)] = min(a, b)
            if len(near):
                while not np.array_equal(up := parent[parent], parent):
                    parent = up
        linked = np.flatnonzero(parent != np.arange(n))
        return pa.table({"a": fp[linked], "b": fp[parent[linked]]})
    return run


def _stars(members: DataFrame, radius: int) -> DataFrame:
    """Links inside buckets; ``members(t, m, fp)`` with buckets of bounded size, dealt into cells by bucket."""
    cells = 1 + members.count() // CELL
    cell = F.pmod(F.xxhash64("t", "m"), F.lit(cells)).alias("cell")
    return members.select("t", "m", "fp", cell).groupBy("cell").applyInArrow(_compare(radius), "a long, b long").distinct()


def _bucketed(rows: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """``(small, large)`` rows of buckets with two members or more, with the bucket's count ``c``."""
    sizes = rows.groupBy("t", "m").agg(F.count("*").alias("c")).where("c > 1")
    members = cut_lineage(rows.join(sizes, ["t", "m"]))
    return members.where(F.col("c") <= bucket), members.where(F.col("c") > bucket)


def link_fingerprints(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``(node, label)`` for each of the distinct ``prints(fp)`` that is within ``radius`` bits of another one.

    The label is the least fingerprint that links reach. Exact for every bucket size.
    """
    masks = covering_masks((1 << 64) - 1, radius)
    # the keys of all tables beside the fingerprint, as one array: one pass, 31 thin rows each
    rows = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "m"))
    small, large = _bucketed(rows, bucket)
    edges = cut_lineage(_stars(small, radius))
    if large.limit(1).count() == 0:
        return components(edges)
    parts = large.withColumn("m", F.xxhash64("m", F.pmod(F.xxhash64("fp"), F.ceil(F.col("c") / bucket).cast("long"))))
    edges = cut_lineage(edges.unionAll(_stars(parts, radius)).distinct())
    labels = components(edges)
    told = large.join(labels, large["fp"] == labels["node"], "left").select("t", "m", "fp", F.coalesce("label", "fp").alias("label"))
    open_ = told.groupBy("t", "m").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    open_ = cut_lineage(large.join(open_, ["t", "m"], "left_semi").select("t", "fp"))
    if open_.limit(1).count() == 0:
        return labels
    finer = [[_signed(m | f) for f in covering_masks(~m & ((1 << 64) - 1), radius)] for m in masks]
    keys = F.get(F.array(*[F.array(*[F.lit(k) for k in row]) for row in finer]), F.col("t"))
    rows = (open_.select("t", "fp", F.posexplode(keys).alias("u", "mask"))
            .select((F.col("t") * len(masks) + F.col("u")).alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("m"), "fp"))
    some, rest = _bucketed(rows, 1 << 16)
    return components(cut_lineage(edges.unionAll(_stars(some.unionAll(rest), radius)).distinct()))


def join_skewed(left: DataFrame, right: DataFrame, key: str, share: int = 1024) -> DataFrame:
    """``left`` (any number of rows for a key) with the one row of ``right`` for its key, kept if there is none.

    Keys that hold more than a ``share``-th of ``left`` are ``share`` at most; their rows of ``right`` are
    broadcast, so no task gets all of a hot key. Null keys match nothing.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_c"))
    total = left.count()
    hot = cut_lineage(right.join(counts.where(F.col("_c") * share > total).select(key), key, "left_semi")
                      .select(F.col(key).alias("_hot"), F.struct(*[c for c in right.columns if c != key]).alias("_told")))
    marked = left.join(F.broadcast(hot), left[key] == hot["_hot"], "left")
    values = [c for c in right.columns if c != key]
    near = marked.where("_hot is not null").select(*left.columns, *[F.col("_told")[c].alias(c) for c in values])
    far = marked.where("_hot is null").select(*left.columns).join(right, key, "left").select(*left.columns, *values)
    return near.unionAll(far)


def link_documents(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``."""
    rows = cut_lineage(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
                       .mapInArrow(_fingerprints, "doc_id long, fp long"))
    prints = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = cut_lineage(link_fingerprints(prints.select("fp"), radius, bucket).withColumnRenamed("node", "fp"))
    linked = prints.join(labels, "fp").select("fp", "label", "least")
    roots = linked.groupBy("label").agg(F.min("least").alias("root"))
    named = cut_lineage(join_skewed(linked.select("fp", "label"), roots, "label").select("fp", "root", F.lit(True).alias("linked")))
    ids = prints.join(named, "fp", "left").select("fp", F.when(F.col("linked"), F.col("root")).otherwise(F.col("least")).alias("component_id"))
    return (join_skewed(rows, ids, "fp")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))
