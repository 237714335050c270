"""N-gram Jaccard join: documents whose sets of word 5-grams have a Jaccard similarity of 0.75 or more.

Jaccard distance is a metric, so the join works by pivots: regions of documents round a pivot,
windows by the triangle inequality for what a region must compare, and recursion into what is left.
Nearly all documents of a corpus are at distance 1 from any pivot, where a window prunes nothing, so
regions are first made of documents that can have a partner at all:

1. *Shared grams.* The grams of all distinct sets are dealt by their value; a gram of one set
   only can be in no intersection. A set needs ``ceil(0.75 n)`` shared grams to have any partner;
   the others are settled. Sizes stay exact, as ``n`` counts all grams.
2. *Regions.* In the order of rarity the first common gram of two partners is among the first
   ``n - ceil(0.75 n) + 1`` of both. Sets that have such a gram in common get into one region
   (connected components), so partners are always in the same region.
3. *Pivots.* In a region the next set that is not linked yet becomes a pivot; its distance to all is
   exact; sets within 0.25 join its component. What remains are links between components: all sets
   outside the largest component are compared, each only with sets of another component whose
   distance to the set's pivot lies within 0.25 of its own. Pairs in one component need no test.
4. *Large regions* (a third of all rows may be near copies of one text) are never gathered: their
   sets are dealt into cells, the round's pivots are sent to each cell, and rounds go on until
   every set outside the largest component has been a pivot.

Exact copies are one set from the start. Grams are 56-bit hashes, sets have 64-bit keys.

Defined cases: words are split at white space, A-Z lower-cased; fewer than five words: the whole
sequence is the only gram; null or blank texts have no gram and are linked with nothing, their
component is their own ``doc_id``; repeated rows are copies; an empty table gives an empty result;
only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, WORD_CLASS, cut_lineage, cut_round, hash_words, mix64, small_batches, text_of, utf8_buffer

GRAM = 5
THRESHOLD = 0.75
BITS = 56
#: A region with more sets or grams than this is worked on in cells.
REGION_SETS = 4096
REGION_GRAMS = 2 << 20
#: Grams that a task holds before it sends them on, for each bucket of grams, and in all at least and at most.
SENT, CHUNK, MOST = 1 << 13, 1 << 20, 1 << 22
#: Bytes of text whose grams make a bucket, and bytes whose grams are worked out at a time.
BUCKET_BYTES, SLICE = 8 << 20, 1 << 19
_WEIGHTS = mix64(np.arange(1, GRAM + 1, dtype=np.uint64))


def gram_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(grams, documents)``: the distinct gram hashes of each text, sorted by text, then value."""
    hashes, doc = hash_words(LOWER[raw], offsets)
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    mixed = [hashes * w for w in _WEIGHTS]
    n = len(hashes)
    if n >= GRAM:
        grams = sum(m[k:n - GRAM + 1 + k] for k, m in enumerate(mixed))
        full = doc[:n - GRAM + 1] == doc[GRAM - 1:]
        grams, owner = grams[full], doc[:n - GRAM + 1][full]
    else:
        grams, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((counts > 0) & (counts < GRAM))
    if len(few):
        first = np.concatenate([[0], np.cumsum(counts)])[few]
        short = np.zeros(len(few), np.uint64)
        for k in range(GRAM - 1):
            has = counts[few] > k
            short[has] += mixed[k][first[has] + k]
        short += counts[few].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        grams, owner = np.concatenate([grams, short]), np.concatenate([owner, few])
    grams = mix64(grams) >> np.uint64(64 - BITS)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], owner[new]


def set_keys(grams: np.ndarray, owner: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """``(size, key)`` of each document's set; equal sets have equal keys, the empty set has key 0."""
    size = np.bincount(owner, minlength=n_docs)
    spread = np.concatenate([[np.uint64(0)], np.cumsum(mix64(grams + np.uint64(0x632BE59BD9B4E019)))])
    ends = np.cumsum(size)
    total = spread[ends] - spread[ends - size]
    return size, np.where(size > 0, mix64(total ^ mix64(size.astype(np.uint64))), np.uint64(0)).astype(np.int64)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text", SLICE):
        raw, offsets = utf8_buffer(batch.column("text"))
        grams, owner = gram_sets(raw, offsets)
        size, key = set_keys(grams, owner, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), pa.array(size, pa.int64()), pa.array(key, pa.int64())],
                                         names=["doc_id", "uid", "n", "key"])


def _pack(*columns: np.ndarray) -> bytes:
    """Arrays of one length as bytes: each array's byte planes one after another, compressed."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(data: bytes, n: int, *types) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    out, at = [], 0
    for t in map(np.dtype, types):
        out.append(raw[at:at + n * t.itemsize].reshape(t.itemsize, n).T.copy().view(t).reshape(n))
        at += n * t.itemsize
    return out


_PACKED = "bucket int, n long, sets long, packed binary, keys binary"
_PACKED_NAMES = ["bucket", "n", "sets", "packed", "keys"]


def _send(buckets: int):
    """Per task: the grams of its distinct sets, packed for each bucket of gram values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = [], 0, set()

        def flush():
            grams = np.concatenate([g for g, _, _, _ in held])
            local = np.concatenate([np.repeat(np.arange(len(s), dtype=np.uint32) + b, s) for _, s, _, b in held])
            sizes, keys = np.concatenate([s for _, s, _, _ in held]), np.concatenate([k for _, _, k, _ in held])
            held.clear()
            order = np.argsort(grams, kind="stable")
            grams, local = grams[order], local[order]
            del order
            cuts = np.searchsorted(grams, (np.arange(buckets + 1, dtype=np.float64) * (float(1 << BITS) / buckets)).astype(np.uint64))
            cuts[-1] = len(grams)
            rows = []
            for b in range(buckets):
                lo, hi = int(cuts[b]), int(cuts[b + 1])
                if hi > lo:
                    here, at = np.unique(local[lo:hi], return_inverse=True)  # the sets that this bucket needs to know
                    gaps = np.diff(grams[lo:hi], prepend=np.uint64(0))
                    rows.append((b, hi - lo, len(here), _pack(gaps, at.astype(np.uint32)), _pack(keys[here], sizes[here].astype(np.uint32))))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=_PACKED_NAMES)

        base, most = 0, min(MOST, max(CHUNK, SENT * buckets))
        for batch in small_batches(batches, "text", SLICE):
            raw, offsets = utf8_buffer(batch.column("text"))
            grams, owner = gram_sets(raw, offsets)
            size, key = set_keys(grams, owner, batch.num_rows)
            fresh = np.array([s > 0 and k not in seen and not seen.add(k) for s, k in zip(size.tolist(), key.tolist())], bool)
            if fresh.any():
                held.append((grams[fresh[owner]], size[fresh], key[fresh], base))
                base += int(fresh.sum())
                total += len(held[-1][0])
            if total >= most:
                yield flush()
                total = base = 0
                seen = set()
        if total:
            yield flush()
    return run


def _gather(rows: pa.Table):
    """All packed rows of a bucket: ``(grams, set numbers, keys, sizes)`` with one number for each key."""
    grams, keys, sizes, at, base = [], [], [], [], 0
    for n, sets, packed, table in zip(*(rows.column(c).to_pylist() for c in _PACKED_NAMES[1:])):
        gaps, local = _unpack(packed, n, np.uint64, np.uint32)
        k, s = _unpack(table, sets, np.int64, np.uint32)
        grams.append(np.cumsum(gaps))
        at.append(local + np.uint32(base))
        keys.append(k)
        sizes.append(s)
        base += sets
    keys, sizes = np.concatenate(keys), np.concatenate(sizes)
    own, first, number = np.unique(keys, return_index=True, return_inverse=True)
    return np.concatenate(grams), number.astype(np.uint32)[np.concatenate(at)], own, sizes[first]


def _answer(buckets: int):
    """Per bucket of grams: those of two sets or more with their number of sets, packed by bucket of keys."""
    def run(rows: pa.Table) -> pa.Table:
        grams, number, keys, sizes = _gather(rows)
        order = np.lexsort((number, grams))
        grams, number = grams[order], number[order]
        del order
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (number[1:] != number[:-1])
        grams, number = grams[new], number[new]
        head = np.ones(len(grams), bool)
        head[1:] = grams[1:] != grams[:-1]
        starts = np.flatnonzero(head)
        df = np.diff(np.append(starts, len(grams))).astype(np.uint32)
        df = np.repeat(df, df)
        shared = df > 1
        grams, number, df = grams[shared], number[shared], df[shared]
        target = (mix64(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)[number]
        order = np.lexsort((number, target))
        grams, number, df, target = grams[order], number[order], df[order], target[order]
        out = []
        cuts = np.searchsorted(target, np.arange(buckets + 1))
        for b in range(buckets):
            lo, hi = int(cuts[b]), int(cuts[b + 1])
            if hi > lo:
                here, at = np.unique(number[lo:hi], return_inverse=True)
                out.append((b, hi - lo, len(here), _pack(grams[lo:hi], at.astype(np.uint32), df[lo:hi].astype(np.uint32)),
                            _pack(keys[here], sizes[here])))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(
            (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=_PACKED_NAMES)
    return run


def _settle(rows: pa.Table) -> pa.Table:
    """Per bucket of keys: the sets that have enough shared grams, which they list by rarity."""
    grams, df, at, keys, sizes, base = [], [], [], [], [], 0
    for n, sets, packed, table in zip(*(rows.column(c).to_pylist() for c in _PACKED_NAMES[1:])):
        g, local, d = _unpack(packed, n, np.uint64, np.uint32, np.uint32)
        k, s = _unpack(table, sets, np.int64, np.uint32)
        grams.append(g)
        df.append(d)
        at.append(local.astype(np.int64) + base)
        keys.append(k)
        sizes.append(s)
        base += sets
    keys, sizes = np.concatenate(keys), np.concatenate(sizes)
    own, first, number = np.unique(keys, return_index=True, return_inverse=True)
    size = sizes[first].astype(np.int64)
    number = number[np.concatenate(at)]
    grams, df = np.concatenate(grams), np.concatenate(df)
    have = np.bincount(number, minlength=len(own))
    least = -(-size * 3 // 4)
    enough = have >= least
    kept = enough[number]
    grams, df, number = grams[kept], df[kept], number[kept]
    order = np.lexsort((grams, df, number))
    grams = grams[order].astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(have[enough])]).astype(np.int32)
    return pa.Table.from_arrays([
        pa.array(own[enough]), pa.array(size[enough]), pa.array((have - least + 1)[enough], pa.int32()),
        pa.ListArray.from_arrays(pa.array(offsets), pa.array(grams))], names=["key", "n", "prefix", "grams"])


class _Region:
    """The sets of one region, with exact distances from one set to others."""

    def __init__(self, sizes: np.ndarray, lists: list[np.ndarray]):
        self.size = sizes.astype(np.int64)
        self.count = np.array([len(x) for x in lists])
        self.ends = np.cumsum(self.count)
        _, self.gram = np.unique(np.concatenate(lists), return_inverse=True)
        self.mark = np.zeros(int(self.gram.max()) + 1, np.int32)

    def grams(self, i: int) -> np.ndarray:
        return self.gram[self.ends[i] - self.count[i]:self.ends[i]]

    def common(self, i: int, others: np.ndarray | None = None) -> np.ndarray:
        """Size of the intersection of set ``i`` with all sets, or with ``others``."""
        mine = self.grams(i)
        self.mark[mine] = 1
        if others is None:
            found = np.add.reduceat(self.mark[self.gram], self.ends - self.count)
        else:
            found = np.array([int(self.mark[self.grams(j)].sum()) for j in others], np.int64)
        self.mark[mine] = 0
        return found

    def union(self, i: int, common: np.ndarray, others=slice(None)) -> np.ndarray:
        return self.size[i] + self.size[others] - common


def _links(common: np.ndarray, union: np.ndarray) -> np.ndarray:
    return 100 * common >= 75 * union


class _Parts:
    """Components of numbered sets."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, members: np.ndarray) -> None:
        labels = np.unique(self.label[members])
        if len(labels) > 1:
            self.label[np.isin(self.label, labels[1:])] = labels[0]


def join_region(sizes: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Component label of each set of a region, by pivots and windows; exact."""
    n = len(lists)
    region, parts = _Region(sizes, lists), _Parts(n)
    slack = 1 - THRESHOLD + 1e-6  # distances are kept as 32-bit floats
    pivot_of, pivots, far = np.full(n, -1), [], []
    for i in range(n):
        if pivot_of[i] >= 0:
            continue
        common = region.common(i)
        union = region.union(i, common)
        near = np.flatnonzero(_links(common, union))
        parts.join(np.append(near, i))
        far.append((1 - common / union).astype(np.float32))
        pivot_of[near[pivot_of[near] < 0]] = len(pivots)
        pivot_of[i] = len(pivots)
        pivots.append(i)
    compared = np.zeros(n, bool)
    compared[pivots] = True
    while True:
        labels, counts = np.unique(parts.label, return_counts=True)
        rest = np.flatnonzero((parts.label != labels[np.argmax(counts)]) & ~compared)
        if not len(rest):
            return parts.label
        i = rest[0]
        compared[i] = True
        distance = far[pivot_of[i]]
        others = np.flatnonzero((np.abs(distance - distance[i]) <= slack) & (parts.label != parts.label[i]) & ~compared)
        if len(others):
            common = region.common(i, others) if len(others) * 4 < n else region.common(i)[others]
            near = others[_links(common, region.union(i, common, others))]
            if len(near):
                parts.join(np.append(near, i))


def _join_small(rows: pa.Table) -> pa.Table:
    keys = rows.column("key").to_numpy()
    order = np.argsort(keys, kind="stable")
    lists = rows.column("grams").combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    arrays = [flat[ends[i]:ends[i + 1]] for i in order]
    label = join_region(rows.column("n").to_numpy()[order], arrays)
    return pa.table({"key": keys[order], "part": keys[order][label]})


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, label)`` of an undirected graph: the least node that can be reached.

    Each round gives a node the least label of itself and its neighbours, then the label of that label;
    the rounds needed grow with the logarithm of the longest path. Nodes without edges are not listed.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = cut_round(both.unionAll(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct())
    labels = cut_round(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")))
    while True:
        around = (both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("label").alias("seen")))
        pulled = labels.join(around, labels["node"] == around["x"]).select("node", "label", F.least("label", "seen").alias("new"))
        jump = pulled.select(F.col("node").alias("via"), F.col("new").alias("next"))
        step = (pulled.join(jump, pulled["new"] == jump["via"], "left")
                .select("node", "label", F.least("new", F.coalesce("next", "new")).alias("new")))
        step = cut_round(step)
        if step.where("new <> label").limit(1).count() == 0:
            return labels
        labels = step.select("node", F.col("new").alias("label"))


def _join_large(sets: DataFrame, cell_sets: int, cell_grams: int, pivots: int) -> DataFrame:
    """``(key, part)`` for regions too large to gather: rounds of pivots against cells of all sets.

    A round's pivots are sets outside their region's largest component that have not been pivots; all
    their links are found, so when none is left no link between components is missing. A region's first round
    has ``pivots`` of them, each further round twice as many, up to the sets of a cell (on average).
    """
    most = pivots
    state = cut_round(sets.select("region", "key", F.col("key").alias("part"), F.lit(False).alias("done")))
    cells = F.greatest(F.lit(1), F.ceil(F.col("members") / cell_sets), F.ceil(F.col("held") / cell_grams)).cast("long")
    counted = cut_round(sets.groupBy("region").agg(F.count("*").alias("members"), F.sum(F.size("grams")).alias("held")).withColumn("cells", cells))
    placed = (sets.join(counted, "region").withColumn("cell", F.pmod(F.xxhash64("key"), F.col("cells")))
              .select("region", "cell", "cells", "key", "n", "grams"))

    def compare(rows: pa.Table) -> pa.Table:
        keys, is_pivot = rows.column("key").to_numpy(), rows.column("pivot").to_numpy(zero_copy_only=False)
        lists = rows.column("grams").combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        region = _Region(rows.column("n").to_numpy(), [flat[ends[i]:ends[i + 1]] for i in range(len(keys))])
        left, right = [], []
        for i in np.flatnonzero(is_pivot):
            common = region.common(i)
            near = np.flatnonzero(_links(common, region.union(i, common)) & ~is_pivot)
            left.append(np.full(len(near), keys[i]))
            right.append(keys[near])
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate(left or [none]), "b": np.concatenate(right or [none])})

    while True:
        counts = state.groupBy("region", "part").agg(F.count("*").alias("c"))
        largest = counts.groupBy("region").agg(F.max(F.struct("c", "part")).alias("top")).select("region", F.col("top.part").alias("top"), F.col("top.c").alias("size"))
        open_ = state.join(largest, "region").where(~F.col("done") & ((F.col("part") != F.col("top")) | (F.col("size") == 1)))
        chosen = (open_.withColumn("_r", F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("key")))).where(F.col("_r") <= most)
                  .join(counted, "region").where((F.col("_r") <= pivots) | (F.col("_r") * F.col("cells") <= F.col("members"))).select("region", "key"))
        chosen = cut_round(chosen)
        most = min(2 * most, 1 << 30)
        if chosen.limit(1).count() == 0:
            return state.select("key", "part")
        sent = (placed.join(chosen, ["region", "key"], "left_semi")
                .withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).withColumn("pivot", F.lit(True)))
        rows = placed.withColumn("pivot", F.lit(False)).unionByName(sent).drop("cells")
        links = rows.groupBy("region", "cell").applyInArrow(compare, "a long, b long")
        same = state.where("key <> part").select(F.col("key").alias("a"), F.col("part").alias("b"))
        labels = components(cut_round(links.unionAll(same)))
        state = (state.join(labels, state["key"] == labels["node"], "left")
                 .join(chosen.select(F.col("key").alias("was")), F.col("key") == F.col("was"), "left")
                 .select("region", "key", F.coalesce("label", "part").alias("part"), (F.col("done") | F.col("was").isNotNull()).alias("done")))
        state = cut_round(state)


def join_sets(docs: DataFrame, region_sets: int = REGION_SETS, region_grams: int = REGION_GRAMS, pivots: int = 64) -> DataFrame:
    """``(key, part)``: the component of each set that has a partner, for ``docs(text)``."""
    size = docs.select(F.sum(F.octet_length(text_of(docs)).cast("long"))).first()[0] or 0
    buckets = max(16, size // BUCKET_BYTES)
    sent = docs.select(text_of(docs).alias("text")).mapInArrow(_send(buckets), _PACKED)
    answered = sent.groupBy("bucket").applyInArrow(_answer(buckets), _PACKED)
    sets = cut_lineage(answered.groupBy("bucket").applyInArrow(_settle, "key long, n long, prefix int, grams array<long>"))
    rare = sets.select("key", F.explode(F.slice("grams", F.lit(1), F.col("prefix"))).alias("gram"))
    firsts = rare.groupBy("gram").agg(F.min("key").alias("first"), F.count("*").alias("c")).where("c > 1")
    edges = rare.join(firsts, "gram").where("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b")).distinct()
    regions = components(edges)
    sets = sets.join(regions, sets["key"] == regions["node"]).select("key", "n", "grams", F.col("label").alias("region"))
    sizes = sets.groupBy("region").agg(F.count("*").alias("m"), F.sum(F.size("grams")).alias("g"))
    large = cut_lineage(sizes.where((F.col("m") > region_sets) | (F.col("g") > region_grams)).select("region"))
    if large.limit(1).count() == 0:
        return sets.groupBy("region").applyInArrow(_join_small, "key long, part long")
    small = sets.join(large, "region", "left_anti").groupBy("region").applyInArrow(_join_small, "key long, part long")
    return small.unionAll(_join_large(cut_lineage(sets.join(large, "region", "left_semi")), region_sets, region_grams, pivots))


def _placed(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, uid, n, part`` for each row of ``docs(doc_id, uid, text)``: its set's size and its component."""
    sized = cut_lineage(docs.mapInArrow(_sizes, "doc_id long, uid long, n long, key long"))
    parts = cut_lineage(join_sets(docs, **options))
    return (sized.join(parts.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"), "left")
            .select("doc_id", "uid", "n", F.coalesce("part", "key").alias("part")))


def link_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``."""
    told = _placed(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.lit(0).cast("long").alias("uid"), text_of(docs).alias("text")), **options)
    least = told.where("n > 0").groupBy("part").agg(F.min("doc_id").alias("least"))
    return (told.join(least, "part", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents with one of each component left, the one with the least ``doc_id``; all columns are kept.

    Rows are told apart by a hash of id and text, so ids that repeat with other texts are other documents;
    rows that repeat as a whole are copies. Texts without words all stay.
    """
    text = text_of(docs)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"),
                       F.xxhash64(docs["doc_id"], F.md5(text)).alias("uid"), text.alias("text"), text.rlike(WORD_CLASS).alias("worded"))
    told = _placed(rows.select("doc_id", "uid", "text"), **options).where("n > 0")
    first = told.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first"))
    stays = first.select(F.col("first.uid").alias("stays"))
    once = rows.where("worded").select("row", "uid").withColumn("at", F.row_number().over(Window.partitionBy("uid").orderBy(F.lit(0)))).where("at = 1")
    kept = once.join(stays, F.col("uid") == F.col("stays"), "left_semi").select("row")
    return rows.where("not worded").select("row").unionAll(kept).select("row.*")
