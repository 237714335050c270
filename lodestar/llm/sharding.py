"""Sharding: best-fit-decreasing packing of indivisible groups into a fixed number of shards.

Groups (here: equal texts) are sorted by size and each enters the bin with the tightest remaining
capacity, found in a balanced tree. The capacity is the smallest one at which the groups fit into
the asked number of shards, so the shards come out near equal in bytes.

Scale: the tree works on a bounded number of items. A group above ``total / FINE`` is an item of
its own (there can be fewer than ``FINE`` of those); all smaller groups are pooled by a hash of
their key into ``POOLS`` items. The items are aggregated by Spark; the driver holds at most
``FINE + POOLS`` sizes whatever the table's size, and sends back one shard number per item.

Groups stay whole as long as near-equal shards (``SLACK`` above the mean) can hold them. A group larger than that
is dealt over as few near-equal pieces as fit; if the large groups (above ``total / (8 * n_shards)``) still do not
pack, the largest group of the fullest shard is cut into one piece more, and so on. A cut deals ``BUCKETS`` hashes of
``doc_id`` to pieces by their bytes; equal ``doc_id`` stay together.

Defined cases: null text has no bytes (size 1) and groups with the empty text; null ``doc_id`` and
repeated rows are kept, each with its own slot; an empty table gives an empty result; columns other
than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, text_of

FINE = 1 << 16
POOLS = 1 << 13
SLOT_BUCKETS = 512
BUCKETS = 512
SLACK = 1.02


class _Tree:
    """A treap over ``(remaining, bin)`` pairs: insert, and take the least pair not below a size."""

    __slots__ = ("root", "seed")

    def __init__(self):
        self.root, self.seed = None, 1

    def insert(self, key):
        self.seed = self.seed * 6364136223846793005 + 1442695040888963407 & 0xFFFFFFFFFFFFFFFF
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, [key, self.seed, None, None]), high)

    def take(self, size):
        """Remove and return the least key whose remaining capacity is ``size`` or more, else None."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        node, path = high, []
        while node[2] is not None:
            path.append(node)
            node = node[2]
        if path:
            path[-1][2] = node[3]
        else:
            high = node[3]
        self.root = self._join(low, high)
        return node[0]

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _join(self, a, b):
        if a is None or b is None:
            return a if b is None else b
        if a[1] > b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b


def best_fit(sizes: list[int], capacity: int, max_bins: int | None = None) -> list[int] | None:
    """Bin of each size, sizes given in descending order; None when more than ``max_bins`` are needed."""
    tree, out, bins = _Tree(), [], 0
    for size in sizes:
        found = tree.take(size)
        if found is None:
            if size > capacity or bins == max_bins:
                return None
            found, bins = (capacity, bins), bins + 1
        tree.insert((found[0] - size, found[1]))
        out.append(found[1])
    return out


def pack(sizes: list[int], n_bins: int) -> list[int]:
    """Best-fit-decreasing into ``n_bins`` at the smallest capacity that the search finds to fit."""
    if not sizes:
        return []
    low = max(sizes[0], -(-sum(sizes) // n_bins))
    high = low + sizes[0]  # always fits: a bin that refuses an item is then fuller than the mean
    best = best_fit(sizes, high, n_bins)
    while low < high:
        mid = (low + high) // 2
        found = best_fit(sizes, mid, n_bins)
        if found is None:
            low = mid + 1
        else:
            best, high = found, mid
    return best


def cut_buckets(buckets: dict[int, int], n: int) -> dict[int, int]:
    """Piece of each bucket: ``n`` runs of buckets of near-equal bytes (fewer if a bucket is larger than a piece)."""
    total, before, out = sum(buckets.values()), 0, {}
    for b in sorted(buckets):
        out[b] = min(n - 1, (2 * before + buckets[b]) * n // (2 * total))
        before += buckets[b]
    return out


def plan_cuts(groups: list[dict[int, int]], mean: float, n_shards: int) -> list[dict[int, int]]:
    """Pieces of the large groups' buckets: all zero for a group that stays whole."""
    target = max([int(mean * SLACK) + 1, *(max(g.values()) for g in groups)])
    sizes = [sum(g.values()) for g in groups]
    most = [min(len(g), -(-8 * s // max(1, int(mean)))) for g, s in zip(groups, sizes)]
    cuts = [min(m, -(-s // target)) for m, s in zip(most, sizes)]
    pieces = [cut_buckets(g, c) for g, c in zip(groups, cuts)]
    while True:
        loads: dict[tuple[int, int], int] = {}
        for i, g in enumerate(groups):
            for b, p in pieces[i].items():
                loads[i, p] = loads.get((i, p), 0) + g[b]
        items = sorted(loads, key=lambda x: (-loads[x], x))
        order = [loads[x] for x in items]
        if best_fit(order, target, n_shards) is not None:
            return pieces
        shard = pack(order, n_shards)
        full = [0] * n_shards
        for size, s in zip(order, shard):
            full[s] += size
        free = [(-full[s], k) for k, s in enumerate(shard) if cuts[items[k][0]] < most[items[k][0]]]
        if not free:
            return pieces
        i = items[min(free)[1]][0]
        cuts[i] += 1
        pieces[i] = cut_buckets(groups[i], cuts[i])


def _pool(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(POOLS)).cast("int")


def assign_shards(thin: DataFrame, n_shards: int = 16) -> DataFrame:
    """``thin(doc_id, size, key, ...)`` plus ``shard``: equal keys together, bytes near equal."""
    spark = thin.sparkSession
    groups = thin.groupBy("key").agg(F.sum("size").alias("bytes"))
    total = thin.agg(F.sum("size")).first()[0] or 0
    # fewer than 8 * n_shards groups can be large
    large = sorted(bytes(r["key"]) for r in groups.where(F.col("bytes") > max(1, total // (8 * n_shards))).collect())
    bucket = F.coalesce(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(BUCKETS)), F.lit(0)).cast("int")
    cut = []
    if large:
        names = spark.createDataFrame([(bytearray(k),) for k in large], "key binary")
        found: dict[bytes, dict[int, int]] = {k: {} for k in large}
        for r in thin.join(F.broadcast(names), "key").groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("bytes")).collect():
            found[bytes(r["key"])][r["bucket"]] = r["bytes"]
        pieces = plan_cuts([found[k] for k in large], total / n_shards, n_shards)
        cut = [(bytearray(k), b, p) for k, own in zip(large, pieces) for b, p in own.items() if p]
    if cut:
        table = spark.createDataFrame(cut, "key binary, bucket int, piece long")
        thin = thin.withColumn("bucket", bucket).join(F.broadcast(table), ["key", "bucket"], "left").drop("bucket")
        thin = thin.withColumn("piece", F.coalesce("piece", F.lit(0).cast("long")))
    else:
        thin = thin.withColumn("piece", F.lit(0).cast("long"))
    items = thin.groupBy("key", "piece").agg(F.sum("size").alias("bytes"))
    fine = F.col("bytes") > F.lit(total // FINE)
    packed = items.groupBy(
        F.when(fine, F.col("key")).alias("key"), F.when(fine, F.col("piece")).alias("piece"),
        F.when(~fine, _pool(F.col("key"))).alias("pool")).agg(F.sum("bytes").alias("bytes"))
    rows = [(r["bytes"], bytes(r["key"]) if r["key"] is not None else b"", r["piece"] or 0, r["pool"]) for r in packed.collect()]
    rows.sort(key=lambda r: (-r[0], r[1], r[2], -1 if r[3] is None else r[3]))
    shard = pack([r[0] for r in rows], n_shards)
    named = [(bytearray(k), int(p), int(s)) for (_, k, p, pool), s in zip(rows, shard) if pool is None]
    pools = [0] * POOLS
    for (_, _, _, pool), s in zip(rows, shard):
        if pool is not None:
            pools[pool] = s
    own = spark.createDataFrame(named, "key binary, piece long, own int")
    table = F.split(F.lit(",".join(map(str, pools))), ",").cast("array<int>")  # folded into one constant
    pooled = F.get(table, _pool(F.col("key")))
    return (thin.join(F.broadcast(own), ["key", "piece"], "left")
            .withColumn("shard", F.coalesce("own", pooled)).drop("own", "piece"))


def number_slots(df: DataFrame, shard: str = "shard") -> DataFrame:
    """Adds ``slot``: 0, 1, ... in each shard, without one task holding a whole shard.

    Rows are numbered inside (shard, bucket) cells, a bucket being a hash of ``doc_id``; a small table
    of the cells' counts (shards x SLOT_BUCKETS rows at most) gives each cell's first slot.
    """
    df = df.withColumn("_cell", F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_BUCKETS)))
    counts = df.groupBy(shard, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(shard, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(shard, "_cell").orderBy("doc_id", "text_crc32", "size")
    return (df.withColumn("_at", F.row_number().over(inside) - 1).join(first, [shard, "_cell"])
            .withColumn("slot", F.col("_first") + F.col("_at")).drop("_cell", "_at", "_first"))


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    text = text_of(docs)
    thin = cut_lineage(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("key")))
    out = number_slots(assign_shards(thin, n_shards))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"),
                      F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
