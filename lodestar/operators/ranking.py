"""Ranking, top-k, ordering and batching operators (W*).

All per-query work is partitioned by the query key, so a query's rows meet in one task only
after a ``WindowGroupLimit`` has cut them to ``k`` on the map side (Catalyst inserts it for
``row_number() <= k``). Places and running sums inside keys of unknown size (``running_in_keys``) cut a hot
key into slices. Global numbering never uses an un-partitioned window: ``zip_index``
counts rows per partition of a sorted table that is written once (``checkpoint()``), so rows and counts
come from the same partitions, and adds broadcast offsets (the number of partitions is the bound).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows of one key that a single sorted window may hold; a key with more is cut into slices.
HOT_ROWS = 1 << 20
#: Hot keys that may be broadcast.
HOT_KEYS = 1 << 16


def _cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _best_first(score: str, tie: str, tie_desc: bool) -> list[Column]:
    return [F.col(score).desc(), F.col(tie).desc() if tie_desc else F.col(tie).asc()]


def rank_by_score(df: DataFrame, key: str = "qid", score: str = "score", tie: str = "docid",
                  tie_desc: bool = False, rank_col: str = "rank", hot_rows: int | None = None) -> DataFrame:
    """Rank from 1 by score descending inside each ``key``; ties broken by ``tie``.

    One window per key, for rankings bounded by a retrieval depth. With ``hot_rows`` a key may hold any number of
    rows: one above the limit is ranked in slices (:func:`running_in_keys`)."""
    order = _best_first(score, tie, tie_desc)
    if hot_rows is None:
        return df.withColumn(rank_col, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))
    return running_in_keys(df, [key], order, out=rank_col, hot_rows=hot_rows).withColumn(rank_col, F.col(rank_col) + 1)


def topk_per_query(df: DataFrame, k: int, key: str = "qid", score: str = "score", tie: str = "docid",
                   tie_desc: bool = False, rank_col: str = "rank") -> DataFrame:
    """The ``k`` best rows per key. The filter on ``row_number`` lets Catalyst add a partial
    ``WindowGroupLimit`` before the shuffle, so a hot key ships at most k rows per map task."""
    return rank_by_score(df, key, score, tie, tie_desc, rank_col).filter(F.col(rank_col) <= k)


def check_contiguous_ranks(ranking: DataFrame, key: str = "qid", rank: str = "rank") -> DataFrame:
    """Ranks must run 1, 2, 3, ... per key. Returns the distinct ``(key, rank)`` that break it:
    a rank other than 1 whose predecessor is missing, or a rank that repeats. Equi-joins and
    aggregates on ``(key, rank)`` only, so a key holding a third of all rows is still spread over
    many tasks (a ``lag`` window would sort it in one)."""
    kr = ranking.select(key, rank)
    prev = kr.select(key, (F.col(rank) + 1).alias(rank)).distinct()
    gaps = kr.filter(F.col(rank) != 1).join(prev, [key, rank], "left_anti")
    dups = kr.groupBy(key, rank).count().filter("count > 1").select(key, rank)
    return gaps.unionByName(dups).distinct()


def _sorted_once(df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    """The rows in order with ``_part`` (partition) and ``_at`` (position in it), written once.

    Evaluated twice, a sort may sample other bounds or be coalesced into other partitions, so anything
    counted per partition must come from the same written rows as the rows themselves."""
    ensure_checkpoint_dir(df.sparkSession)
    s = df.orderBy(*_cols(order_by)).withColumn("_mid", F.monotonically_increasing_id())
    s = s.withColumn("_part", F.shiftright("_mid", 33)).withColumn("_at", F.col("_mid") - F.shiftleft("_part", 33))
    return s.drop("_mid").checkpoint(eager=True)


def zip_index(df: DataFrame, order_by: Sequence[str | Column], index_col: str = "idx") -> DataFrame:
    """Dense 0-based global index in ``order_by`` order (the order must be total).

    A range-partitioned sort, written once, then per-partition counts (one row per partition,
    broadcast) give each partition its offset: no single-task window over the whole table.
    """
    s = _sorted_once(df, order_by)
    counts = s.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).select("_part", "_off")
    out = s.join(F.broadcast(offsets), "_part").withColumn(index_col, (F.col("_off") + F.col("_at")).cast("long"))
    return out.drop("_part", "_at", "_off")


def assign_batches(df: DataFrame, bsize: int, order_by: Sequence[str | Column], drop_last: bool = False,
                   batch_col: str = "batch") -> DataFrame:
    """Consecutive batches of ``bsize`` rows in a total order; ``drop_last`` drops a short tail."""
    idx = zip_index(df, order_by, "_i")
    out = idx.withColumn(batch_col, F.floor(F.col("_i") / bsize).cast("long")).withColumn(
        "pos_in_batch", (F.col("_i") % bsize).cast("long"))
    if drop_last:
        full = out.groupBy(batch_col).agg(F.count(F.lit(1)).alias("_bn")).filter(F.col("_bn") == bsize)
        out = out.join(full.select(batch_col), batch_col, "left_semi")
    return out.drop("_i")


def length_sorted_batches(df: DataFrame, length: Column, id_col: str, bsize: int) -> DataFrame:
    """Order by length (ties by id), number batches; ``orig_idx`` keeps the inverse order."""
    with_len = df.withColumn("_len", length)
    a = zip_index(with_len, [id_col], "orig_idx")
    b = zip_index(a, ["_len", id_col], "sorted_idx")
    return b.withColumn("batch", F.floor(F.col("sorted_idx") / bsize).cast("long")).drop("_len")


def assign_shards_range(df: DataFrame, num_shards: int, order_by: Sequence[str | Column],
                        shard_col: str = "shard") -> DataFrame:
    """Shard ``s`` holds indexes ``[s*ceil(n/S), (s+1)*ceil(n/S))``."""
    idx = zip_index(df, order_by, "_i")
    n = idx.agg(F.count(F.lit(1)).alias("_n"))
    per = n.select(F.greatest(F.ceil(F.col("_n") / num_shards), F.lit(1)).alias("_per"))
    return (idx.crossJoin(F.broadcast(per))  # one-row side
            .withColumn(shard_col, F.floor(F.col("_i") / F.col("_per")).cast("long"))
            .drop("_i", "_per"))


def assign_shards_round_robin(df: DataFrame, ranks: int, order_by: Sequence[str | Column],
                              shard_col: str = "shard") -> DataFrame:
    """Row i goes to shard ``i % ranks``."""
    idx = zip_index(df, order_by, "_i")
    return idx.withColumn(shard_col, (F.col("_i") % ranks).cast("long")).drop("_i")


def chunk_size(n: Column, ranks: int, cap: int = 25000) -> Column:
    """W7 (chunks): ``min(cap, 1 + n/ranks)`` passages per chunk."""
    return F.least(F.lit(cap), (1 + F.floor(n / ranks))).cast("long")


def running_offsets(df: DataFrame, length: str, order_by: Sequence[str | Column],
                    partition_by: Sequence[str] | None = None, offset_col: str = "offset",
                    hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Exclusive running sum of ``length``.

    Without ``partition_by``, the rows are sorted and written once, and the running sum is done per range
    partition plus broadcast partition totals, so no single task sees the whole table. With ``partition_by``
    see :func:`running_in_keys`.
    """
    if partition_by:
        return running_in_keys(df, partition_by, order_by, length, offset_col, hot_rows)
    out_type = _sum_type(df, length)
    s = _sorted_once(df, order_by)
    totals = s.groupBy("_part").agg(F.sum(length).alias("_tot"))
    wt = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_tot").over(wt), F.lit(0))).select("_part", "_base")
    wl = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = s.withColumn("_local", F.coalesce(F.sum(length).over(wl), F.lit(0)))
    out = out.join(F.broadcast(totals), "_part").withColumn(
        offset_col, (F.col("_base") + F.col("_local")).cast(out_type))
    return out.drop("_part", "_at", "_local", "_base")


def _sum_type(df: DataFrame, length: str) -> str:
    return "long" if df.schema[length].dataType.typeName() in ("long", "integer", "short", "byte") else "double"


def running_in_keys(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column], length: str | None = None,
                    out: str = "offset", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Exclusive running sum of ``length`` inside each group of equal ``keys`` (nulls are a group), or the 0-based
    place of a row where ``length`` is None. The order must be total for places to be the same in each run.

    Groups of up to ``hot_rows`` rows are one sorted window each. A larger group never is: its rows go through
    :func:`_running_slices`. Groups are counted first (partial counts, one row per group); ``hot_rows=None`` says
    that all groups are small by construction and leaves the count out.
    """
    keys = list(keys)
    before = Window.partitionBy(*keys).orderBy(*_cols(order_by)).rowsBetween(Window.unboundedPreceding, -1)
    step = F.lit(1) if length is None else F.col(length)
    kind = "long" if length is None else _sum_type(df, length)

    def windowed(rows: DataFrame) -> DataFrame:
        return rows.withColumn(out, F.coalesce(F.sum(step).over(before), F.lit(0)).cast(kind))

    if hot_rows is None:
        return windowed(df)
    ensure_checkpoint_dir(df.sparkSession)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).select(
        *[F.col(c).alias(f"_hot{i}") for i, c in enumerate(keys)]).checkpoint()
    n_hot = hot.count()
    if n_hot == 0:
        return windowed(df)
    if n_hot <= HOT_KEYS:
        hot = F.broadcast(hot)
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & df[c].eqNullSafe(F.col(f"_hot{i}"))
    rest = windowed(df.join(hot, same, "left_anti"))
    return rest.unionByName(_running_slices(df.join(hot, same, "left_semi"), keys, order_by, step, kind, out))


def _running_slices(df: DataFrame, keys: list[str], order_by: Sequence[str | Column], step: Column, kind: str,
                    out: str) -> DataFrame:
    """Running sums of groups of any size: rows are range-partitioned by keys and order and written once, so a group
    lies in consecutive partitions. A slice, what one partition holds of a group, is summed by itself. Only the first
    slice of a partition can go on from an earlier one, and only the first and last slices of partitions can be
    gone on from: those few rows (two a partition at most) give what is carried into each partition."""
    s = _sorted_once(df, [*keys, *order_by]).withColumn("_step", step)
    ends = s.groupBy("_part").agg(F.max("_at").alias("_end"))
    slices = s.groupBy("_part", *keys).agg(F.sum("_step").alias("_sum"), F.min("_at").alias("_a"), F.max("_at").alias("_b"))
    edges = slices.join(F.broadcast(ends), "_part").filter((F.col("_a") == 0) | (F.col("_b") == F.col("_end")))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.withColumn("_carried", F.sum("_sum").over(earlier)).filter(F.col("_carried").isNotNull()) \
        .select("_part", "_carried")
    inside = Window.partitionBy("_part", *keys).orderBy("_at")
    first = F.col("_at") == F.row_number().over(inside) - 1       # of its partition
    local = F.coalesce(F.sum("_step").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = s.withColumn("_first", first).withColumn("_local", local).join(F.broadcast(carried), "_part", "left")
    total = F.col("_local") + F.when(F.col("_first"), F.coalesce("_carried", F.lit(0))).otherwise(F.lit(0))
    return rows.withColumn(out, total.cast(kind)).drop("_part", "_at", "_step", "_first", "_local", "_carried")


def first_hit(ranked: DataFrame, hit: str = "has_answer", key: str = "qid", rank: str = "rank",
              out: str = "first_hit_rank") -> DataFrame:
    """Smallest rank with a hit per key (null when none)."""
    return ranked.groupBy(key).agg(F.min(F.when(F.col(hit), F.col(rank))).cast("long").alias(out))


def epoch_shuffle(df: DataFrame, id_col: str, seed: int, epoch: int, order_col: str = "shuffle_key") -> DataFrame:
    """A re-runnable shuffle order: the md5 of ``seed + epoch`` and the id."""
    return df.withColumn(order_col, F.md5(F.concat(F.lit(f"{seed + epoch}:"), F.col(id_col).cast("string"))))


def mix_sources(batches: DataFrame, rates: DataFrame, iterations: int, seed: int = 0) -> DataFrame:
    """Batch manifest. ``batches(source, batch)`` numbered from 0 per source,
    ``rates(source, rate)``. Each source contributes ``int(iterations*rate)`` batch slots, re-using
    its batches in a cycle; slots are ordered by a hash of (source, slot, seed)."""
    n_batches = batches.groupBy("source").agg(F.count(F.lit(1)).alias("n_batches"))
    slots = (rates.join(n_batches, "source")
             .withColumn("n_slots", F.floor(F.lit(iterations) * F.col("rate")).cast("long"))
             .filter(F.col("n_slots") > 0)
             .withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_slots") - 1)))
             .withColumn("batch", F.col("slot") % F.col("n_batches")))
    out = slots.select("source", "slot", "batch",
                       F.xxhash64("source", "slot", F.lit(seed)).alias("order_key"))
    return out


def fill_short_shard(batches: DataFrame, shard_col: str = "shard", batch_col: str = "batch") -> DataFrame:
    """Every shard gets as many batches as the longest; a short shard repeats its first
    batch for each missing slot (``filled`` marks the copies)."""
    per = batches.groupBy(shard_col).agg(F.countDistinct(batch_col).alias("_nb"))
    mx = per.agg(F.max("_nb").alias("_mx"))
    missing = per.crossJoin(F.broadcast(mx)).withColumn("_miss", F.col("_mx") - F.col("_nb")).filter("_miss > 0")
    least = batches.groupBy(shard_col).agg(F.min(batch_col).alias(batch_col))      # one row per shard
    first = batches.join(least, [shard_col, batch_col], "left_semi")
    copies = (first.join(missing.select(shard_col, "_nb", "_miss"), shard_col)
              .withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_miss").cast("long") - 1)))
              .withColumn(batch_col, (F.col("_nb") + F.col("_c")).cast(batches.schema[batch_col].dataType))
              .drop("_nb", "_miss", "_c").withColumn("filled", F.lit(True)))
    return batches.withColumn("filled", F.lit(False)).unionByName(copies)


def group_ranked(ranking: DataFrame, k: int | None = None, key: str = "qid", rank: str = "rank",
                 fields: Sequence[str] = ("pid", "score"), out: str = "items") -> DataFrame:
    """Grouped form of a ranking, ``items`` = array of ``struct(rank, *fields)`` in rank order.

    Every row of a key is grouped; with ``k`` only its top ``k``, which bounds the arrays."""
    top = ranking if k is None else ranking.filter(F.col(rank) <= k)
    return top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(rank), *[F.col(f) for f in fields])))
                                .alias(out))


def check_pregrouped(df: DataFrame, key: str, order: str) -> DataFrame:
    """A21 (strict form): keys that come back after another key in ``order`` (input not grouped): their
    first and last place are further apart than their rows."""
    idx = zip_index(df.select(key, order), [order], "_i")
    pos = idx.groupBy(key).agg(F.min("_i").alias("_a"), F.max("_i").alias("_b"), F.count(F.lit(1)).alias("_m"))
    return pos.filter(F.col("_b") - F.col("_a") + 1 != F.col("_m")).select(key)
