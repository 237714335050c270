"""Sampling, splits and set operators (L*, G*, D16).

Samples are ordered by the md5 of seed and id, so a re-run yields the same rows, no driver-side random
state is involved, and any engine can repeat them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import zip_index


def hash_order(id_col: str, seed: int) -> Column:
    """A seeded order of ids: the md5 of ``seed:id``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def hash_number(id_col: str, seed: int) -> Column:
    """The first 32 bits of :func:`hash_order`, as a number."""
    return F.conv(F.substring(hash_order(id_col, seed), 1, 8), 16, 10).cast("long")


def random_split(df: DataFrame, id_col: str, train_pct: int = 90, seed: int = 0,
                 split_col: str = "split") -> DataFrame:
    """L1: ``train`` when the hash of the id, modulo 100, is below ``train_pct``, else ``dev``."""
    h = hash_number(id_col, seed) % 100
    return df.withColumn(split_col, F.when(h < train_pct, "train").otherwise("dev"))


def five_fold_roles(qids: DataFrame, fold: Column, f: int | Column, n_folds: int = 5) -> DataFrame:
    """L2: for test fold ``f``: folds f, f+1, f+2 train; f+3 dev; f+4 test (mod n_folds)."""
    f = F.lit(f) if isinstance(f, int) else f
    rel = F.pmod(fold - f, F.lit(n_folds))
    role = F.when(rel <= 2, "train").when(rel == 3, "dev").otherwise("test")
    return qids.withColumn("fold", fold.cast("long")).withColumn("role", role)


def sample_size(n: int) -> int:
    """L3: ``min(1 + int(16*sqrt(120*n)), n)`` passages used to train the codec."""
    return min(1 + int(16 * math.sqrt(120 * n)), n)


def sample_size_col(n: Column) -> Column:
    return F.least(1 + F.floor(16 * F.sqrt(120 * n)), n).cast("long")


def hash_sample(df: DataFrame, id_col: str, n: int, seed: int = 123) -> DataFrame:
    """The ``n`` rows that come first in the seeded order (ties by id).

    The hashes are even, so a threshold a little above ``n / rows`` leaves few rows too many; those alone
    are sorted and numbered. No task holds the sample."""
    total = df.count()
    if n >= total:
        return df
    share = (n + 8 * math.sqrt(n) + 64) / total
    near = df.filter(hash_number(id_col, seed) < int(share * (1 << 32))) if share < 1 else df
    if share < 1 and near.count() < n:     # an uneven draw, or ids that repeat
        near = df
    first = zip_index(near.withColumn("_h", hash_order(id_col, seed)), ["_h", id_col], "_i")
    return first.filter(F.col("_i") < n).drop("_h", "_i")


def heldout_split(vectors: DataFrame, id_col: str, seed: int = 0, frac: float = 0.05, cap: int = 50000) -> DataFrame:
    """L4: the first ``min(int(frac*n), cap)`` vectors in hash order are held out (``heldout``)."""
    idx = zip_index(vectors.withColumn("_h", hash_order(id_col, seed)), ["_h", id_col], "_i")
    n = vectors.agg(F.count(F.lit(1)).alias("_n"))
    m = F.least(F.floor(F.col("_n") * frac), F.lit(cap))
    return idx.crossJoin(F.broadcast(n)).withColumn("heldout", F.col("_i") < m).drop("_h", "_i", "_n")


def row_range(df: DataFrame, order_by: Sequence[str], start: int, end: int) -> DataFrame:
    """Rows ``start <= index < end`` in a total order (``zip_index``, no single-task window)."""
    idx = zip_index(df, order_by, "_i")
    return idx.filter((F.col("_i") >= start) & (F.col("_i") < end)).drop("_i")


def union_folds(folds: Sequence[DataFrame]) -> DataFrame:
    """G1: union of query folds (by column name)."""
    out = folds[0]
    for f in folds[1:]:
        out = out.unionByName(f)
    return out


def union_sources(sources: dict[str, DataFrame], id_col: str = "id") -> DataFrame:
    """Union of sources, each id prefixed with its source prefix (idempotent)."""
    out = None
    for prefix, df in sources.items():
        pid = F.col(id_col).cast("string")
        df = df.withColumn(id_col, F.when(pid.startswith(prefix), pid).otherwise(F.concat(F.lit(prefix), pid)))
        out = df if out is None else out.unionByName(df)
    return out


def question_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows present in both."""
    return a.distinct().intersect(b.distinct())


def without_positives(queries: DataFrame, positives: DataFrame, key: str = "qid") -> DataFrame:
    """Queries that have no positive (left anti)."""
    return queries.join(positives.select(key).distinct(), key, "left_anti")


def distinct_first(df: DataFrame, key: Sequence[str], pos: str) -> DataFrame:
    """One row per key, the one with the smallest ``pos`` (first kept)."""
    other = [c for c in df.columns if c not in key]
    agg = df.groupBy(*key).agg(F.min_by(F.struct(*[F.col(c) for c in other]), F.col(pos)).alias("_r"))
    return agg.select(*key, *[F.col(f"_r.{c}").alias(c) for c in other])


def fold_assignment_check(assign: DataFrame, all_queries: DataFrame, key: str = "qid",
                          fold: str = "fold") -> DataFrame:
    """Queries in more than one fold, and queries missing from every fold."""
    multi = assign.groupBy(key).agg(F.countDistinct(fold).alias("_nf")).filter("_nf > 1").agg(
        F.count(F.lit(1)).alias("multi_fold"))
    missing = all_queries.select(key).distinct().join(assign.select(key), key, "left_anti").agg(
        F.count(F.lit(1)).alias("missing"))
    return multi.crossJoin(missing)


def mini_corpus(train_q: DataFrame, dev_q: DataFrame, ranking: DataFrame, factor: int, topk: int,
                maxdev: int, seed: int = 12345) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sample ``min(n, 300*factor)`` train and ``min(n, maxdev, 30*factor)`` dev queries (hash
    order), keep the top-``topk`` pids of each, then number the distinct pids from 0 in pid order.
    Returns (queries with split, mapping old pid -> new pid, ranking restricted and re-numbered)."""
    ntr = 300 * factor
    ndev = min(maxdev, 30 * factor)
    tq = hash_sample(train_q.select("qid"), "qid", ntr, seed).withColumn("split", F.lit("train"))
    dq = hash_sample(dev_q.select("qid"), "qid", ndev, seed).withColumn("split", F.lit("dev"))
    qs = tq.unionByName(dq)
    top = ranking.filter(F.col("rank") <= topk).join(qs.select("qid"), "qid", "left_semi")
    pids = top.select("pid").distinct()
    mapping = zip_index(pids, ["pid"], "new_pid")
    return qs, mapping, top.join(mapping, "pid")
