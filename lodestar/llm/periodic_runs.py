"""Periodic runs of words ("a b a b a b a b"), found by branching tandem repeats in an enhanced suffix array.

A run is a stretch of words with smallest period ``q`` that holds ``POWER`` periods and ``LEAST`` words
at least and that no neighbouring word extends. All texts of a batch are worked on at once:

1. *Suffix array.* Words are numbered in their text; prefix doubling sorts the suffixes of all texts, each round
   only those that are not told apart yet. The ranks of each round are kept: equal ranks in round
   ``r`` mean ``2 ** r`` equal words, so the common prefix of any two suffixes takes one step a round.
   A word that stands fewer than ``POWER`` times in its text is in no run and counts as a symbol of its own.
2. *LCP intervals.* Each LCP value splits its interval (bounded by the previous value that is not
   greater and the next smaller one) in two; there is no tree. For every suffix ``i`` of the smaller
   part, with the interval's depth ``d``, the inverse suffix array tells whether ``i + d`` or ``i - d`` lies in the
   other part: then the two share exactly ``d`` words, and the square of two ``d``-word halves ends where
   its period breaks (a branching tandem repeat). Smaller parts have ``n log n`` suffixes in all.
3. *Runs.* Each run ends with exactly one branching square of its period. It is rotated to the left as
   long as words one period apart are equal. Squares of a multiple of the period end in the same place
   and lie inside that run, which tells them.

Scale: rows are independent, there is no shuffle; a task holds a batch of about 2 MB of text (one text at
least) with about ``log2`` of its longest repeat rank arrays.

Defined cases: null, empty and blank texts have no words, no runs and the empty collapsed text; very long
texts are worked on whole; equal exponents are ordered by start, then period; repeated rows are repeated
in the result; a null ``doc_id`` stays null; an empty table gives an empty result; columns other
than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of, words_of

POWER = 4
LEAST = 6
#: Suffixes of smaller parts that are tested in one go.
CHUNK = 1 << 20
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class SuffixRanks:
    """Suffix array of several texts' words, with the ranks of each round of prefix doubling."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, ends: np.ndarray):
        n = len(ids)
        _, symbol, count = np.unique(doc * (int(ids.max()) + 1) + ids, return_inverse=True, return_counts=True)
        order = np.argsort(symbol, kind="stable")
        head = np.ones(n, bool)
        head[1:] = (symbol[order][1:] != symbol[order][:-1]) | (count[symbol[order]][1:] < POWER)
        rank = np.empty(n + 1, np.int32)
        rank[n] = -1
        self.levels = []
        slots, width = np.arange(n), 1
        rank[order] = np.maximum.accumulate(np.where(head, slots, 0))
        # slots of groups that hold more than one suffix
        slots = slots[~(head & np.append(head[1:], True))]
        self.first = slots
        while True:
            self.levels.append(rank.copy())
            if not len(slots):
                break
            at = order[slots]
            after = at + width
            follow = np.where(after < ends[at], rank[np.minimum(after, n)], -1).astype(np.int64)
            key = rank[at].astype(np.int64) * (n + 2) + follow + 1
            by = np.argsort(key, kind="stable")
            key, at = key[by], at[by]
            order[slots] = at
            head = np.ones(len(slots), bool)
            head[1:] = key[1:] != key[:-1]
            rank[at] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
            slots = slots[~(head & np.append(head[1:], True))]
            width *= 2
        self.suffixes = order[self.first]

    def common_prefix(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from positions ``i`` and ``j`` (different ones of any texts) on."""
        shared = np.zeros(len(i), np.int64)
        for r in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[r]
            shared += (rank[i + shared] == rank[j + shared]).astype(np.int64) << r
        return shared


def branching_squares(ranks: SuffixRanks) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, halves)`` of the squares whose period breaks right behind them."""
    suffix = ranks.suffixes
    n = len(suffix)
    words = ranks.levels[0]
    lcp = np.zeros(n + 1, np.int64)
    same = np.flatnonzero(words[suffix[1:]] == words[suffix[:-1]]) + 1
    lcp[same] = ranks.common_prefix(suffix[same - 1], suffix[same])
    place = np.full(len(words), -1, np.int64)
    place[suffix] = np.arange(n)
    before, behind, open_ = [0] * (n + 1), [0] * (n + 1), []
    depths = lcp.tolist()
    for p, depth in enumerate(depths):
        while open_ and depths[open_[-1]] > depth:
            behind[open_.pop()] = p
        if depth:
            before[p] = open_[-1] if open_ else p
            open_.append(p)
        else:
            open_ = [p]
    split = np.flatnonzero(lcp)
    low, high = np.array(before)[split], np.array(behind)[split]
    left = split - low <= high - split
    start, size = np.where(left, low, split), np.where(left, split - low, high - split)
    other, until = np.where(left, split, low), np.where(left, high, split)
    depth = lcp[split]
    found = []
    total = np.cumsum(size)
    at = 0
    while at < len(split):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, side="right")))
        count = size[at:stop]
        part = np.repeat(np.arange(at, stop), count)
        x = suffix[start[part] + np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count)]
        for shift in (1, -1):
            y = x + shift * depth[part]
            inside = (y >= 0) & (y < len(place) - 1)
            there = place[np.where(inside, y, 0)]
            hit = inside & (there >= other[part]) & (there < until[part])
            found.append(np.stack([np.minimum(x[hit], y[hit]), depth[part[hit]]]))
        at = stop
    return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def find_runs(ids: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of all texts; starts count from the first word of the first text."""
    if not len(ids):
        return []
    ends = np.repeat(np.cumsum(lengths), lengths)
    ranks = SuffixRanks(ids, np.repeat(np.arange(len(lengths)), lengths), ends)
    if not len(ranks.suffixes):
        return []
    start, half = branching_squares(ranks)
    # a run of POWER periods reaches POWER - 2 periods to the left of its last square
    first = start - (POWER - 2) * half
    keep = np.flatnonzero(first >= 0)
    keep = keep[ranks.common_prefix(first[keep], first[keep] + half[keep]) >= (POWER - 1) * half[keep]]
    keep = keep[np.lexsort((start[keep], half[keep]))]
    words, known, runs = ranks.levels[0], defaultdict(list), []
    for at, q in zip(start[keep].tolist(), half[keep].tolist()):
        end = at + 2 * q
        if any(s <= at for s in known[end]):
            continue  # the period is a multiple of that run's period
        s, step = at, 64
        while s > 0:
            low = max(0, s - step)
            breaks = np.flatnonzero(words[low:s] != words[low + q:s + q])
            if len(breaks):
                s = low + int(breaks[-1]) + 1
                break
            s, step = low, step * 2
        known[end].append(s)
        if end - s >= LEAST:
            runs.append((s, end - s, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        numbers: dict[bytes, int] = {}
        texts = [t.as_buffer().to_pybytes().split() for t in batch.column("text").cast(pa.large_binary())]
        lengths = np.array([len(t) for t in texts], np.int64)
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, int(lengths.sum()))
        bases = np.cumsum(lengths) - lengths
        told: list[list] = [[] for _ in texts]
        runs = find_runs(ids, lengths)
        for (s, length, q), d in zip(runs, np.searchsorted(bases, [r[0] for r in runs], side="right") - 1):
            told[d].append((s - int(bases[d]), length, q))
        collapsed = []
        for words, mine in zip(texts, told):
            if mine:
                deep = np.zeros(len(words) + 1, np.int64)
                for s, length, q in mine:
                    deep[s + q] += 1
                    deep[s + length] -= 1
                dropped = np.cumsum(deep)[:-1] > 0
                words = [w for w, gone in zip(words, dropped.tolist()) if not gone]
            collapsed.append(b" ".join(words))
        rows = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in mine] for mine in told], pa.list_(_RUN))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows, pa.array(collapsed, pa.binary()).cast(pa.string())],
                                         names=["doc_id", "runs", "collapsed"])


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, runs, collapsed``: the runs of each text by start and period, and the text with each run cut to
    its first period (a word goes if any run holds it behind that run's first period), words a blank apart."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(_scan, _SCHEMA)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where a tenth of the texts (by a hash of the id) repeat a stretch of words to their end."""
    words, h = words_of(text_of(docs)), F.crc32(docs["doc_id"].cast("string"))
    seen = docs.select("doc_id", text_of(docs).alias("text"), h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    n, g = F.size("w"), F.floor(F.col("h") / 10).cast("long")
    seen = seen.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")).cast("int"))
    seen = seen.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    stretch = F.slice("w", F.col("a") + 1, F.col("p"))
    rounds = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(stretch, rounds)), F.lit(1), F.col("n") - F.col("a"))
    text = F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")).otherwise(F.col("text"))
    return seen.select("doc_id", text.alias("text"))


def _better(a: Column, b: Column) -> Column:
    """Order of runs: greater exponent first (by exact products), then start, then period."""
    x, y = a["length"] * b["period"], b["length"] * a["period"]
    return (F.when(x != y, F.when(x > y, -1).otherwise(1))
            .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
            .otherwise(F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)))


def digest_runs(found: DataFrame) -> DataFrame:
    """Counts, the run with the greatest exponent, and hashes of all runs and of the collapsed text."""
    best = F.get(F.array_sort("runs", _better), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
                    F.col("best.period").alias("period"), F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
                    F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
