"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_dir

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column with null read as the empty text; a missing column reads as null."""
    if name not in df.columns:
        return F.lit("")
    return F.coalesce(df[name].cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words (runs without white space) of a text, in order; empty for a blank text."""
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words of a text, as long."""
    return F.size(words_of(text)).cast("long")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a thin table once, in the shared folder that ``spark.checkpoint.dir`` names."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_round(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for a table that the next round of a loop joins again: written as files, so its size is that of the files.

    A checkpoint keeps the size that the optimiser estimated for its plan, a product for each join. In a loop the digits of
    that number multiply with each round, and after some ten rounds the number alone fills the driver.
    """
    path = scratch_dir(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bind(value: Column, body) -> Column:
    """``body(x)`` with ``x`` computed once per row.

    Spark inlines a column that is used inside a lambda into each element evaluation; binding it as
    the variable of an outer one-element array evaluates it a single time.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``max_bytes`` bytes in each (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string array; null rows are empty. Offsets start at 0."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64; the first half million are kept for the next call."""
    size = max(n, 1 << 19)
    if len(_POWERS[0]) < n:
        made = []
        for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if size > 1 << 19:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64: its constants are fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEPARATES = np.zeros(256, bool)
_SEPARATES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def hash_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, documents)``: the 64-bit hash of each word in the buffer and the text it stands in.

    Words are runs without white space; equal bytes give equal hashes. All texts at once: a word's hash is the
    difference of two prefix sums of a polynomial, shifted back to the word's start.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SEPARATES[raw]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    heads = offsets[:-1]
    before[heads[heads < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    tails = offsets[1:]
    after[tails[tails > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(offsets, starts, side="right") - 1
