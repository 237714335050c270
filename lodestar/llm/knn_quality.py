"""Quality classifier: similarity-weighted votes of the nearest labelled documents.

A document is a vector of term weights (log counts times IDF) over three blocks: trigrams of
character classes (letters of one case, digits, blanks, each punctuation mark), hashed words, and
words repeated at a distance of one to eight words. Latent-semantic vectors are its coordinates on the
leading singular directions of a sample of labelled documents, scaled to length 1.

Fitting: IDF is counted over all documents. The labelled sample is bounded by ``sample`` rows (those
with the smallest hash of ``doc_id`` among the rows that may be learnt from), and so are the
directions and the labelled vectors that are sent to the tasks: ``sample * rank`` floats.

Scoring: every document's cosine with every labelled vector is worked out exactly, one block of
documents at a time; the ``neighbours`` most similar ones vote with their label, weighted by a power
of their cosine. ``prior`` votes of the sample's mean keep documents without close neighbours
near it; a text without terms has the mean itself.

Defined cases: null and blank texts score the sample's mean; texts of any length are read whole;
equal texts have equal scores, whatever their batch (cosines are exact on a grid of 2 ** -19); of label vectors
at equal cosines the one of the lowest ``doc_id`` counts; without labelled rows every score is 0.5; repeated
labels of a document count once (the highest), as do rows that repeat a labelled id (the least counts); an
empty table gives an empty result; ``lang``, ``source``, ``doc_id`` and other columns are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_words, mix64, small_batches, text_of, utf8_buffer

CLASS_TERMS, WORD_TERMS, REPEATS = 704, 312, 8
TERMS = CLASS_TERMS + WORD_TERMS + REPEATS
SAMPLE, RANK, NEIGHBOURS, POWER, PRIOR = 5000, 64, 15, 8, 0.02
#: Steps of a vector's unit; ``GRID ** 2`` times the label vectors (``sample``) must stay below 2 ** 53.
GRID = 1 << 19
#: Weight of each block in a document's vector.
BLOCK_WEIGHTS = (1.0, 0.35, 0.7)


def _classes() -> np.ndarray:
    """Class of each byte: lower-case or other letter 0, upper-case 1, digit 2, blank 3, line end 4, control 5, marks 6 on."""
    out = np.zeros(256, np.uint32)
    mark = 6
    for b in range(128):
        if 65 <= b <= 90:
            out[b] = 1
        elif 48 <= b <= 57:
            out[b] = 2
        elif b in (32, 9):
            out[b] = 3
        elif b in (10, 13):
            out[b] = 4
        elif b < 32 or b == 127:
            out[b] = 5
        elif not 97 <= b <= 122:
            out[b] = mark
            mark += 1
    return out


_CLASS = _classes()
_WIDTH = np.uint32(_CLASS.max() + 1)


def term_counts(column: pa.Array) -> np.ndarray:
    """Counts of all terms of each text: an array of documents by ``TERMS``."""
    raw, offsets = utf8_buffer(column)
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    c = _CLASS[raw]
    if len(c) > 2:
        code = (c[:-2] * _WIDTH + c[1:-1]) * _WIDTH + c[2:]
        same = owner[:-2] == owner[2:]
        term = mix64(code[same].astype(np.uint64)) % np.uint64(CLASS_TERMS)
        flat = owner[:-2][same] * CLASS_TERMS + term.astype(np.int64)
        out[:, :CLASS_TERMS] = np.bincount(flat, minlength=n * CLASS_TERMS).reshape(n, CLASS_TERMS)
    words, doc = hash_words(raw, offsets)
    flat = doc * WORD_TERMS + ((words >> np.uint64(20)) % np.uint64(WORD_TERMS)).astype(np.int64)
    out[:, CLASS_TERMS:CLASS_TERMS + WORD_TERMS] = np.bincount(flat, minlength=n * WORD_TERMS).reshape(n, WORD_TERMS)
    for k in range(1, REPEATS + 1):
        if len(words) > k:
            again = (words[k:] == words[:-k]) & (doc[k:] == doc[:-k])
            out[:, -k] = np.bincount(doc[k:][again], minlength=n)
    return out


def term_weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of the blocks: trigrams and words as unit vectors, repeats as shares of the words."""
    words = counts[:, CLASS_TERMS:CLASS_TERMS + WORD_TERMS].sum(1, keepdims=True)
    tf = np.log1p(counts) * idf
    parts = []
    for block, weight in zip(np.split(tf[:, :CLASS_TERMS + WORD_TERMS], [CLASS_TERMS], axis=1), BLOCK_WEIGHTS):
        norm = np.linalg.norm(block, axis=1, keepdims=True)
        parts.append(block * (weight / np.maximum(norm, 1e-12)))
    share = counts[:, CLASS_TERMS + WORD_TERMS:] / np.maximum(words, 1)
    parts.append((np.sqrt(share) * BLOCK_WEIGHTS[2]).astype(np.float32))
    return np.concatenate(parts, axis=1).astype(np.float32)


def _count_df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, rows = np.zeros(TERMS, np.int64), 0
    for batch in small_batches(batches, "text", 1 << 20):
        df += (term_counts(batch.column("text")) > 0).sum(0)
        rows += batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(np.append(df, rows))], names=["term", "df"])


def term_idf(texts: DataFrame) -> np.ndarray:
    """IDF of each term over all rows; ``TERMS + 1`` sums whatever the size of the table."""
    got = texts.select("text").mapInArrow(_count_df, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(TERMS + 1)
    for r in got:
        df[r["term"]] = r["df"]
    return (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)


class Model:
    """Directions, labelled vectors and their labels; bounded by the sample and the rank."""

    def __init__(self, idf: np.ndarray, counts: np.ndarray, labels: np.ndarray, rank: int = RANK):
        self.idf, self.labels = idf, labels.astype(np.float32)
        self.mean = float(labels.mean()) if len(labels) else 0.5
        self.axes = np.zeros((TERMS, 0), np.float32)
        self.vectors = np.zeros((0, 0), np.float32)
        if len(labels):
            weights = term_weights(counts, idf)
            _, axes = np.linalg.eigh((weights.T @ weights).astype(np.float64))
            self.axes = np.ascontiguousarray(axes[:, ::-1][:, :rank])
            self.vectors = self.embed(counts)

    def embed(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors rounded to multiples of ``1 / GRID``: their products are exact in any order of summation, so a
        text's cosines do not change with the block it stands in."""
        found = np.empty((len(counts), self.axes.shape[1]))
        for lo in range(0, len(counts), 256):
            found[lo:lo + 256] = term_weights(counts[lo:lo + 256], self.idf).astype(np.float64) @ self.axes
        return np.rint(found * (GRID / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12))) / GRID

    def score(self, column: pa.Array, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Score of each text: blocks of exact cosines with all labelled vectors."""
        counts = term_counts(column)
        blank = counts[:, CLASS_TERMS:].sum(1) == 0
        if not len(self.labels):
            return np.full(len(counts), self.mean)
        vectors, out = self.embed(counts), np.empty(len(counts))
        for lo in range(0, len(vectors), 256):
            near = vectors[lo:lo + 256] @ self.vectors.T
            m = near.shape[1]
            k = min(neighbours, m)
            # the nearest; of equally near ones the earlier label vectors (by doc_id)
            best = np.sort(np.argpartition(near * (GRID ** 2 * m) - np.arange(m), m - k, axis=1)[:, -k:], axis=1)
            weight = np.maximum(np.take_along_axis(near, best, axis=1), 0) ** POWER
            out[lo:lo + 256] = ((weight * self.labels[best]).sum(1) + PRIOR * self.mean) / (weight.sum(1) + PRIOR)
        out[blank] = self.mean
        return np.clip(out, 0.0, 1.0)


def fit(texts: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK) -> Model:
    """A model from ``texts(doc_id, text)`` and ``labels(doc_id, label)``; only ``labels`` rows are learnt from."""
    texts = texts.select(texts["doc_id"].cast("long").alias("doc_id"), text_of(texts).alias("text"))
    own = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most ``sample`` rows of two numbers
    rows = texts.join(F.broadcast(chosen), "doc_id")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            packed = []
            for row in term_counts(batch.column("text")):
                at = np.flatnonzero(row)
                packed.append(at.astype(np.uint16).tobytes() + row[at].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label").cast(pa.float64()), pa.array(packed, pa.binary())],
                                             names=["doc_id", "label", "packed"])

    # rows that repeat an id are one before they reach the driver: at most ``sample`` rows
    once = (rows.select("doc_id", "label", "text").mapInArrow(sparse, "doc_id long, label double, packed binary")
            .groupBy("doc_id").agg(F.max("label").alias("label"), F.min("packed").alias("packed")))
    got = once.toArrow().sort_by("doc_id")
    counts = np.zeros((got.num_rows, TERMS), np.float32)
    packed = got.column("packed").to_pylist()
    for i, row in enumerate(packed):
        n = len(row) // 6
        counts[i, np.frombuffer(row[:2 * n], np.uint16)] = np.frombuffer(row[2 * n:], np.float32)
    return Model(term_idf(texts), counts, got.column("label").to_numpy(), rank)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id's text has remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``; ``labels(doc_id, label)``."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    model = fit(texts, labels.where(~held_out(F.col("doc_id"))), **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(batch.column("text")))], names=["doc_id", "score"])

    return (texts.mapInArrow(run, "doc_id long, score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")))
