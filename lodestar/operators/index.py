"""Compressed multi-vector index: codec, codes, residuals, inverted lists, maintenance
(V10-V19, V28, V30-V33).

Layout (all plain DataFrames / Parquet tables):

* ``centroids(code int, centroid array<double>)``: ``2^k x dim``; broadcast while the table is within
  ``MAX_CODEC_BYTES``. Beyond that codes come from the two-level codebook (same codes, see
  :mod:`codebook`) and centroids travel by join on their code.
* ``buckets``: one row ``(cutoffs array<double>, weights array<double>, avg_residual double)``.
* ``codes(pid, tok_pos, code, residual binary)``: one row per token vector; residual is
  ``dim*nbits/8`` bytes.
* ``ivf(code, pid)``: one row per distinct pair (long form; never collected per code).
* ``doclens(pid, doclen)``: a removed passage keeps its pid with doclen 0 (tombstone).
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import l2_normalize

#: Bytes of centroids that may be broadcast; a larger codec works by joins.
MAX_CODEC_BYTES = 256 << 20


@dataclass
class Codec:
    centroids: DataFrame          # code int, centroid array<double>
    buckets: DataFrame            # cutoffs, weights, avg_residual (one row)
    nbits: int
    dim: int

    @property
    def fits(self) -> bool:
        """Whether the centroids may be broadcast."""
        if getattr(self, "_fits", None) is None:
            self._fits = self.centroids.count() * self.dim * 8 <= MAX_CODEC_BYTES
        return self._fits

    def book(self):
        """The two-level codebook over the centroids, built once."""
        if getattr(self, "_book", None) is None:
            from .codebook import build_codebook
            self._book = build_codebook(self.centroids)
        return self._book

    def cuts(self):
        """Cutoffs and weights of the residual buckets."""
        if getattr(self, "_cuts", None) is None:
            b = self.buckets.first()
            self._cuts = (np.asarray(b["cutoffs"], np.float64), np.asarray(b["weights"], np.float64))
        return self._cuts

    def arrays(self):
        """Small driver-side copy of the codec for broadcasting (size checked). Codes must be
        dense ``0..n-1`` (row ``i`` of the matrix is code ``i``)."""
        if getattr(self, "_arr", None) is not None:
            return self._arr
        self._arr = (_centroid_matrix(self.centroids, self.dim), *self.cuts())
        return self._arr

    def broadcast(self, spark: SparkSession):
        """``(centroids, cutoffs, weights)``; no centroids where they are too many to be broadcast."""
        if getattr(self, "_bc", None) is None:
            self._bc = spark.sparkContext.broadcast(self.arrays() if self.fits else (None, *self.cuts()))
        return self._bc


# ---- planning ----------------------------------------------------------------------------------

def plan_partitions(n_embeddings: int) -> int:
    """``2^floor(log2(16*sqrt(n_embeddings)))`` centroids."""
    return int(2 ** math.floor(math.log2(16 * math.sqrt(n_embeddings))))


def plan_partitions_col(n: F.Column) -> F.Column:
    return F.pow(F.lit(2), F.floor(F.log2(16 * F.sqrt(n)))).cast("long")


def avg_doclen(tokens: DataFrame, pid: str = "pid") -> DataFrame:
    """Mean document length (token vectors per passage) and total embeddings."""
    per = tokens.groupBy(pid).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(F.avg("_n").alias("avg_doclen"), F.sum("_n").cast("long").alias("num_embeddings"),
                   F.count(F.lit(1)).cast("long").alias("num_passages"))


# ---- codec training ----------------------------------------------------------------------------

def train_centroids(sample: DataFrame, k: int, iters: int = 4, seed: int = 123, vec: str = "embedding") -> DataFrame:
    """Spherical k-means on the sampled vectors ``(id, embedding)``: ``k`` vectors with the least hashes (of seed and
    id) start, each Lloyd step assigns by the two-level codebook and takes normalised means. Neither the vectors nor
    the centroids pass through the driver, so there is no largest ``k``."""
    from .codebook import lloyd, start_centroids
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(sample.sparkSession)
    rows = sample.select("id", F.col(vec).alias("embedding")).checkpoint()
    return lloyd(rows, start_centroids(rows, k, seed), iters)


def centroids_from_labels(vectors: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Fixed codec for tests: one normalised mean vector per label (code = label, dense 0..n-1).
    One pass: ``Summarizer.mean`` per label (vector aggregate, partial + final)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    feats = vectors.select(label, array_to_vector(F.col(vec).cast("array<double>")).alias("_f"))
    mean = feats.groupBy(label).agg(Summarizer.mean(F.col("_f")).alias("_m"))
    return mean.select(F.col(label).cast("int").alias("code"), l2_normalize(vector_to_array("_m")).alias("centroid"))


def _assign(C: np.ndarray, X: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Largest dot product, first centroid on ties (argmax)."""
    out = np.empty(X.shape[0], np.int32)
    for s in range(0, X.shape[0], step):
        out[s:s + step] = (X[s:s + step] @ C.T).argmax(1)
    return out


def _stack(col: pd.Series, dim: int) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, dim))
    return np.stack([np.asarray(v, np.float64) for v in col.to_numpy()])


def residual_values(vectors: DataFrame, centroids: DataFrame, dim: int, vec: str = "embedding") -> DataFrame:
    """Residual ``x - centroid(code(x))`` per vector: ``(…, code, residual array<double>)``."""
    spark = vectors.sparkSession
    codec = centroids if isinstance(centroids, Codec) else Codec(centroids, None, 0, dim)
    fits = codec.fits
    bc = spark.sparkContext.broadcast(_centroid_matrix(codec.centroids, dim) if fits else None)
    keys = [c for c in vectors.columns if c != vec]
    schema = T.StructType([vectors.schema[c] for c in keys] + [T.StructField("code", T.IntegerType()),
                          T.StructField("residual", T.ArrayType(T.DoubleType()))])

    def kernel(it):
        Cm = bc.value
        for p in it:
            X = _stack(p[vec], dim)
            codes = _assign(Cm, X) if fits else p["code"].to_numpy()
            R = X - (Cm[codes] if fits else _stack(p["centroid"], dim)) if len(X) else X
            out = p[keys].copy()
            out["code"] = codes
            out["residual"] = list(R)
            yield out

    from .vectors import spread_scan
    return (spread_scan(vectors) if fits else _coded(vectors, codec, vec)).mapInPandas(kernel, schema)


def _coded(vectors: DataFrame, codec: Codec, vec: str) -> DataFrame:
    """``vectors`` with the ``code`` and ``centroid`` of each row, by the two-level codebook."""
    from ..session import ensure_checkpoint_dir
    from .codebook import nearest_codes
    ensure_checkpoint_dir(vectors.sparkSession)
    rows = vectors.withColumn("_row", F.monotonically_increasing_id()).checkpoint()    # written, so numbers stay
    codes = nearest_codes(rows.select(F.col("_row").alias("id"), F.col(vec).cast("array<double>").alias("embedding")), codec.book())
    return rows.join(codes.select(F.col("id").alias("_row"), "code"), "_row").drop("_row").join(codec.centroids.select("code", "centroid"), "code")


def residual_stats(residuals: DataFrame) -> DataFrame:
    """Mean absolute residual per dimension, and overall (``avg_residual``)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    sizes = residuals.select(array_to_vector(F.transform("residual", lambda x: F.abs(x))).alias("v"))
    mean = sizes.agg(Summarizer.mean(F.col("v")).alias("m"))     # one vector, whatever the number of rows
    return mean.select(F.posexplode(vector_to_array("m")).alias("dim", "avg_abs"))


#: Bins that a counting pass cuts a range into, and values that may be gathered once ranges are narrow.
RANGE_BINS, RANGE_VALUES = 1 << 10, 1 << 16


def _in_ranges(p: pd.DataFrame, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a batch that lie in one of the disjoint ranges, with the number of the range."""
    x = np.concatenate([np.zeros(0), *p.iloc[:, 0]])
    at = np.searchsorted(lo, x, side="right") - 1
    ok = (at >= 0) & (x <= hi[np.maximum(at, 0)])
    return x[ok], at[ok]


def _count_bins(rows: DataFrame, lo: np.ndarray, hi: np.ndarray) -> pd.DataFrame:
    """One pass over the values: ``(slot, n, least, most)`` of each filled bin of each range, added up in every task
    before anything is shuffled. ``slot`` is ``range * RANGE_BINS + bin``."""
    slots = len(lo) * RANGE_BINS

    def kernel(it):
        n, least, most = np.zeros(slots, np.int64), np.full(slots, np.inf), np.full(slots, -np.inf)
        for p in it:
            x, at = _in_ranges(p, lo, hi)
            part = (x - lo[at]) / np.maximum(hi[at] - lo[at], np.finfo(np.float64).tiny) * RANGE_BINS
            slot = at * RANGE_BINS + np.minimum(part.astype(np.int64), RANGE_BINS - 1)
            n += np.bincount(slot, minlength=slots)
            np.minimum.at(least, slot, x)
            np.maximum.at(most, slot, x)
        filled = np.flatnonzero(n)
        yield pd.DataFrame({"slot": filled, "n": n[filled], "least": least[filled], "most": most[filled]})

    counts = rows.mapInPandas(kernel, "slot long, n long, least double, most double")
    return counts.groupBy("slot").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")) \
        .toPandas().sort_values("slot", ignore_index=True)       # ranges x RANGE_BINS rows at most


def _order_statistics(rows: DataFrame, places: list[int], least: float, most: float) -> dict[int, float]:
    """The values at the given 0-based ``places`` of the sorted values. Every pass counts the values in bins of the ranges
    that still hold a wanted place and narrows each place to its bin (from the least to the largest value in it). Ranges of one
    value are done; when those left hold few values, these are read. Values are never sorted or exchanged."""
    found: dict[int, float] = {}
    open_ranges = {(least, most): [(p, p) for p in places]}       # place, place inside the range
    held = None
    while open_ranges:
        for lo, hi in [r for r in open_ranges if r[0] == r[1]]:
            found.update((p, lo) for p, _ in open_ranges.pop((lo, hi)))
        if not open_ranges:
            break
        ranges = sorted(open_ranges)
        lo, hi = np.array([r[0] for r in ranges]), np.array([r[1] for r in ranges])
        if held is not None and sum(held[r] for r in ranges) <= RANGE_VALUES:
            def kernel(it, lo=lo, hi=hi):
                for p in it:
                    yield pd.DataFrame({"x": _in_ranges(p, lo, hi)[0]})

            x = np.sort(rows.mapInPandas(kernel, "x double").toPandas()["x"].to_numpy())
            for r in ranges:
                own = x[np.searchsorted(x, r[0], side="left"):]
                found.update((p, float(own[i])) for p, i in open_ranges[r])
            break
        bins = _count_bins(rows, lo, hi)
        narrower: dict[tuple[float, float], list[tuple[int, int]]] = {}
        held = {}
        for k, r in enumerate(ranges):
            own = bins[bins["slot"] // RANGE_BINS == k]
            ends = own["n"].cumsum().to_numpy()
            for p, i in open_ranges[r]:
                b = int(np.searchsorted(ends, i, side="right"))
                bin_ = own.iloc[b]
                new = (float(bin_["least"]), float(bin_["most"]))
                held[new] = int(bin_["n"])
                narrower.setdefault(new, []).append((p, i - int(ends[b] - bin_["n"])))
        open_ranges = narrower
    return found


def _quantiles(rows: DataFrame, shares: list[float]) -> list[float]:
    """Exact linear quantiles of all values of an array column: the values at the places they lie between."""
    told = rows.select(F.col(rows.columns[0]).alias("r")).agg(
        F.sum(F.size("r")).alias("n"), F.min(F.array_min("r")).alias("least"), F.max(F.array_max("r")).alias("most")).first()
    if not told["n"]:
        raise ValueError("quantiles need at least one value")
    places = [x * (told["n"] - 1) for x in shares]
    need = sorted({int(math.floor(p)) for p in places} | {int(math.ceil(p)) for p in places})
    at = _order_statistics(rows, need, told["least"], told["most"])
    return [at[math.floor(p)] * (1 - (p - math.floor(p))) + at[math.ceil(p)] * (p - math.floor(p)) for p in places]


def bucket_table(residuals: DataFrame, nbits: int, approx: bool = False, accuracy: int = 100000) -> DataFrame:
    """cutoffs = quantiles ``i/2^n`` (i >= 1), weights = quantiles ``(i+0.5)/2^n`` over all
    residual values. Exact linear quantiles by default, by counting passes over ever narrower ranges round the
    places they need (two per quantile), without a sort; ``approx`` switches to ``percentile_approx``."""
    m = 2 ** nbits
    cuts = [i / m for i in range(1, m)]
    wts = [(i + 0.5) / m for i in range(m)]
    qs = cuts + wts                      # one aggregate for all quantiles
    stats = residual_stats(residuals).agg(F.avg("avg_abs").alias("avg_residual"))
    if approx:
        q = residuals.select(F.explode("residual").alias("r")).agg(F.percentile_approx("r", qs, accuracy).cast("array<double>").alias("_q"))
    else:
        q = residuals.sparkSession.createDataFrame([(_quantiles(residuals.select("residual"), qs),)], "_q array<double>")
    return q.select(F.slice("_q", 1, len(cuts)).alias("cutoffs"), F.slice("_q", len(cuts) + 1, len(wts)).alias("weights")) \
        .crossJoin(stats)


def _local_codec(spark: SparkSession, C: np.ndarray, bk, nbits: int, dim: int) -> Codec:
    cent = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(C)], "code int, centroid array<double>")
    out = Codec(cent, _bucket_row(spark, bk), nbits, dim)
    out._fits, out._arr = True, (C, np.asarray(bk["cutoffs"], np.float64), np.asarray(bk["weights"], np.float64))
    return out


def _bucket_row(spark: SparkSession, bk) -> DataFrame:
    row = ([float(x) for x in bk["cutoffs"]], [float(x) for x in bk["weights"]], float(bk["avg_residual"]))
    return spark.createDataFrame([row], "cutoffs array<double>, weights array<double>, avg_residual double")


def train_codec(heldout: DataFrame, centroids: DataFrame, nbits: int, dim: int, vec: str = "embedding") -> Codec:
    """Codec from fixed or trained centroids: residual buckets over the held-out vectors (L4 bounds them
    to 50,000; see :func:`train_index`)."""
    spark = centroids.sparkSession
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    codec = Codec(centroids.select("code", "centroid").checkpoint(), None, nbits, dim)
    res = residual_values(heldout.select(vec), codec, dim, vec).persist()
    try:
        bk = bucket_table(res, nbits).first()
    finally:
        res.unpersist()
    if codec.fits:
        return _local_codec(spark, _centroid_matrix(codec.centroids, dim), bk, nbits, dim)
    codec.buckets = _bucket_row(spark, bk)
    return codec


def _centroid_matrix(centroids: DataFrame, dim: int) -> np.ndarray:
    """Bounded read of the centroids: at most ``MAX_CODEC_BYTES`` worth of rows (+1 to detect
    overflow) ever reach the driver, in one job."""
    max_rows = MAX_CODEC_BYTES // max(1, dim * 8)
    pdf = centroids.orderBy("code").limit(max_rows + 1).toPandas()
    if len(pdf) > max_rows:
        raise ValueError("centroid matrix exceeds the broadcast bound")
    return _stack(pdf["centroid"], dim)


# ---- compression -------------------------------------------------------------------------------

def _bucketize(R: np.ndarray, cutoffs: np.ndarray) -> np.ndarray:
    """Number of cutoffs strictly below each value."""
    return np.searchsorted(cutoffs, R, side="left").astype(np.int32)


def _pack(buckets: np.ndarray, nbits: int) -> np.ndarray:
    """Bits of each bucket low bit first, packed 8 per byte high bit first (``np.packbits``)."""
    bits = (buckets[..., None] >> np.arange(nbits)) & 1          # (n, dim, nbits)
    flat = bits.reshape(buckets.shape[0], -1).astype(np.uint8)
    return np.packbits(flat, axis=1)


def _unpack(packed: np.ndarray, dim: int, nbits: int) -> np.ndarray:
    bits = np.unpackbits(packed, axis=1)[:, :dim * nbits].reshape(packed.shape[0], dim, nbits)
    return (bits.astype(np.int32) << np.arange(nbits)).sum(-1)


def compress(tokens: DataFrame, codec: Codec, vec: str = "embedding", with_buckets: bool = False) -> DataFrame:
    """V17 = V12 + residual + V15 + V16 in one ``mapInPandas`` pass with the broadcast codec:
    ``(…keys, code int, residual binary[, buckets array<int>])``."""
    if codec.dim % (8 * codec.nbits) and codec.dim % 8:
        raise ValueError("dim must be a multiple of 8")
    spark = tokens.sparkSession
    bc = codec.broadcast(spark)
    keys = [c for c in tokens.columns if c != vec]
    fields = [tokens.schema[c] for c in keys] + [T.StructField("code", T.IntegerType()),
                                                  T.StructField("residual", T.BinaryType())]
    if with_buckets:
        fields.append(T.StructField("buckets", T.ArrayType(T.IntegerType())))
    nbits, dim, fits = codec.nbits, codec.dim, codec.fits

    def kernel(it):
        C, cutoffs, _ = bc.value
        for p in it:
            X = _stack(p[vec], dim)
            codes = _assign(C, X) if fits else p["code"].to_numpy()
            b = _bucketize(X - (C[codes] if fits else _stack(p["centroid"], dim)), cutoffs) if len(X) else np.zeros((0, dim), np.int32)
            packed = _pack(b, nbits) if len(X) else np.zeros((0, dim * nbits // 8), np.uint8)
            out = p[keys].copy()
            out["code"] = codes
            out["residual"] = [bytes(r) for r in packed]
            if with_buckets:
                out["buckets"] = list(b)
            yield out

    from .vectors import spread_scan
    return (spread_scan(tokens) if fits else _coded(tokens, codec, vec)).mapInPandas(kernel, T.StructType(fields))


def decompress(codes: DataFrame, codec: Codec, out: str = "embedding") -> DataFrame:
    """``centroid[code] + weights[bucket]`` per dimension, L2-normalised (numpy per batch)."""
    spark = codes.sparkSession
    bc = codec.broadcast(spark)
    keys = [c for c in codes.columns if c not in ("code", "residual", "buckets")]
    schema = T.StructType([codes.schema[c] for c in keys] + [T.StructField(out, T.ArrayType(T.DoubleType()))])
    nbits, dim, fits = codec.nbits, codec.dim, codec.fits

    def kernel(it):
        C, _, weights = bc.value
        for p in it:
            if len(p) == 0:
                continue
            packed = np.stack([np.frombuffer(bytes(r), np.uint8) for r in p["residual"]])
            b = _unpack(packed, dim, nbits)
            V = (C[p["code"].to_numpy()] if fits else _stack(p["centroid"], dim)) + weights[b]
            n = np.linalg.norm(V, axis=1, keepdims=True)
            V = np.where(n > 0, V / np.where(n > 0, n, 1), 0.0)
            o = p[keys].copy()
            o[out] = list(V)
            yield o

    rows = codes.select(*keys, "code", "residual")
    if not fits:
        rows = rows.join(codec.centroids.select("code", "centroid"), "code")
    return rows.mapInPandas(kernel, schema)


def build_inverted_lists(codes: DataFrame, centroids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``ivf(code, pid)`` distinct pairs, and list length per code including empty codes."""
    ivf = codes.select("code", "pid").distinct()
    lengths = centroids.select("code").join(ivf.groupBy("code").agg(F.count(F.lit(1)).alias("n")), "code", "left") \
        .select("code", F.coalesce("n", F.lit(0)).cast("long").alias("length"))
    return ivf, lengths


def lists_from_embeddings(lists: DataFrame, doclens_df: DataFrame) -> DataFrame:
    """Old inverted lists ``(code, emb_id)``, embedding ids counted through all passages in pid order, as
    ``(code, pid)`` lists: a running sum of the passage lengths, then a range join."""
    from .ranking import running_offsets
    from .weak import chunk_of_pid
    spans = running_offsets(doclens_df, "doclen", ["pid"], offset_col="offset")
    spans = spans.select(F.col("pid").alias("chunk"), "offset", F.col("doclen").alias("n"))
    return chunk_of_pid(lists, spans, "emb_id").select("code", F.col("chunk").alias("pid")).distinct()


def doclens(codes: DataFrame) -> DataFrame:
    return codes.groupBy("pid").agg(F.count(F.lit(1)).cast("long").alias("doclen"))


@dataclass
class Index:
    codec: Codec
    codes: DataFrame      # pid, tok_pos, code, residual
    ivf: DataFrame        # code, pid
    doclens: DataFrame    # pid, doclen
    pid_codes: DataFrame | None = None   # pid, codes (distinct codes of the passage), built with the index


def build_index(tokens: DataFrame, codec: Codec, vec: str = "embedding", materialize: bool = True) -> Index:
    """Encode (already-embedded) token vectors into an index: compress, lists, doclens.
    The codes table is checkpointed (written to the shared checkpoint folder) so the lists,
    doclens and every later search read it instead of re-running compression."""
    codes = compress(tokens.select("pid", "tok_pos", vec), codec, vec)
    if materialize:
        from ..session import ensure_checkpoint_dir
        ensure_checkpoint_dir(codes.sparkSession)
        cached = codes.persist()
        codes = cached.checkpoint()   # reliable copy in spark.checkpoint.dir; lineage cut
        cached.unpersist()
    ivf, _ = build_inverted_lists(codes, codec.centroids)
    pid_codes = codes.groupBy("pid").agg(F.array_distinct(F.collect_list("code")).alias("codes"))
    if materialize:
        pid_codes, ivf = pid_codes.checkpoint(), ivf.checkpoint()   # what every search reads
    return Index(codec, codes, ivf, doclens(codes), pid_codes)


def train_index(tokens: DataFrame, nbits: int = 2, vec: str = "embedding", iters: int = 4, seed: int = 123) -> Index:
    """The whole path from token vectors ``(pid, tok_pos, embedding)`` to a searchable index: sample of passages (L3),
    number of centroids (V10), held-out vectors (L4), k-means (V11), residual buckets (V14), codes and lists (V17, V19)."""
    from .sets import hash_sample, heldout_split, sample_size
    pids = tokens.select("pid").distinct()
    n = pids.count()
    size = tokens.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("dim")).first()
    chosen = hash_sample(pids, "pid", sample_size(n), seed)
    vectors = tokens.join(chosen, "pid", "left_semi").select(F.concat_ws(":", "pid", "tok_pos").alias("vid"), vec)
    split = heldout_split(vectors, "vid", seed)
    held = split.filter("heldout").select(vec)
    train = split.filter("not heldout").select(F.col("vid").alias("id"), vec)
    seen = train.count()
    if held.limit(1).count() == 0:      # a very small sample: its own vectors
        held = train.select(vec)
    centroids = train_centroids(train, min(plan_partitions(size["n"]), max(1, seen)), iters, seed, vec)
    return build_index(tokens, train_codec(held, centroids, nbits, int(size["dim"]), vec), vec)


def encode_passages(texts: DataFrame, encode, dim: int, pid: str = "pid", title: str | None = None, text: str = "text") -> DataFrame:
    """V29 hook: a user's batch encoder as token vectors ``(pid, tok_pos, embedding)``.

    ``encode(list of texts, or of (title, text) pairs) -> list of arrays (tokens x dim)`` runs in each task on
    Arrow batches; several sources are unioned by the caller. Returned vectors are checked for ``dim``."""
    cols = [c for c in (title, text) if c]
    schema = T.StructType([texts.schema[pid], T.StructField("tok_pos", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def kernel(it):
        for p in it:
            given = list(p[text]) if title is None else list(zip(p[title], p[text]))
            made = [np.asarray(m, np.float64).reshape(-1, dim) for m in encode(given)]
            if len(made) != len(p):
                raise ValueError("the encoder returned another number of texts")
            sizes = [len(m) for m in made]
            yield pd.DataFrame({pid: np.repeat(p[pid].to_numpy(), sizes), "tok_pos": np.concatenate([np.arange(n) for n in sizes] or [[]]).astype(np.int64),
                                "embedding": [list(v) for m in made for v in m]})

    return texts.select(pid, *cols).mapInPandas(kernel, schema)


def lookup_embeddings(index: Index, pids: DataFrame) -> DataFrame:
    """Decompressed token vectors of the given pids (semi-join, then V18)."""
    sel = index.codes.join(pids.select("pid").distinct(), "pid", "left_semi")
    return decompress(sel, index.codec)


# ---- maintenance -------------------------------------------------------------------------------

def index_add(index: Index, new_tokens: DataFrame, vec: str = "embedding") -> tuple[Index, DataFrame]:
    """New passages ``(local_id, tok_pos, embedding)`` get pids after the largest existing pid
    (tombstoned pids included, never re-used), are compressed and appended to every table.
    Returns the new index and the mapping ``(local_id, pid)``."""
    base = index.doclens.agg(F.coalesce(F.max("pid") + 1, F.lit(0)).alias("_base"))
    from .ranking import zip_index
    ids = zip_index(new_tokens.select("local_id").distinct(), ["local_id"], "_r")
    mapping = ids.crossJoin(F.broadcast(base)).select("local_id", (F.col("_base") + F.col("_r")).cast("long").alias("pid"))
    toks = new_tokens.join(mapping, "local_id").select("pid", "tok_pos", vec)
    new_codes = compress(toks, index.codec, vec)
    codes = index.codes.unionByName(new_codes)
    ivf = index.ivf.unionByName(new_codes.select("code", "pid").distinct())
    dl = index.doclens.unionByName(doclens(new_codes))
    return Index(index.codec, codes, ivf, dl), mapping


def index_remove(index: Index, pids: DataFrame) -> Index:
    """Removed pids leave codes and lists; their doclen becomes 0 (tombstone)."""
    gone = pids.select("pid").distinct()
    codes = index.codes.join(gone, "pid", "left_anti")
    ivf = index.ivf.join(gone, "pid", "left_anti")
    dl = index.doclens.join(gone.withColumn("_gone", F.lit(True)), "pid", "left").select(
        "pid", F.when(F.col("_gone"), F.lit(0).cast("long")).otherwise(F.col("doclen")).alias("doclen"))
    return Index(index.codec, codes, ivf, dl)


def assign_chunks(doclens_df: DataFrame, chunk_size: int) -> DataFrame:
    """Chunk of each pid (``pid // chunk_size``) with embedding offsets (W8 per chunk)."""
    from .ranking import running_offsets
    d = doclens_df.withColumn("chunk", F.floor(F.col("pid") / chunk_size).cast("long"))
    return running_offsets(d, "doclen", ["pid"], partition_by=["chunk"], offset_col="emb_offset", hot_rows=None)


def chunk_metadata(chunked: DataFrame) -> DataFrame:
    """Per chunk ``passage_offset, num_passages, embedding_offset, num_embeddings``."""
    from .ranking import running_offsets
    per = chunked.groupBy("chunk").agg(F.min("pid").alias("passage_offset"),
                                       F.count(F.lit(1)).cast("long").alias("num_passages"),
                                       F.sum("doclen").cast("long").alias("num_embeddings"))
    return running_offsets(per, "num_embeddings", ["chunk"], offset_col="embedding_offset")


def index_check(meta: DataFrame, expected_chunks: int) -> DataFrame:
    """Missing chunks, and chunks whose passage offset does not follow the previous chunk."""
    spark = meta.sparkSession
    allc = spark.range(0, expected_chunks).select(F.col("id").alias("chunk"))
    missing = allc.join(meta, "chunk", "left_anti").agg(F.count(F.lit(1)).cast("long").alias("missing_chunks"))
    w = Window.orderBy("chunk")
    gaps = meta.withColumn("_prev_end", F.lag(F.col("passage_offset") + F.col("num_passages")).over(w)).filter(
        F.col("_prev_end").isNotNull() & (F.col("_prev_end") != F.col("passage_offset"))).agg(
        F.count(F.lit(1)).cast("long").alias("offset_gaps"))
    return missing.crossJoin(gaps)


# ---- the written index ---------------------------------------------------------------------------
#
# ``path/data/<id>/...`` holds Parquet folders that are written once and never changed: codes by chunk, lists,
# lengths, centroids, buckets. ``path/manifest/<version>.json`` names the folders that make a version. A change
# writes new folders and then publishes a manifest by one rename, so readers see the version before or the one
# after, and a change that failed at any point leaves nothing behind but folders that no manifest names.

def _files(spark: SparkSession, path: str):
    """The file system of ``path`` and a maker of its paths."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, place = _files(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(place(path))] if fs.exists(place(path)) else []


def index_versions(spark: SparkSession, path: str) -> list[int]:
    """The published versions of a written index, oldest first."""
    return sorted(int(n[:-5]) for n in _names(spark, f"{path}/manifest") if n.endswith(".json") and n[:-5].isdigit())


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    versions = index_versions(spark, path)
    if not versions:
        return None
    row = spark.read.text(f"{path}/manifest/{versions[-1] if version is None else version}.json", wholetext=True).first()
    return json.loads(row["value"])


def _publish(spark: SparkSession, path: str, manifest: dict) -> None:
    """Make ``manifest`` the next version: written beside, then renamed; another writer's version is never replaced."""
    fs, place = _files(spark, path)
    made, final = place(f"{path}/manifest/_{uuid.uuid4().hex}"), place(f"{path}/manifest/{manifest['version']}.json")
    out = fs.create(made, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(made, final):
        fs.delete(made, False)
        raise RuntimeError(f"version {manifest['version']} of {path} was published by another writer; repeat the change")


def _chunk(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col("pid") / size).cast("long"))


def _write_codes(codes: DataFrame, path: str, folder: str) -> dict[str, str]:
    """Write ``codes`` with their ``chunk``; the folder of each chunk that has rows."""
    codes.repartition("chunk").write.partitionBy("chunk").parquet(f"{path}/{folder}/codes")
    found = [n for n in _names(codes.sparkSession, f"{path}/{folder}/codes") if n.startswith("chunk=")]
    return {n[6:]: f"{folder}/codes/{n}" for n in found}


def write_index(index: Index, path: str, mode: str = "overwrite", chunk_size: int = 25000) -> None:
    """A new version of the index at ``path``: codes and residuals by chunk, codec, lists and lengths.

    ``mode``: ``overwrite`` (the index becomes the next version; the one it may have been read from stays until it is
    swept), ``error`` (fail if there is a version), ``reuse`` (leave a present index as it is), ``resume`` (write only
    the chunks that the newest version lacks)."""
    spark = index.codes.sparkSession
    old = _manifest(spark, path)
    if old is not None and mode == "reuse":
        return
    if old is not None and mode == "error":
        raise ValueError(f"there is an index at {path}")
    folder = f"data/{uuid.uuid4().hex}"
    codes, chunks = index.codes.select("pid", "tok_pos", "code", "residual"), {}
    if old is not None and mode == "resume":
        chunk_size, chunks = old["chunk_size"], old["chunks"]
        present = spark.createDataFrame([(int(c),) for c in chunks], "chunk long")
        codes = _chunk(codes, chunk_size).join(present, "chunk", "left_anti")
    else:
        codes = _chunk(codes, chunk_size)
    manifest = {"version": (old or {"version": 0})["version"] + 1, "chunk_size": chunk_size,
                "chunks": chunks | _write_codes(codes, path, folder)}
    buckets = index.codec.buckets.withColumn("nbits", F.lit(index.codec.nbits)).withColumn("dim", F.lit(index.codec.dim))
    for name, rows in (("ivf", index.ivf.select("code", "pid")), ("doclens", index.doclens.select("pid", "doclen")),
                       ("centroids", index.codec.centroids), ("buckets", buckets)):
        rows.write.parquet(f"{path}/{folder}/{name}")
        manifest[name] = f"{folder}/{name}"
    _publish(spark, path, manifest)


def persist_changes(spark: SparkSession, path: str, removed: DataFrame | None = None, added: Index | None = None,
                    chunk_size: int | None = None) -> None:
    """The next version of a written index, without ``removed(pid)`` and with the tables of newly added passages.

    Only the chunks that hold a removed or an added pid are written anew (the last chunk is filled up by the first
    added pids, further ones open new chunks); the manifest goes on naming the other chunks' folders, and a chunk left
    empty is no longer named. Lists and lengths are small beside the codes and are written anew. Added
    pids replace what the index holds of them, so the change may be repeated after any failure, also after its own success."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    manifest = _manifest(spark, path)
    if manifest is None:
        raise ValueError(f"there is no index at {path}")
    if chunk_size is not None and chunk_size != manifest["chunk_size"]:
        raise ValueError("the index has another chunk size")
    size, folder, old = manifest["chunk_size"], f"data/{uuid.uuid4().hex}", read_index(spark, path, manifest["version"])
    none = old.doclens.select("pid").limit(0)
    gone = (removed.select("pid").distinct() if removed is not None else none).checkpoint()
    wanted = ("pid", "tok_pos", "code", "residual")
    fresh = added.codes.select(*wanted).checkpoint() if added is not None else old.codes.select(*wanted).limit(0)
    changed = gone.unionByName(fresh.select("pid")).distinct().checkpoint()
    touched = {str(r["chunk"]) for r in _chunk(changed, size).select("chunk").distinct().toLocalIterator()}   # of the manifest's chunks
    places = [f"{path}/{manifest['chunks'][c]}" for c in sorted(touched & set(manifest["chunks"]))]
    new = fresh
    if places:
        new = spark.read.parquet(*places).select(*wanted).join(changed, "pid", "left_anti").unionByName(fresh)
    made = _write_codes(_chunk(new, size), path, folder)
    lists = old.ivf.join(changed, "pid", "left_anti").select("code", "pid").unionByName(fresh.select("code", "pid").distinct())
    lists.write.parquet(f"{path}/{folder}/ivf")
    given = doclens(fresh)
    flags = gone.withColumn("_gone", F.lit(True))
    lengths = (old.doclens.join(given.select("pid"), "pid", "left_anti").join(flags, "pid", "left")
               .select("pid", F.when(F.col("_gone"), F.lit(0).cast("long")).otherwise(F.col("doclen")).alias("doclen"))
               .unionByName(given.select("pid", "doclen")))
    lengths.write.parquet(f"{path}/{folder}/doclens")
    kept = {c: f for c, f in manifest["chunks"].items() if c not in touched}
    _publish(spark, path, manifest | {"version": manifest["version"] + 1, "chunks": kept | made,
                                      "ivf": f"{folder}/ivf", "doclens": f"{folder}/doclens"})


def sweep_index(spark: SparkSession, path: str, keep: int = 2, min_age_s: float = 86400.0) -> int:
    """Delete all but the newest ``keep`` versions, and data folders that no version left names and that are older than
    ``min_age_s`` (a writer may still be filling younger ones). The number of folders that went."""
    fs, place = _files(spark, path)
    versions = index_versions(spark, path)
    used = set()
    for v in versions[-keep:]:
        m = _manifest(spark, path, v)
        used |= {f.split("/")[1] for f in [*m["chunks"].values(), m["ivf"], m["doclens"], m["centroids"], m["buckets"]]}
    for v in versions[:-keep]:
        fs.delete(place(f"{path}/manifest/{v}.json"), False)
    gone = 0
    for f in fs.listStatus(place(f"{path}/data")) if fs.exists(place(f"{path}/data")) else []:
        if f.getPath().getName() not in used and time.time() - f.getModificationTime() / 1000 >= min_age_s:
            fs.delete(f.getPath(), True)
            gone += 1
    return gone


def read_index(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """A version of a written index (the newest one by default); no version, or empty lengths, is an error."""
    m = _manifest(spark, path, version)
    if m is None:
        raise ValueError(f"there is no index at {path}")
    b = spark.read.parquet(f"{path}/{m['buckets']}")
    meta = b.select("nbits", "dim").first()
    codec = Codec(spark.read.parquet(f"{path}/{m['centroids']}"), b.drop("nbits", "dim"), int(meta["nbits"]), int(meta["dim"]))
    dl = spark.read.parquet(f"{path}/{m['doclens']}")
    if dl.limit(1).count() == 0:
        raise ValueError("index has no doclens")
    schema = T.StructType([dl.schema["pid"], T.StructField("tok_pos", T.LongType()), T.StructField("code", T.IntegerType()),
                           T.StructField("residual", T.BinaryType())])
    places = [f"{path}/{f}" for _, f in sorted(m["chunks"].items(), key=lambda c: int(c[0]))]
    codes = spark.read.parquet(*places).select("pid", "tok_pos", "code", "residual") if places else spark.createDataFrame([], schema)
    return Index(codec, codes, spark.read.parquet(f"{path}/{m['ivf']}"), dl)
