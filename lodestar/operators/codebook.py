"""Two-level codebook: exact nearest centroids (largest dot product) for codebooks of any size.

The centroids are dealt into lists round coarse centers. Only the coarse level (``1.25 sqrt(k)`` lists with
center, radius and size) is broadcast; the centroids travel by join on their list.

For a vector ``x`` and a centroid ``c`` of a list with center ``m`` and radius ``r``, Cauchy-Schwarz gives
``x.c = x.m + x.(c - m) <= x.m + |x| r``. Each vector first meets the lists with the best centers, which
proves a score; it is then sent to exactly those other lists whose bound reaches that score. What it does not meet
cannot win, so the result is that of the full product, ties to the smaller code.

Groups are bounded: a list is split above ``4 sqrt(k)`` centroids, lists lie side by side in blocks of bounded bytes, and the
vectors are dealt into slices of about ``SLICE`` rows at most. A vector goes once to each block that holds a list it must meet, with a bit for
each of the block's lists; it would otherwise be copied to nearly every list where no bound helps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import l2_normalize
from ..session import ensure_checkpoint_dir

#: Vectors that meet a block's lists in one task.
SLICE = 1 << 15
#: Scores of vectors and lists' centers held at once.
STEP = 1 << 20
#: Bytes of a list's vectors, which one task holds as a matrix.
LIST_BYTES = 32 << 20
#: Rows, copied to lists, that are sent on at once.
COPIES = 1 << 14
#: Scores are rounded before they are compared, so equal centroids tie however products are blocked.
DIGITS = 12
_SLACK = 1e-9


def _stack(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in values.to_numpy()])


def _cut(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@dataclass
class Codebook:
    lists: DataFrame        # code int, list int, centroid array<double>
    center: np.ndarray      # coarse level, one row per list
    radius: np.ndarray
    size: np.ndarray

    def broadcast(self, spark):
        if getattr(self, "_bc", None) is None:
            self._bc = spark.sparkContext.broadcast((self.center, self.radius, self.size))
        return self._bc


def _means(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """``(key, mean, n)``: mean vector per key with partial sums."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    told = rows.select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    return told.groupBy(key).agg(Summarizer.mean(F.col("_v")).alias("_m"), F.count(F.lit(1)).alias("n")).select(key, vector_to_array("_m").alias("mean"), "n")


def _coarse_cell(centers: np.ndarray):
    """Column-wise nearest center (euclidean) of each centroid, for dealing centroids into lists."""
    half = (centers ** 2).sum(1) / 2

    def cell(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype="int32")
        return pd.Series((_stack(column) @ centers.T - half).argmax(1).astype(np.int32))

    return F.pandas_udf(cell, "int")


def build_codebook(centroids: DataFrame, rounds: int = 2) -> Codebook:
    """Deal ``centroids(code, centroid)`` into lists round coarse centers.

    Coarse centers start from the centroids with the least hashes and take ``rounds`` Lloyd steps over the
    centroids; any dealing is exact, a good one only saves visits."""
    centroids = _cut(centroids.select("code", "centroid"))
    k = centroids.count()
    if k == 0:
        raise ValueError("a codebook needs a centroid")
    coarse = max(1, math.ceil(math.sqrt(k)))
    centers = _stack(centroids.orderBy(F.xxhash64("code"), "code").limit(coarse).toPandas()["centroid"])
    most = max(1, min(4 * coarse, LIST_BYTES // (8 * max(1, centers.shape[1]))))
    for _ in range(rounds):
        got = _means(centroids.withColumn("cell", _coarse_cell(centers)("centroid")), "cell", "centroid").toPandas()
        if len(got):
            centers = centers.copy()
            centers[got["cell"].to_numpy()] = _stack(got["mean"])
    dealt = _cut(centroids.withColumn("cell", _coarse_cell(centers)("centroid")))
    sizes = {r["cell"]: r["n"] for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}   # one row per coarse center
    base, parts, at = {}, {}, 0
    for cell in sorted(sizes):
        base[cell], parts[cell] = at, math.ceil(sizes[cell] / most)
        at += parts[cell]
    first, count = (F.create_map(*[F.lit(int(x)) for c in sizes for x in (c, m[c])]) for m in (base, parts))
    number = F.element_at(first, F.col("cell")) + F.pmod(F.xxhash64("code"), F.element_at(count, F.col("cell")))
    lists = _cut(dealt.select("code", number.cast("int").alias("list"), "centroid"))
    told = _means(lists, "list", "centroid").toPandas().set_index("list").reindex(range(at))
    dim = centers.shape[1]
    full = told["n"].notna().to_numpy()
    center = np.zeros((at, dim))
    center[full] = _stack(told["mean"][full])

    def away(column: pd.Series, number: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype="float64")
        return pd.Series(np.linalg.norm(_stack(column) - center[number.to_numpy()], axis=1))

    far = lists.select("list", F.pandas_udf(away, "double")("centroid", "list").alias("r")).groupBy("list").agg(F.max("r").alias("r"))
    radius = np.zeros(at)
    for r in far.collect():
        radius[r["list"]] = r["r"]
    return Codebook(lists, center, radius, np.where(full, told["n"].fillna(0).to_numpy(), 0).astype(np.int64))


def _top(scores: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """Columns of the ``n`` best scores of each row, ties to the smaller code (``codes`` ascend)."""
    if n == 1:
        return scores.argmax(1)[:, None]
    if n >= scores.shape[1]:
        return np.argsort(-scores, axis=1, kind="stable")
    edge = -np.partition(-scores, n - 1, axis=1)[:, n - 1:n]
    # above the edge all, at the edge the first ones
    over, level = scores > edge, scores == edge
    take = over | (level & (np.cumsum(level, axis=1) <= n - over.sum(1, keepdims=True)))
    return np.nonzero(take)[1].reshape(len(scores), n)


@dataclass
class _Cells:
    """Lists side by side in blocks (as numbers only), and slices of the vectors that meet them: a cell is one slice and one block."""
    edges: np.ndarray       # first list of each block, and the end
    slices: int

    def send(self, p: pd.DataFrame, go: np.ndarray):
        """Rows once for each block that holds a list that ``go`` marks, beside the block's marks, in bounded steps."""
        for block, (a, b) in enumerate(zip(self.edges, self.edges[1:])):
            rows = np.flatnonzero(go[:, a:b].any(1))
            for s in range(0, len(rows), COPIES):
                at = rows[s:s + COPIES]
                yield p.iloc[at].assign(block=np.int32(block), lists=[m.tobytes() for m in np.packbits(go[at, a:b], axis=1)])

    def groups(self, sent: DataFrame, book: Codebook):
        """``sent(id, ..., block, lists)`` beside the blocks' vectors, by slice and block."""
        number = np.searchsorted(self.edges, np.arange(self.edges[-1]), side="right") - 1
        fine = book.lists.withColumn("block", F.get(F.array(*[F.lit(int(x)) for x in number]), F.col("list")))
        fine = fine.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(self.slices - 1))))
        rows = sent.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(self.slices)).cast("int"))
        return rows.groupBy("block", "slice").cogroup(fine.groupBy("block", "slice"))

    def meetings(self, x: pd.DataFrame, c: pd.DataFrame):
        """``(rows of x, codes, matrix)`` of each list of a cell that rows of ``x`` are sent to."""
        first = self.edges[x["block"].iloc[0]]
        marks = np.frombuffer(b"".join(x["lists"]), np.uint8).reshape(len(x), -1)
        c = c.sort_values(["list", "code"])
        number, codes, C = c["list"].to_numpy(), c["code"].to_numpy(), _stack(c["centroid"])
        starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        for a, b in zip(starts, [*starts[1:], len(c)]):
            k = number[a] - first
            rows = np.flatnonzero(marks[:, k >> 3] & (128 >> (k & 7)))
            if len(rows):
                yield rows, codes[a:b], C[a:b]


def _cells(vectors: DataFrame, book: Codebook) -> _Cells:
    """Cells for ``vectors`` (written rows): neither side above its bytes, as many as the session's shuffles have partitions."""
    from .vectors import MAX_BLOCK_BYTES, _grid_shape
    n, dim = vectors.count(), max(1, book.center.shape[1])
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices, blocks = _grid_shape(n * dim * 8, int(book.size.sum()) * dim * 8, parts, MAX_BLOCK_BYTES)
    before = np.cumsum(book.size) - book.size
    block = before * blocks // max(1, int(book.size.sum()))
    return _Cells(np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(block)], max(slices, -(-n // SLICE)))


def _stepped(p: pd.DataFrame, lists: int):
    """A batch in steps that hold a bounded number of vector-list scores."""
    step = max(1, STEP // max(1, lists))
    for s in range(0, len(p), step):
        yield p.iloc[s:s + step]


def _meet(sent: DataFrame, book: Codebook, cells: _Cells, n: int) -> DataFrame:
    """``(id, code, score)``: the ``n`` best of each cell that reach ``proven``, for ``sent(id, embedding, proven, block, lists)``."""
    from .vectors import STEP_CELLS, _select_topk
    slack = 10.0 ** -DIGITS     # rounding lifts a score by less

    def kernel(x: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(c):
            return pd.DataFrame({"id": x["id"][:0], "code": c["code"][:0], "score": np.zeros(0)})
        X, least = _stack(x["embedding"]), x["proven"].to_numpy(np.float64).copy()
        held, size, full = [], 0, max(1 << 20, 4 * n * len(X))

        def best():
            out = _select_topk(*(np.concatenate(h) for h in zip(*held)), n)
            count = np.bincount(out[0], minlength=len(X))
            least[count == n] = out[2][np.cumsum(count)[count == n] - 1]    # a lower score is of no use any more
            return out

        for rows, codes, C in cells.meetings(x, c):
            step = max(1, STEP_CELLS // len(C))
            for s in range(0, len(rows), step):
                r = rows[s:s + step]
                S = X[r] @ C.T
                low = least[r]
                if len(C) > n and np.isneginf(low).any():
                    low = np.maximum(low, np.round(np.partition(S, len(C) - n, axis=1)[:, len(C) - n], DIGITS))
                i, j = np.nonzero(S >= (low - slack)[:, None])
                score = np.round(S[i, j], DIGITS)
                held.append((r[i], codes[j], score))
                size += len(i)
                if size > full:
                    held = [best()]
                    size = len(held[0][0])
        if not held:
            return pd.DataFrame({"id": x["id"][:0], "code": c["code"][:0], "score": np.zeros(0)})
        rows, codes, score = best()
        return pd.DataFrame({"id": x["id"].to_numpy()[rows], "code": codes, "score": score})

    schema = T.StructType([sent.schema["id"], book.lists.schema["code"], T.StructField("score", T.DoubleType())])
    return cells.groups(sent, book).applyInPandas(kernel, schema)


def _sent_schema(vectors: DataFrame, *more: T.StructField) -> T.StructType:
    return T.StructType([*vectors.schema.fields, *more, T.StructField("block", T.IntegerType()), T.StructField("lists", T.BinaryType())])


def nearest_codes(vectors: DataFrame, book: Codebook, n: int = 1) -> DataFrame:
    """``(id, code, score, rank)``: the ``n`` centroids with the largest dot product for each of ``vectors(id, embedding)``.

    Ids must be distinct. Exact: equal to the full product, scores rounded to 12 digits, ties to the smaller code."""
    from pyspark.sql import Window

    from .vectors import spread
    bc = book.broadcast(vectors.sparkSession)
    vectors = _cut(spread(vectors.select("id", "embedding")))
    cells = _cells(vectors, book)
    told = T.StructField("proven", T.DoubleType())

    def starts(S: np.ndarray, size) -> np.ndarray:
        """Lists with the best centers that hold ``n`` centroids at least, as a mask."""
        S = np.where(size > 0, S, -np.inf)
        mask, top = np.zeros(S.shape, bool), S.argmax(1)
        mask[np.arange(len(S)), top] = size[top] > 0
        few = np.flatnonzero(size[top] < n)
        order = np.argsort(-S[few], axis=1, kind="stable")
        held = np.cumsum(size[order], axis=1)
        wanted = (held - size[order] < n) & (size[order] > 0)
        more = np.zeros(order.shape, bool)
        np.put_along_axis(more, order, wanted, 1)
        mask[few] = more
        return mask

    def routed(with_score: bool):
        def run(it):
            center, radius, size = bc.value
            for whole in it:
                for p in _stepped(whole, len(size)):
                    X = _stack(p["embedding"])
                    S = X @ center.T
                    go = starts(S, size)
                    if with_score:
                        norm = np.linalg.norm(X, axis=1, keepdims=True)
                        go = ~go & (size > 0) & (S + norm * radius + _SLACK * (1 + norm) >= p["proven"].to_numpy()[:, None])
                    else:
                        p = p.assign(proven=-np.inf)
                    yield from cells.send(p[["id", "embedding", "proven"]], go)
        return run

    order = Window.partitionBy("id").orderBy(F.desc("score"), "code")
    first = _cut(_meet(vectors.mapInPandas(routed(False), _sent_schema(vectors, told)), book, cells, n))
    ranked = first.withColumn("rank", F.row_number().over(order))
    proven = ranked.filter(F.col("rank") == n).select("id", F.col("score").alias("proven"))
    asked = spread(vectors.join(proven, "id", "left").withColumn("proven", F.coalesce("proven", F.lit(float("-inf")))), "id")
    more = _meet(asked.mapInPandas(routed(True), _sent_schema(vectors, told)), book, cells, n)
    return first.unionByName(more).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def counts_above(vectors: DataFrame, book: Codebook) -> DataFrame:
    """``(id, above, met)`` for ``vectors(id, embedding, threshold)``: how many of the book's vectors have a dot product strictly
    above the threshold (both rounded to 12 digits), and how many had to be multiplied to know.

    A list whose bounds ``x.m +- |x| r`` both lie above the threshold counts as a whole, one whose upper bound does not reach
    it counts nothing; only lists in between are met. Ids must be distinct."""
    from .vectors import _above_in_block, spread
    bc = book.broadcast(vectors.sparkSession)
    vectors = _cut(spread(vectors.select("id", "embedding", F.col("threshold").cast("double").alias("threshold"))))
    cells = _cells(vectors, book)
    told = T.StructType([vectors.schema["id"], T.StructField("above", T.LongType()), T.StructField("met", T.LongType())])

    def bounds(it):
        center, radius, size = bc.value
        for batch in it:
            for p in _stepped(batch, len(size)):
                X = _stack(p["embedding"])
                norm, thr = np.linalg.norm(X, axis=1, keepdims=True), p["threshold"].to_numpy()[:, None]
                middle, slack = X @ center.T, norm * radius + _SLACK * (1 + norm)
                whole = (middle - slack > thr) & (size > 0)
                yield p, whole, ~whole & (middle + slack >= thr) & (size > 0), size

    def sure(it):
        for p, whole, unsure, size in bounds(it):
            yield pd.DataFrame({"id": p["id"].to_numpy(), "above": whole @ size, "met": unsure @ size})

    def routed(it):
        for p, _, unsure, _ in bounds(it):
            yield from cells.send(p, unsure)

    def kernel(x: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out, above = pd.DataFrame({"id": x["id"], "above": 0, "met": 0}), np.zeros(len(x), np.int64)
        if len(x) and len(c):
            X, thr = _stack(x["embedding"]), np.round(x["threshold"].to_numpy(), DIGITS)
            for rows, _, C in cells.meetings(x, c):
                above[rows] += _above_in_block(X[rows], thr[rows], C)
        out["above"] = above
        return out

    sent = vectors.mapInPandas(routed, _sent_schema(vectors))
    parts = vectors.mapInPandas(sure, told).unionByName(cells.groups(sent, book).applyInPandas(kernel, told))
    return parts.groupBy("id").agg(F.sum("above").cast("long").alias("above"), F.sum("met").cast("long").alias("met"))


def lloyd(vectors: DataFrame, centroids: DataFrame, rounds: int = 4, normalise: bool = True) -> DataFrame:
    """``rounds`` steps of spherical k-means from ``centroids(code, centroid)`` over ``vectors(id, embedding)``.

    A step assigns each vector to the centroid with the largest dot product (two-level, exact) and takes means, with partial sums;
    a centroid without vectors stays. Nothing but the coarse level leaves the executors."""
    vectors = _cut(vectors.select("id", "embedding"))
    centroids = centroids.select("code", "centroid")
    for _ in range(rounds):
        codes = nearest_codes(vectors, build_codebook(centroids)).select("id", "code")
        means = _means(vectors.join(codes, "id"), "code", "embedding").select("code", F.col("mean"))
        moved = l2_normalize("mean") if normalise else F.col("mean")
        centroids = _cut(centroids.join(means.select("code", moved.alias("mean")), "code", "left").select("code", F.coalesce("mean", "centroid").alias("centroid")))
    return centroids


def start_centroids(vectors: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``k`` start centroids, L2-normalised: the vectors ``(id, embedding)`` with the least md5 of ``seed:id``, codes in that order."""
    from .ranking import zip_index
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    chosen = _cut(vectors.select(mark.alias("_h"), "id", "embedding").orderBy("_h", "id").limit(k))
    numbered = zip_index(chosen.select("_h", "id"), ["_h", "id"], "code")
    return numbered.join(chosen.select("id", "embedding"), "id").select(
        F.col("code").cast("int").alias("code"), l2_normalize(F.col("embedding").cast("array<double>")).alias("centroid"))
