"""Vector operators: exact and approximate kNN, maxsim, in-batch scores, 8-bit codes
(V4-V9, V34, J15, A14, A15).

Exact bulk scoring runs on a grid: queries and documents are each dealt into blocks by a hash of
their key. Blocks of both sides are as many as keep a block's matrix within ``MAX_BLOCK_BYTES`` and as give
at least a cell for each partition of the session's shuffles, with the fewest bytes copied; every cell (query block,
document block) is one cogroup that multiplies its two matrices in steps with numpy and keeps only a local
top-k (or a count) per query. Nothing is collected or broadcast; the final top-k per query is a
``row_number`` window over at most ``document blocks x k`` rows per query.

``knn_balls`` and ``count_above_balls`` give the same answers by skipping: documents are dealt into balls (the lists of
:mod:`codebook`, no larger than ``LIST_BYTES``), and a query meets only balls whose bound reaches its k-th score.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import dot, sq_l2
from .codebook import DIGITS
from .ranking import topk_per_query

MAX_BLOCK_BYTES = 16 << 20      # one query or document block's float64 matrix
MAX_BLOCK_CELLS = 8 << 20       # scores held at once in one task: queries x documents
STEP_QUERIES = 1 << 9           # queries multiplied at once in a cell of the grid,
STEP_CELLS = 1 << 19            # and their scores
MAX_COPIES = 1 << 14            # rows of queries, copied to blocks, that are sent on at once
RECALL_QUERIES = 512            # queries that approximate kNN's recall is measured on
RECALL_HITS = 1 << 16           # and their exact hits, which the driver gathers


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal small rows (ids, packed queries) of a Python-heavy stage into as many tasks as the session's
    shuffles have, a number that is set by the data's size; AQE does not coalesce an explicit count."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys) if keys else df.repartition(n)


def spread_scan(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores (small files) is spread before numpy kernels; a large
    scan already has many splits and is left alone (no shuffle). Plans that already shuffle are
    left alone too (their partition count is the shuffle's; asking an adaptive plan for its
    partitions would run its stages)."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan or "AdaptiveSparkPlan" in plan:
        return df
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def _matrix(col: pd.Series) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, 0))
    return np.stack(col.to_numpy()).astype(np.float64)


def _select_topk(rows, ids, scores, k):
    """Exact top-k per row under (score desc, id asc) on flat candidate triples."""
    if len(rows) == 0:
        return rows, ids, scores
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    starts = np.r_[0, np.nonzero(np.diff(rows))[0] + 1]
    counts = np.diff(np.r_[starts, len(rows)])
    rank = np.arange(len(rows)) - np.repeat(starts, counts)
    keep = rank < k
    return rows[keep], ids[keep], scores[keep]


def _scores(Q: np.ndarray, D: np.ndarray, metric: str) -> np.ndarray:
    S = Q @ D.T
    if metric == "l2":   # larger is better: minus squared distance
        S *= 2
        S -= (Q * Q).sum(1)[:, None]
        S -= (D * D).sum(1)[None, :]
    return S


def _best_of_block(Q: np.ndarray, D: np.ndarray, ids: np.ndarray, k: int, metric: str, digits: int | None):
    """``(row, id, score)`` of the ``k`` best documents of each query, in steps that hold ``STEP_CELLS`` scores. From the
    second step on, only scores that reach a query's k-th one so far are sorted."""
    slack = 0.0 if digits is None else 10.0 ** -digits    # rounding lifts a score by less
    for a in range(0, len(Q), STEP_QUERIES):
        q = Q[a:a + STEP_QUERIES]
        step = max(1, STEP_CELLS // len(q))
        least = np.full(len(q), -np.inf)
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for s in range(0, len(D), step):
            S = _scores(q, D[s:s + step], metric)
            m = S.shape[1]
            if m > k and np.isneginf(least).any():
                edge = np.partition(S, m - k, axis=1)[:, m - k]
                least = np.maximum(least, edge if digits is None else np.round(edge, digits))
            r, c = np.nonzero(S >= (least - slack)[:, None])
            sc = S[r, c] if digits is None else np.round(S[r, c], digits)
            held = _select_topk(np.r_[held[0], r], np.r_[held[1], ids[s + c]], np.r_[held[2], sc], k)
            count = np.bincount(held[0], minlength=len(q))
            least[count == k] = held[2][np.cumsum(count)[count == k] - 1]
        yield held[0] + a, held[1], held[2]


def _bytes(df: DataFrame, vec: str) -> int:
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("dim")).first()
    return int(stats["n"]) * int(stats["dim"] or 1) * 8


def _grid_shape(q_bytes: int, d_bytes: int, cells: int, max_bytes: int) -> tuple[int, int]:
    """Blocks of either side: none above ``max_bytes``, ``cells`` cells at least, few bytes copied (the queries go to every
    document block, the documents to every query block)."""
    nq = max(1, -(-q_bytes // max_bytes), min(cells, round(math.sqrt(cells * q_bytes / max(1, d_bytes)))))
    return nq, max(1, -(-d_bytes // max_bytes), -(-cells // nq))


def _grid(queries: DataFrame, docs: DataFrame, qkeys: Sequence[str], did: str, qvec: str, dvec: str, max_bytes: int):
    """Both sides dealt into blocks and copied to the cells of their row or column of the grid."""
    cells = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nq, nd = _grid_shape(_bytes(queries, qvec), _bytes(docs, dvec), cells, max_bytes)

    def deal(df, keys, own, n_own, other, n_other):
        df = df.withColumn(own, F.pmod(F.xxhash64(*keys), F.lit(n_own)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    q = deal(queries, list(qkeys), "_qb", nq, "_db", nd)
    d = deal(docs, [did], "_db", nd, "_qb", nq)
    return q.groupBy("_qb", "_db").cogroup(d.groupBy("_qb", "_db"))


def knn_flat(queries: DataFrame, docs: DataFrame, k: int, qkeys: Sequence[str] = ("qid",), qvec: str = "embedding",
             did: str = "pid", dvec: str = "embedding", metric: str = "ip",
             max_block_bytes: int = MAX_BLOCK_BYTES, score_digits: int | None = None) -> DataFrame:
    """V7 (and V34 with a filtered ``docs``): exact top-``k`` documents per query by inner product
    (``metric='ip'``) or by smallest euclidean distance (``'l2'``, score = -distance²).
    Returns ``(*qkeys, did, score, rank)``; ties by document id. ``score_digits`` rounds scores
    before any comparison, so mathematically equal scores tie exactly (then by id)."""
    qkeys = list(qkeys)
    out_schema = T.StructType([queries.schema[c] for c in qkeys] + [docs.schema[did], T.StructField("score", T.DoubleType())])
    columns = [f.name for f in out_schema.fields]
    queries, docs = queries.select(*qkeys, F.col(qvec).alias("_qv")), docs.select(F.col(did).alias("_id"), F.col(dvec).alias("_dv"))

    def kernel(qpdf: pd.DataFrame, dpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(dpdf) == 0:
            return pd.DataFrame({c: [] for c in columns})
        found = _best_of_block(_matrix(qpdf["_qv"]), _matrix(dpdf["_dv"]), dpdf["_id"].to_numpy().astype(np.int64), k, metric, score_digits)
        rows, ids, sc = (np.concatenate(x) for x in zip(*found))
        out = qpdf[qkeys].iloc[rows].reset_index(drop=True)
        out[did] = ids
        out["score"] = sc
        return out[columns]

    cells = _grid(queries, docs, qkeys, "_id", "_qv", "_dv", max_block_bytes).applyInPandas(kernel, out_schema)
    w = Window.partitionBy(*qkeys).orderBy(F.col("score").desc(), F.col(did))
    return cells.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def _above_in_block(Q: np.ndarray, thr: np.ndarray, D: np.ndarray) -> np.ndarray:
    """Per query, documents whose score rounded to ``DIGITS`` lies above ``thr`` (rounded too), in steps that hold
    ``STEP_CELLS`` scores. Only scores next to the threshold need to be rounded."""
    above = np.zeros(len(Q), np.int64)
    for a in range(0, len(Q), STEP_QUERIES):
        q, t = Q[a:a + STEP_QUERIES], thr[a:a + STEP_QUERIES, None]
        near, step = 10.0 ** (1 - DIGITS) * np.maximum(1.0, np.abs(t)), max(1, STEP_CELLS // len(q))
        for s in range(0, len(D), step):
            S = q @ D[s:s + step].T
            over = S > t + near
            n = np.count_nonzero(over, axis=1)
            reach = S > t - near
            if np.count_nonzero(reach) > n.sum():
                r, c = np.nonzero(reach & ~over)
                n += np.bincount(r, np.round(S[r, c], DIGITS) > t[r, 0], len(q)).astype(np.int64)
            above[a:a + STEP_QUERIES] += n
    return above


def count_scores_above(queries: DataFrame, docs: DataFrame, threshold_col: str, qkeys: Sequence[str] = ("qid",),
                       qvec: str = "embedding", dvec: str = "embedding", max_block_bytes: int = MAX_BLOCK_BYTES,
                       did: str = "cid") -> DataFrame:
    """A14 core: per query, the number of documents scoring strictly above the query's threshold
    (e.g. its gold score): products per cell of the grid with a count each, then a sum. No sort.
    Scores and thresholds are rounded to 12 digits: a document equal to the gold one is never above it. Documents
    are dealt by ``did``, so equal vectors do not meet in one block."""
    qkeys = list(qkeys)
    schema = T.StructType([queries.schema[c] for c in qkeys] + [T.StructField("above", T.LongType())])
    queries = queries.select(*qkeys, F.col(threshold_col).cast("double").alias("_thr"), F.col(qvec).alias("_qv"))

    def kernel(qpdf: pd.DataFrame, dpdf: pd.DataFrame) -> pd.DataFrame:
        out = qpdf[qkeys].copy()
        out["above"] = 0
        if len(qpdf) and len(dpdf):
            thr = np.round(qpdf["_thr"].to_numpy(), DIGITS)
            out["above"] = _above_in_block(_matrix(qpdf["_qv"]), thr, _matrix(dpdf["_dv"]))
        return out

    docs = docs.select(F.col(did).alias("_id"), F.col(dvec).alias("_dv"))
    cells = _grid(queries, docs, qkeys, "_id", "_qv", "_dv", max_block_bytes).applyInPandas(kernel, schema)
    return cells.groupBy(*qkeys).agg(F.sum("above").cast("long").alias("gold_rank"))


def _gold_scores(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    gold = questions.join(contexts.select(F.col("cid").alias("gold_cid"), F.col("embedding").alias("_g")), "gold_cid")
    return gold.withColumn("_gs", dot("embedding", "_g")).drop("_g")


def average_rank(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """``questions(qid, embedding, gold_cid)``, ``contexts(cid, embedding)``: per question the
    0-based rank of its gold context among all contexts = contexts scoring strictly higher."""
    return count_scores_above(_gold_scores(questions, contexts), contexts, "_gs", ["qid"])


# ---- exact search by balls -----------------------------------------------------------------------

def document_balls(docs: DataFrame, did: str = "pid", dvec: str = "embedding"):
    """Documents dealt into balls (center, radius) of bounded bytes, once for any number of searches. Ids must be
    distinct integers."""
    from .codebook import build_codebook
    return build_codebook(docs.select(F.col(did).alias("code"), F.col(dvec).cast("array<double>").alias("centroid")))


def knn_balls(queries: DataFrame, balls, k: int, qid: str = "qid", qvec: str = "embedding", did: str = "pid") -> DataFrame:
    """V7 by balls: exact top-``k`` documents per query by inner product, ``(qid, did, score, rank)``, equal to :func:`knn_flat`
    with scores rounded to 12 digits. A query first meets the balls with the best centers, which proves a k-th score, then
    only those whose bound ``q.m + |q| r`` reaches it. Query ids must be distinct."""
    from .codebook import nearest_codes
    found = nearest_codes(queries.select(F.col(qid).alias("id"), F.col(qvec).alias("embedding")), balls, k)
    return found.select(F.col("id").alias(qid), F.col("code").alias(did), "score", F.col("rank").cast("long").alias("rank"))


def average_rank_balls(questions: DataFrame, contexts: DataFrame, balls=None) -> DataFrame:
    """A14 by balls: ``(qid, gold_rank, met)``. Balls wholly above a question's gold score count as a whole, those wholly
    below count nothing; ``met`` is the number of contexts that had to be multiplied."""
    from .codebook import counts_above
    gold = _gold_scores(questions, contexts).select(F.col("qid").alias("id"), "embedding", F.col("_gs").alias("threshold"))
    out = counts_above(gold, balls or document_balls(contexts, "cid"))
    return out.select(F.col("id").alias("qid"), F.col("above").alias("gold_rank"), "met")


# ---- multi-vector (late interaction) -------------------------------------------------------------

def pack_vectors(tokens: DataFrame, key: str, pos: str, vec: str = "embedding", out: str = "vecs", element: str = "double") -> DataFrame:
    """A passage's (or query's) token vectors packed in position order into one flat
    ``array<element>`` (``n_vectors * dim``; bounded by the encoder's max length). Flat arrays cross
    to Arrow/numpy without per-vector objects; kernels reshape with the known ``dim``."""
    g = tokens.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(vec).alias("v")))).alias("_s"))
    return g.select(key, F.flatten(F.transform("_s", lambda x: x["v"].cast(f"array<{element}>"))).alias(out))


def vector_dim(df: DataFrame, vec: str = "embedding") -> int:
    """The vector dimension (one scalar read)."""
    return int(df.select(F.max(F.size(vec))).first()[0] or 0)


def _maxsim_scores(Q: np.ndarray, docs, variant: str, floor_zero: bool) -> np.ndarray:
    """Scores of one query's vectors against its documents, each a flat array of vectors."""
    dim, sizes = Q.shape[1], np.array([len(x) for x in docs]) // Q.shape[1]
    out = np.zeros(len(docs))                               # a document without vectors scores 0
    full = np.flatnonzero(sizes)
    if not len(full) or not len(Q):
        return out
    D = np.concatenate([docs[i] for i in full]).astype(np.float64).reshape(-1, dim)
    S = _scores(Q, D, "l2" if variant == "l2" else "ip")
    m = np.maximum.reduceat(S, np.cumsum(sizes[full]) - sizes[full], axis=1)     # (query vectors, documents)
    if floor_zero:
        m = np.maximum(m, 0.0)
    if variant == "flipr":
        rest = m[64:]
        out[full] = np.sort(m[:64], axis=0)[::-1][:32].sum(0) + (np.sort(rest, axis=0)[::-1][:8].sum(0) if len(rest) >= 8 else 0.0)
    else:
        out[full] = m.sum(0)
    return out


def maxsim(pairs: DataFrame, qpacked: DataFrame, dpacked: DataFrame, dim: int, qid: str = "qid", pid: str = "pid",
           variant: str = "colbert", floor_zero: bool = False) -> DataFrame:
    """V4/V5/V6: score of each ``(qid, pid)`` pair = sum over query vectors of the best document
    vector (dot for ``colbert``, minus squared distance for ``l2``; ``flipr`` keeps the top 32 of
    the first 64 query maxima plus the top 8 of the rest). ``qpacked(qid, qvecs)`` and
    ``dpacked(pid, dvecs)`` come from ``pack_vectors``.

    Documents are joined to their pairs and sorted by query behind the query's own row, which so travels once and not with every
    pair; the kernel holds one query and a batch of its documents."""
    schema = T.StructType([pairs.schema[qid], pairs.schema[pid], T.StructField("score", T.DoubleType())])
    met = spread(pairs.select(qid, pid), pid).join(dpacked.select(pid, "dvecs"), pid).select(qid, pid, F.lit(None).cast(qpacked.schema["qvecs"].dataType).alias("qvecs"), "dvecs")
    asked = qpacked.select(qid, F.lit(0).cast(pairs.schema[pid].dataType).alias(pid), "qvecs", F.lit(None).cast(dpacked.schema["dvecs"].dataType).alias("dvecs"))
    rows = asked.withColumn("_pair", F.lit(0)).unionByName(met.withColumn("_pair", F.lit(1))).filter(F.col(qid).isNotNull())

    def kernel(it):
        held, now = [], None            # the query at hand, and its vectors (once for each row it has)
        for pdf in it:
            key, pair = pdf[qid].to_numpy(), pdf["_pair"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])])
            for s, e in zip(starts, [*starts[1:], len(key)]):
                if key[s] != now:
                    held, now = [], key[s]
                part = pdf.iloc[s:e]
                if not pair[s]:
                    held += [np.asarray(v, np.float64).reshape(-1, dim) for v in part["qvecs"]]
                    continue
                docs = part["dvecs"].to_list()
                for Q in held:
                    size = np.cumsum([len(x) // dim for x in docs]) * max(1, len(Q))
                    cuts = np.flatnonzero(np.diff(size // STEP_CELLS)) + 1
                    for a, b in zip([0, *cuts], [*cuts, len(docs)]):
                        yield pd.DataFrame({qid: key[s + a:s + b], pid: part[pid].iloc[a:b].to_numpy(),
                                            "score": _maxsim_scores(Q, docs[a:b], variant, floor_zero)})

    def batched(it):                    # a frame for each query would cost more than its scores
        parts, n = [], 0
        for p in kernel(it):
            parts.append(p)
            n += len(p)
            if n >= MAX_COPIES:
                yield pd.concat(parts, ignore_index=True)
                parts, n = [], 0
        if parts:
            yield pd.concat(parts, ignore_index=True)

    return spread(rows, qid).sortWithinPartitions(qid, "_pair").mapInPandas(batched, schema)


def maxsim_join(pairs: DataFrame, qtok: DataFrame, dtok: DataFrame, qid: str = "qid", pid: str = "pid") -> DataFrame:
    """V4 relational form: join tokens, max per (qid, qtok, pid), sum per (qid, pid).
    ``qtok(qid, qpos, qvec)``, ``dtok(pid, dvec)``."""
    j = pairs.select(qid, pid).join(qtok, qid).join(dtok, pid)
    per = j.groupBy(qid, "qpos", pid).agg(F.max(dot("qvec", "dvec")).alias("_m"))
    return per.groupBy(qid, pid).agg(F.sum("_m").alias("score"))


# ---- in-batch scoring (bounded batches) ---------------------------------------------------------

def inbatch_scores(rows: DataFrame, batch: str = "batch", qid: str = "qid", qvec: str = "qvec",
                   cvec: str = "cvec") -> DataFrame:
    """Within each batch (bounded size), every question is scored against every context
    of the batch; emits per question ``scores`` (array in batch order), its gold score (own
    context), the log-sum-exp and the arg-max position. Row count stays one per question."""
    schema = T.StructType([rows.schema[batch], rows.schema[qid], T.StructField("pos", T.LongType()),
                           T.StructField("scores", T.ArrayType(T.DoubleType())),
                           T.StructField("gold_score", T.DoubleType()), T.StructField("lse", T.DoubleType()),
                           T.StructField("argmax", T.LongType())])

    def per_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(qid).reset_index(drop=True)
        Q, C = _matrix(pdf[qvec]), _matrix(pdf[cvec])
        S = Q @ C.T
        mx = S.max(1)
        lse = mx + np.log(np.exp(S - mx[:, None]).sum(1))
        return pd.DataFrame({batch: pdf[batch], qid: pdf[qid], "pos": np.arange(len(pdf)),
                             "scores": list(S), "gold_score": np.diag(S), "lse": lse,
                             "argmax": S.argmax(1)})

    return rows.select(batch, qid, qvec, cvec).groupBy(batch).applyInPandas(per_batch, schema)


# ---- MIPS to L2 and 8-bit codes ---------------------------------------------------------------

def mips_to_l2(docs: DataFrame, vec: str = "embedding", out: str = "aug") -> DataFrame:
    """V8 transform: ``phi = max |d|²``; each document gains the component ``sqrt(phi - |d|²)``
    (queries gain 0), so inner-product order equals euclidean order. Two passes, no collect."""
    n2 = docs.withColumn("_n2", dot(vec, vec))
    phi = n2.agg(F.max("_n2").alias("_phi"))
    return n2.crossJoin(F.broadcast(phi)).withColumn(out, F.sqrt(F.greatest(F.col("_phi") - F.col("_n2"), F.lit(0.0)))).drop("_n2", "_phi")


def _in_steps(vectors: pd.Series, centers: np.ndarray):
    """``(rows, distances)`` in steps that hold a bounded number of vector-center distances."""
    half, step = (centers * centers).sum(1) / 2, max(1, MAX_BLOCK_CELLS // len(centers))
    for s in range(0, len(vectors), step):
        part = slice(s, s + step)
        yield part, half[None, :] - _matrix(vectors.iloc[part]) @ centers.T


def _with_units(df: DataFrame, vec: str, centers: np.ndarray, cuts: np.ndarray, hashed: str) -> DataFrame:
    """``df`` plus ``_unit``: the nearest center's first unit, and on from there by ``hashed`` where a cell is cut."""
    shared = df.sparkSession.sparkContext.broadcast((centers, cuts))
    schema = T.StructType([*df.schema.fields, T.StructField("_unit", T.IntegerType())])

    def kernel(it):
        C, n = shared.value
        first = np.cumsum(n) - n
        for p in it:
            if len(p):
                cell = np.concatenate([far.argmin(1) for _, far in _in_steps(p[vec], C)])
                yield p.assign(_unit=(first[cell] + p[hashed].to_numpy() % n[cell]).astype(np.int32))

    return df.mapInPandas(kernel, schema)


def _nearest(far: np.ndarray, m: int) -> np.ndarray:
    """Which of a row's distances are the ``m`` smallest, ties to the first."""
    if m >= far.shape[1]:
        return np.ones(far.shape, bool)
    edge = np.partition(far, m - 1, axis=1)[:, m - 1:m]
    near = far <= edge
    for i in np.flatnonzero(near.sum(1) > m):
        tied = np.flatnonzero(far[i] == edge[i])
        near[i, tied[m - np.count_nonzero(far[i] < edge[i]):]] = False
    return near


def _probed_units(df: DataFrame, vec: str, centers: np.ndarray, cuts: np.ndarray, probes: int, blocks: int) -> DataFrame:
    """``df`` (without ``vec``) once for each block that holds units of the ``probes`` nearest cells: plus ``_db`` and ``_units``."""
    shared = df.sparkSession.sparkContext.broadcast((centers, cuts))
    kept = [f for f in df.schema.fields if f.name != vec]
    schema = T.StructType([*kept, T.StructField("_db", T.IntegerType()), T.StructField("_units", T.ArrayType(T.IntegerType()))])

    def kernel(it):
        C, n = shared.value
        units = np.argsort(np.arange(n.sum()) % blocks, kind="stable")     # those of a block side by side
        cells = np.repeat(np.arange(len(n)), n)[units]
        for p in it:
            for part, far in _in_steps(p[vec], C):
                row, at = np.nonzero(_nearest(far, probes)[:, cells])
                unit = units[at].astype(np.int32)
                starts = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(unit % blocks) != 0)])
                lists, own = np.split(unit, starts[1:]), p[[f.name for f in kept]].iloc[part]
                for s in range(0, len(starts), MAX_COPIES):   # a query's vector is copied to each of its blocks
                    at = starts[s:s + MAX_COPIES]
                    yield own.iloc[row[at]].reset_index(drop=True).assign(
                        _db=unit[at] % blocks, _units=pd.Series(lists[s:s + MAX_COPIES], dtype=object))

    return df.mapInPandas(kernel, schema)


def knn_cells(n: int) -> int:
    """Cells for ``n`` documents: sixteen times their square root, two documents in each at least."""
    return max(1, min(1 << 16, n // 2, int(16 * np.sqrt(max(n, 1)))))


def knn_probes(cells: int) -> int:
    """Fewest cells that a query probes: 18 % of them, 64 at most. ``measured_probes`` raises the number."""
    return max(1, min(64, int(0.18 * cells)))


def measured_probes(queries: DataFrame, docs: DataFrame, k: int, centers: np.ndarray, recall: float, qid: str, did: str, seed: int) -> int:
    """Fewest probes (``knn_probes`` at least) whose recall at ``k`` reaches ``recall`` on a sample of the queries.

    The sample meets all ``docs(did, embedding, _v)`` exactly (V7). A hit is found with ``m`` probes if its cell is
    among the ``m`` nearest to the query, so the cells' places give the recall of every ``m``. Two standard errors
    are left for the queries that are not in the sample; with all cells probed the recall is 1."""
    from .sets import hash_sample
    n = max(16, min(RECALL_QUERIES, RECALL_HITS // k))
    sample = hash_sample(queries, qid, n, seed).select(qid, F.col("_qe").alias("embedding"), "_v").collect()
    if not sample:
        return 1
    spark = queries.sparkSession
    asked = spark.createDataFrame([(i, r["embedding"]) for i, r in enumerate(sample)], T.StructType(
        [T.StructField("_row", T.LongType()), T.StructField("embedding", queries.schema["_qe"].dataType)]))
    hits = [(r["_row"], r[did]) for r in knn_flat(asked, docs, k, ["_row"], did=did).collect()]
    found = spark.createDataFrame([(i,) for i in {h for _, h in hits}], T.StructType([docs.schema[did]]))
    whole = docs.select(did, "_v", F.lit(0).alias("_h")).join(F.broadcast(found), did, "left_semi")
    home = {r[did]: r["_unit"] for r in _with_units(whole, "_v", centers, np.ones(len(centers), np.int64), "_h").select(did, "_unit").collect()}
    place = np.empty((len(sample), len(centers)), np.int64)
    for part, far in _in_steps(pd.Series([r["_v"] for r in sample]), centers):
        np.put_along_axis(place[part], np.argsort(far, axis=1, kind="stable"), np.arange(len(centers))[None, :], axis=1)
    row = np.array([r for r, _ in hits])
    at, of = place[row, [home[h] for _, h in hits]], np.bincount(row, minlength=len(sample))
    m = knn_probes(len(centers))
    while m < len(centers):
        share = np.bincount(row, at < m, len(sample))[of > 0] / of[of > 0]
        error = share.std() / np.sqrt(len(share)) if len(sample) >= n else 0.0
        if share.mean() - 2 * error >= recall:
            break
        m = min(len(centers), m + max(1, m // 32))
    return m


def knn_approx(queries: DataFrame, docs: DataFrame, k: int, cells: int | None = None, probes: int | None = None,
               seed: int = 7, qid: str = "qid", did: str = "pid", recall: float = 0.9) -> DataFrame:
    """V8: approximate MIPS over cells. Vectors are augmented by ``mips_to_l2``; k-means centers are trained on
    a hash sample of the documents (L3's size); each document lies in its nearest cell and each query
    probes the ``probes`` cells nearest to it, by default as many as ``measured_probes`` finds to reach ``recall``
    at ``k`` on this table. Only pairs of a probed cell are scored (exact inner products, cut to the top ``k``).

    Cells are dealt whole into the document blocks of a grid as for exact search (where vectors do not cluster, a query meets
    nearly every block: were they as many as shuffles have partitions, its copies and its local top ``k`` would grow with
    the table); one that holds more than a quarter of a block's share of documents is cut into units by a hash of ``did``. A query
    goes once to each block that holds a unit of its cells. A query can get fewer than ``k`` only if its cells hold fewer."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from .sets import hash_sample, sample_size
    d = mips_to_l2(docs.select(did, "embedding"))
    d = d.select(did, "embedding", F.concat(F.col("embedding").cast("array<double>"), F.array("aug")).alias("_v"))
    q = queries.select(qid, F.col("embedding").alias("_qe"), F.concat(F.col("embedding").cast("array<double>"), F.array(F.lit(0.0))).alias("_v"))
    n = docs.count()
    if n == 0:
        return topk_per_query(q.crossJoin(docs.select(did)).select(qid, did, F.lit(0.0).alias("score")), k, qid, "score", did)
    cells = min(cells or knn_cells(n), n)
    sample = hash_sample(d, did, sample_size(n), seed).select(array_to_vector("_v").alias("features"))
    centers = np.array(KMeans(k=cells, maxIter=8, seed=seed, initMode="random").fit(sample).clusterCenters())
    probes = probes or measured_probes(q, d, k, centers, recall, qid, did, seed)
    nq, blocks = _grid_shape(_bytes(q, "_qe"), _bytes(docs, "embedding"), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), MAX_BLOCK_BYTES)
    hashed = d.select(did, "embedding", "_v", F.xxhash64(did).alias("_h"))
    cuts = np.ones(len(centers), np.int64)
    for r in _with_units(hashed.select("_v", "_h"), "_v", centers, cuts, "_h").groupBy("_unit").count().collect():
        cuts[r["_unit"]] = 1 + r["count"] // (n // (4 * blocks) + 1)
    homes = (_with_units(hashed, "_v", centers, cuts, "_h").select(F.col(did).alias("_id"), F.col("embedding").alias("_dv"), "_unit")
             .withColumn("_db", F.col("_unit") % blocks).withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))))
    asked = _probed_units(q, "_v", centers, cuts, probes, blocks).select(
        qid, F.col("_qe").alias("_qv"), "_db", "_units", F.pmod(F.xxhash64(qid), F.lit(nq)).cast("int").alias("_qb"))
    schema = T.StructType([queries.schema[qid], docs.schema[did], T.StructField("score", T.DoubleType())])

    def kernel(qpdf: pd.DataFrame, dpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(dpdf) == 0:
            return pd.DataFrame({c: [] for c in (qid, did, "score")})
        dpdf = dpdf.sort_values("_unit", kind="stable")
        Q, D, dids = _matrix(qpdf["_qv"]), _matrix(dpdf["_dv"]), dpdf["_id"].to_numpy().astype(np.int64)
        units, starts = np.unique(dpdf["_unit"].to_numpy(), return_index=True)
        probed = np.concatenate(qpdf["_units"].to_list())
        asks = np.repeat(np.arange(len(Q)), qpdf["_units"].map(len))[np.argsort(probed, kind="stable")]
        probed = np.sort(probed)
        low, high = np.searchsorted(probed, units), np.searchsorted(probed, units, side="right")
        least, full = np.full(len(Q), -np.inf), max(1 << 20, 4 * k * len(Q))
        held, size = [], 0

        def best():
            out = _select_topk(*(np.concatenate(x) for x in zip(*held)), k)
            count = np.bincount(out[0], minlength=len(Q))
            least[count == k] = out[2][np.cumsum(count)[count == k] - 1]   # a lower score is of no use any more
            return out

        for s, e, a, b in zip(starts, [*starts[1:], len(D)], low, high):
            step = max(1, MAX_BLOCK_CELLS // (e - s))
            for t in range(a, b, step):
                r = asks[t:min(b, t + step)]
                S = Q[r] @ D[s:e].T
                x, y = np.nonzero(S >= least[r][:, None])
                held.append((r[x], dids[s + y], S[x, y]))
                size += len(x)
                if size > full:
                    held = [best()]
                    size = len(held[0][0])
        if not held:
            return pd.DataFrame({c: [] for c in (qid, did, "score")})
        rows, ids, scores = best()
        return pd.DataFrame({qid: qpdf[qid].to_numpy()[rows], did: ids, "score": scores})

    scored = asked.groupBy("_qb", "_db").cogroup(homes.groupBy("_qb", "_db")).applyInPandas(kernel, schema)
    return topk_per_query(scored, k, qid, "score", did)


def quantize_8bit(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """V9: per-dimension 8-bit scalar codes: ``min(floor(255 * (x - min_d) / (max_d - min_d)), 255)``
    with per-dimension min/max over all vectors (one vector aggregate of one row)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    as_vector = array_to_vector(F.col(vec).cast("array<double>"))
    ends = vectors.select(as_vector.alias("v")).agg(Summarizer.metrics("min", "max").summary(F.col("v")).alias("s"))
    ends = ends.select(vector_to_array("s.min").alias("_lo"), vector_to_array("s.max").alias("_hi"))
    x = vectors.select(id_col, F.col(vec).cast("array<double>").alias("_x")).crossJoin(F.broadcast(ends))   # one row
    ex = x.select(id_col, F.posexplode(F.arrays_zip("_x", "_lo", "_hi")).alias("dim", "e"))
    lo, hi = F.col("e._lo"), F.col("e._hi")
    code = F.when(hi > lo, F.least(F.floor(255 * (F.col("e._x") - lo) / (hi - lo)), F.lit(255))).otherwise(F.lit(0)).cast("int")
    return ex.select(id_col, "dim", code.alias("code"))


__all__ = ["knn_flat", "knn_balls", "document_balls", "average_rank_balls", "average_rank", "count_scores_above", "pack_vectors", "maxsim", "maxsim_join",
           "inbatch_scores", "mips_to_l2", "knn_approx", "quantize_8bit", "sq_l2"]
