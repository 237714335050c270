"""Candidate generation, staged pruning and rescoring over the compressed index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import topk_per_query


def rerank_to_trec(scored: DataFrame, k: int, tag: str, qid: str = "qid", pid: str = "pid") -> DataFrame:
    """Keep the top ``k`` re-scored candidates per query and emit a TREC run
    ``(qid, Q0, docid, rank, score, tag)`` (ids as strings)."""
    top = topk_per_query(scored.select(qid, pid, "score"), k, qid, "score", pid)
    return top.select(F.col(qid).cast("string").alias("qid"), F.lit("Q0").alias("q0"),
                      F.col(pid).cast("string").alias("docid"), F.col("rank"), F.col("score"), F.lit(tag).alias("tag"))


# ---- three-stage search over the compressed index ---------------------------------------------

import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from .codebook import _cut, _top  # noqa: E402
from .index import Index, decompress  # noqa: E402
from .vectors import maxsim, pack_vectors, spread  # noqa: E402


def search_tier(k: int, ncells: int | None = None, threshold: float | None = None,
                ndocs: int | None = None) -> tuple[int, float, int]:
    """V26 tiers (a pure function of k; explicit values override):
    k<=10: 1 cell, 0.5, 256; k<=100: 2, 0.45, 1024; else 4, 0.4, max(4k, 4096)."""
    # fixed values that must equal the reference's
    if k <= 10:
        t = (1, 0.5, 256)
    elif k <= 100:
        t = (2, 0.45, 1024)
    else:
        t = (4, 0.4, max(4 * k, 4096))
    return (ncells if ncells is not None else t[0], threshold if threshold is not None else t[1],
            ndocs if ndocs is not None else t[2])


def probe_cells(qpacked: DataFrame, index: Index, ncells: int) -> DataFrame:
    """Per query vector the ``ncells`` best centroids; distinct ``(qid, code)`` per query."""
    spark = qpacked.sparkSession
    dim = index.codec.dim
    if not index.codec.fits:
        return _probe_lists(qpacked, index, ncells)
    bc = index.codec.broadcast(spark)

    def kernel(it):
        C, _, _ = bc.value
        for p in it:
            rows = []
            for qid, qv in zip(p["qid"], p["qvecs"]):
                Q = np.asarray(qv, np.float64).reshape(-1, dim)
                S = Q @ C.T
                n = min(ncells, C.shape[0])
                for code in np.unique(_top(S, np.arange(C.shape[0]), n)):      # ties to the smaller code
                    rows.append((qid, int(code)))
            yield pd.DataFrame(rows, columns=["qid", "code"]).astype({"code": "int32"})

    schema = T.StructType([qpacked.schema["qid"], T.StructField("code", T.IntegerType())])
    return spread(qpacked.select("qid", "qvecs")).mapInPandas(kernel, schema)


def _probe_lists(qpacked: DataFrame, index: Index, ncells: int) -> DataFrame:
    """V20 where the centroids are too many to be broadcast: the same cells by the two-level codebook."""
    from .codebook import nearest_codes
    dim = index.codec.dim
    one = F.slice("qvecs", F.col("k") * dim + 1, dim).cast("array<double>")
    each = qpacked.select("qid", "qvecs", F.explode(F.sequence(F.lit(0), (F.size("qvecs") / dim).cast("int") - 1)).alias("k"))
    each = each.select(F.col("qid"), F.to_json(F.struct("qid", "k")).alias("id"), one.alias("embedding"))
    codes = nearest_codes(each.select("id", "embedding"), index.codec.book(), ncells)
    return codes.join(each.select("id", "qid"), "id").select("qid", "code").distinct()


#: Passages of a list, and candidates of a query, that one task's group holds.
LIST_ROWS, SLICE = 1 << 17, 1 << 13
#: Codes whose scores for one query are worked out together.
CODE_PART = 1 << 13


def _sliced(probes: DataFrame, rows: DataFrame, list_rows: int) -> tuple[DataFrame, DataFrame]:
    """Probes and list rows with a ``_salt``: a list has as many slices as its length asks for, and its probes meet each."""
    slices = rows.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / list_rows).cast("long").alias("_n")).filter("_n > 1")
    slices = _cut(slices)      # one row per long list
    if slices.isEmpty():
        return probes.withColumn("_salt", F.lit(0).cast("long")), rows.withColumn("_salt", F.lit(0).cast("long"))
    n = F.coalesce("_n", F.lit(1).cast("long"))
    cut = rows.join(slices, "code", "left").withColumn("_salt", F.pmod(F.xxhash64("pid"), n)).drop("_n")
    asked = probes.join(slices, "code", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("_n")
    return asked, cut


def generate_candidates(probes: DataFrame, ivf: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """Distinct ``(qid, pid)`` of the probed cells. Long lists (a hot cell may hold a third of all
    passages) are cut into slices of about ``list_rows`` passages, each probed by a task of its own."""
    pr, lists = _sliced(probes, ivf.select("code", "pid"), list_rows)
    return pr.join(lists, ["code", "_salt"]).select("qid", "pid").distinct()


def generate_embedding_candidates(probes: DataFrame, codes: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """V21 (embedding level): distinct ``(qid, pid, tok_pos)`` of the token vectors in the probed cells."""
    pr, lists = _sliced(probes, codes.select("code", "pid", "tok_pos"), list_rows)
    return pr.join(lists, ["code", "_salt"]).select("qid", "pid", "tok_pos").distinct()


def filter_candidates(cands: DataFrame, allowed: DataFrame | None = None, predicate=None) -> DataFrame:
    """Keep candidates in ``allowed(pid)`` (semi-join) and/or matching a Column predicate."""
    out = cands
    if allowed is not None:
        out = out.join(allowed.select("pid").distinct(), "pid", "left_semi")
    if predicate is not None:
        out = out.filter(predicate)
    return out


def doc_codes(index: Index) -> DataFrame:
    """Distinct codes per passage (bounded by the passage length); stored with a built index."""
    if index.pid_codes is not None:
        return index.pid_codes
    return index.codes.groupBy("pid").agg(F.array_distinct(F.collect_list("code")).alias("codes"))


def code_scores(met: DataFrame, qpacked: DataFrame, index: Index, threshold: float | None) -> DataFrame:
    """``(qid, nq, codes, scores)``: scores of the codes that a query's candidates hold, ``met(qid, code)`` distinct.

    For codecs that are too large to be broadcast: the met centroids come by join, a query's codes in parts of
    bounded size. Codes whose best score stays below ``threshold`` are left out. ``scores`` holds ``nq`` values for each code."""
    dim = index.codec.dim
    parts = max(1, -(-index.codec.centroids.count() // CODE_PART))
    rows = met.withColumn("part", F.pmod(F.col("code"), F.lit(parts)))
    held = F.sort_array(F.collect_list(F.struct("code", "centroid")))
    grouped = rows.join(index.codec.centroids.select("code", "centroid"), "code").groupBy("qid", "part").agg(held.alias("h"))
    j = grouped.select("qid", F.col("h.code").alias("codes"), F.flatten("h.centroid").alias("centroids")).join(qpacked.select("qid", "qvecs"), "qid")
    schema = T.StructType([j.schema["qid"], T.StructField("nq", T.IntegerType()), T.StructField("codes", T.ArrayType(T.IntegerType())),
                           T.StructField("scores", T.ArrayType(T.DoubleType()))])

    def kernel(it):
        for p in it:
            out = []
            for qid, codes, centroids, vectors in zip(p["qid"], p["codes"], p["centroids"], p["qvecs"]):
                codes, S = _kept(np.asarray(codes, np.int64), np.asarray(centroids, np.float64).reshape(-1, dim), vectors, threshold)
                out.append((qid, S.shape[1], codes.astype(np.int32), S.ravel()))
            yield pd.DataFrame(out, columns=["qid", "nq", "codes", "scores"])

    return spread(j, "qid").mapInPandas(kernel, schema)


def _kept(codes: np.ndarray, C: np.ndarray, vectors, threshold: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Scores of each code (rows) for each query vector; only codes whose best score reaches the threshold."""
    S = C @ np.asarray(vectors, np.float64).reshape(-1, C.shape[1]).T
    if threshold is None:
        return codes, S
    kept = S.max(1) >= threshold
    return codes[kept], S[kept]


def _best_sums(lists: list[np.ndarray], codes: np.ndarray, M: np.ndarray, nq: int) -> np.ndarray:
    """Per list of codes: the best score of its codes (those in ``codes``, ascending) for each query vector, summed."""
    sizes = np.array([len(x) for x in lists])
    ends, out, s = np.cumsum(sizes), np.empty(len(lists)), 0
    while s < len(lists):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + max(1, (1 << 21) // nq), side="right")))
        flat, row = np.concatenate(lists[s:e]), np.repeat(np.arange(e - s), sizes[s:e])
        best = np.full((e - s, nq), -9999.0)
        if len(codes):
            at = np.minimum(np.searchsorted(codes, flat), len(codes) - 1)
            hit = codes[at] == flat
            at, row = at[hit], row[hit]
            if len(row):
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                best[row[first]] = np.maximum.reduceat(M[at], first, axis=0)
        out[s:e] = best.sum(1)
        s = e
    return out


def approx_scores(cands: DataFrame, qpacked: DataFrame, dcodes: DataFrame, index: Index,
                  threshold: float | None, slice_rows: int = SLICE) -> DataFrame:
    """V23/V24 scores, code-major: sum over query vectors of the best score of the passage's codes (those that reach
    the ``threshold``, if there is one); -9999 for a query vector where none is kept.

    Candidate rows carry ids and codes only. A query with many candidates is cut into slices, slices are dealt into cells
    of about ``slice_rows`` candidates, and what the query brings is sent once to each of its slices: its
    vectors, which score the codes met there with the broadcast centroids, or, for a codec too large for that, its table
    of code scores (:func:`code_scores`). Passages then look their codes up."""
    cands = _cut(cands.select("qid", "pid"))       # thin; counted, scored and told from one copy
    spark, codec, dim = cands.sparkSession, index.codec, index.codec.dim
    counts = cands.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    told = counts.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    cells = F.lit(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(told["all"] or 0) // slice_rows)))
    slices = counts.select("qid", F.ceil(F.col("n") / slice_rows).cast("long").alias("_n"))

    def sliced(df, slice_of):
        """With the number of slices of each query; no join where each query is one slice."""
        if (told["most"] or 0) <= slice_rows:
            return df.withColumn("_s", F.lit(0).cast("long"))
        return df.join(slices, "qid").withColumn("_s", slice_of).drop("_n")

    rows = sliced(cands, F.pmod(F.xxhash64("pid"), F.col("_n"))).join(dcodes, "pid")
    if codec.fits:
        bc, brought = codec.broadcast(spark), qpacked.select("qid", "qvecs")
    else:
        bc, brought = None, code_scores(rows.select("qid", F.explode("codes").alias("code")).distinct(), qpacked, index, threshold)
    brought = sliced(brought, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    schema = T.StructType([rows.schema["qid"], rows.schema["pid"], T.StructField("approx", T.DoubleType())])

    def kernel(c: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        out, places = np.empty(len(c)), t.groupby("qid", sort=False).indices
        for qid, at in c.groupby("qid", sort=False).indices.items():
            lists, own = [np.asarray(x, np.int64) for x in c["codes"].iloc[at]], places[qid]
            if bc is not None:
                met = np.unique(np.concatenate(lists))
                codes, M = _kept(met, bc.value[0][met], t["qvecs"].iat[own[0]], threshold)
                nq = M.shape[1]
            else:       # parts of a query's table; slices of a query that share a cell bring it twice
                nq = int(t["nq"].iat[own[0]])
                codes = np.concatenate([np.asarray(t["codes"].iat[i], np.int64) for i in own])
                M = np.concatenate([np.asarray(t["scores"].iat[i], np.float64).reshape(-1, nq) for i in own])
                codes, first = np.unique(codes, return_index=True)
                M = M[first]
            out[at] = _best_sums(lists, codes, M, nq)
        return pd.DataFrame({"qid": c["qid"], "pid": c["pid"], "approx": out})

    cell = F.pmod(F.xxhash64("qid", "_s"), cells).alias("_cell")
    left = rows.select("qid", "pid", "codes", cell).groupBy("_cell")
    return left.cogroup(brought.withColumn("_cell", cell).drop("_s").groupBy("_cell")) \
        .applyInPandas(kernel, schema)


SCORE_DIGITS = 10  # scores are rounded before ranking: equal scores then tie by pid on any engine


def prune(scored: DataFrame, ndocs: int) -> DataFrame:
    """Keep the ``ndocs`` best per query (ties by pid); never more than exist."""
    scored = scored.withColumn("approx", F.round("approx", SCORE_DIGITS))
    return topk_per_query(scored, ndocs, "qid", "approx", "pid", rank_col="_r").drop("_r")


def rescore(survivors: DataFrame, qpacked: DataFrame, index: Index) -> DataFrame:
    """Decompress the survivors' vectors and score them exactly with maxsim."""
    toks = decompress(index.codes.join(survivors.select("pid").distinct(), "pid", "left_semi"), index.codec)
    dpacked = pack_vectors(toks, "pid", "tok_pos", "embedding", "dvecs")
    out = maxsim(survivors.select("qid", "pid"), qpacked, dpacked, index.codec.dim)
    return out.withColumn("score", F.round("score", SCORE_DIGITS))


def search_all(queries: DataFrame, index: Index, k: int, ncells: int | None = None, threshold: float | None = None,
               ndocs: int | None = None, query_maxlen: int = 32, allowed: DataFrame | None = None) -> DataFrame:
    """All queries in one set-based plan: probe cells -> candidates -> stage 1 (threshold,
    ``ndocs``) -> stage 2 (all codes, ``ndocs/4``) -> decompress + maxsim -> top ``k``.
    ``queries(qid, qtok, embedding)``: the first ``query_maxlen`` vectors of a query probe cells and score
    centroids; the final score takes all of its vectors."""
    nc, thr, nd = search_tier(k, ncells, threshold, ndocs)
    qpacked = pack_vectors(queries.filter(F.col("qtok") < query_maxlen), "qid", "qtok", "embedding", "qvecs")
    cands = generate_candidates(probe_cells(qpacked, index, nc), index.ivf)
    cands = filter_candidates(cands, allowed)
    dcodes = doc_codes(index)
    s1 = prune(approx_scores(cands, qpacked, dcodes, index, thr), nd)
    s2 = prune(approx_scores(s1.select("qid", "pid"), qpacked, dcodes, index, None), max(nd // 4, 1))
    final = rescore(s2, pack_vectors(queries, "qid", "qtok", "embedding", "qvecs"), index)
    return topk_per_query(final, k, "qid", "score", "pid")
