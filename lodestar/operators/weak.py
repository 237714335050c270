"""Weak supervision and training-set construction (D*, J1-J3, J6, J16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def background_text(lists: DataFrame, passages: DataFrame, extra_key: str | None = None) -> DataFrame:
    """``lists(qid, pos, pid)`` -> passages joined by ``' [SEP] '`` in list order.
    ``passages(pid, passage)``; ``extra_key`` scopes pids (e.g. per conversation)."""
    keys = ["pid"] + ([extra_key] if extra_key else [])
    lk = lists if not extra_key else lists.withColumn(extra_key, F.col("qid"))
    j = lk.join(passages, keys)
    g = j.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "passage"))).alias("_p"))
    return g.select("qid", F.array_join(F.transform("_p", lambda x: x["passage"]), " [SEP] ").alias("background"))


def training_pairs(qrels: DataFrame, queries: DataFrame, metadata: DataFrame, content: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Judged pairs ``qrels(qid, did, rel)`` with the query text and both documents of the
    dataset (inner joins). Also returns the keys that are missing on some side (``left_anti``),
    which the reference treats as an error."""
    j = (qrels.join(queries, "qid").join(metadata.withColumnRenamed("document", "metadata"), "did")
         .join(content.withColumnRenamed("document", "content"), "did"))
    missing = qrels.join(j.select("qid", "did"), ["qid", "did"], "left_anti")
    return j, missing


def unannotated(datasets: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """Datasets never judged (left anti)."""
    return datasets.join(judged.select(key).distinct(), key, "left_anti")


def restrict_to_judged(rows: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """Rows whose id was judged (left semi)."""
    return rows.join(judged.select(key).distinct(), key, "left_semi")


def frequent_token_generator(docs: DataFrame, id_col: str, text_col: str, n: int = 3, min_len: int = 4) -> DataFrame:
    """D2 built-in test generator: the ``n`` most frequent lower-cased tokens (length >= min_len;
    ties alphabetical) form the pseudo query; ``loss = 1/(1+count of the top token)``."""
    from ..functions.text import tokenize
    from .ranking import topk_per_query
    from .vectors import spread_scan
    t = spread_scan(docs.select(id_col, text_col)).select(id_col, F.explode(tokenize(F.lower(F.col(text_col)))).alias("tok")) \
        .filter(F.length("tok") >= min_len)
    c = t.groupBy(id_col, "tok").agg(F.count(F.lit(1)).cast("double").alias("cnt"))
    top = topk_per_query(c, n, id_col, "cnt", "tok", rank_col="_r")
    g = top.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_r", "tok", "cnt"))).alias("_s"))
    return g.select(id_col, F.array_join(F.transform("_s", lambda x: x["tok"]), " ").alias("prediction"),
                    (1.0 / (1.0 + F.col("_s")[0]["cnt"])).alias("loss"))


def generate_queries(docs: DataFrame, generate, id_col: str = "dataset_id", text_col: str = "document",
                     judged: DataFrame | None = None, fold: str | None = None, field: str | None = None) -> DataFrame:
    """D2 hook: a user's generator over all documents that were not judged (J2), in Arrow batches.

    ``generate(list of texts) -> (predictions, losses)``, one of each per text; ``fold`` and ``field`` name the
    run and are added as columns, so runs of several folds and fields can be unioned."""
    import pandas as pd
    rows = docs if judged is None else unannotated(docs, judged, id_col)

    def kernel(it):
        for p in it:
            predictions, losses = generate(list(p[text_col]))
            if len(predictions) != len(p) or len(losses) != len(p):
                raise ValueError("the generator returned another number of texts")
            yield pd.DataFrame({id_col: p[id_col], "prediction": list(predictions), "loss": [float(x) for x in losses]})

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.select(id_col, text_col).mapInPandas(kernel, f"{id_col} {kind}, prediction string, loss double")
    for name, value in (("fold", fold), ("field", field)):
        out = out if value is None else out.withColumn(name, F.lit(value))
    return out


def confidence_filter(preds: DataFrame, threshold: float) -> DataFrame:
    """D3: drop a prediction when ``threshold > 0 and loss > threshold``."""
    if threshold > 0:
        return preds.filter(~(F.col("loss") > threshold))
    return preds


def pseudo_pairs(preds: DataFrame, id_col: str) -> DataFrame:
    """``(dataset_id, prediction)`` -> training pair ``(query, positive_id)``."""
    return preds.select(F.col("prediction").alias("query"), F.col(id_col).alias("positive_id"))


def mine_from_ranking(hits: DataFrame, key: str = "qid", order: str = "rank", positive: str = "has_answer",
                      min_each: int = 10, max_neg: int = 30) -> DataFrame:
    """Walk the hits in order; stop before a hit once ``(pos >= min_each and neg >= min_each)
    or neg >= max_neg`` (counts of earlier hits); a hit with the answer is a positive, else a hard
    negative. ``order`` must be distinct within a key (a rank).

    The counts only grow, so the kept rows are those with
    ``rank <= min(r_neg[max_neg], max(r_pos[min_each], r_neg[min_each]))`` where ``r_x[k]`` is the
    rank of the k-th such hit (infinite when there are fewer). Those k-th ranks come from top-k cuts
    (a partial ``WindowGroupLimit`` before the shuffle), so a query holding a third of all rows
    never lands in one sorted window; the cut-off table has one row per query."""
    big = F.lit(2 ** 62).cast("long")

    def kth(rows: DataFrame, k: int, name: str) -> DataFrame:
        from .ranking import topk_per_query
        top = topk_per_query(rows.select(key, F.col(order).cast("long").alias("_o")).withColumn("_s", -F.col("_o")),
                             k, key, "_s", "_o", rank_col="_k")
        return top.groupBy(key).agg(F.when(F.max("_k") >= k, F.max("_o")).alias(name))

    pos = hits.filter(F.col(positive))
    neg = hits.filter(~F.col(positive))
    cut = (kth(neg, max_neg, "_n30").join(kth(neg, min_each, "_n10"), key, "full")
           .join(kth(pos, min_each, "_p10"), key, "full"))
    limit = F.least(F.coalesce("_n30", big), F.greatest(F.coalesce("_p10", big), F.coalesce("_n10", big)))
    cut = cut.select(key, limit.alias("_limit"))
    return hits.join(cut, key, "left").filter(F.col(order) <= F.coalesce("_limit", big)).drop("_limit")


def make_triples(ranking: DataFrame, max_best: int, max_depth: int, depth: int) -> DataFrame:
    """D8 (inferred contract): positives = label 1 within ``max_depth``, at most ``max_best`` (by
    rank); negatives = label 0 within ``depth``; triples = positives x negatives of a query
    (bounded: ``max_best * depth`` per query)."""
    from pyspark.sql import Window
    w = Window.partitionBy("qid").orderBy("rank")
    pos = ranking.filter((F.col("label") == 1) & (F.col("rank") <= max_depth)).withColumn("_r", F.row_number().over(w)) \
        .filter(F.col("_r") <= max_best).select("qid", F.col("pid").alias("pos"))
    neg = ranking.filter((F.col("label") == 0) & (F.col("rank") <= depth)).select("qid", F.col("pid").alias("neg"))
    return pos.join(neg, "qid")


def compose_batch(samples: DataFrame, num_hard: int, num_other: int, batch: str = "batch") -> DataFrame:
    """Per sample the first positive, ``num_other`` negatives and ``num_hard`` hard negatives
    (falling back to the first negatives when there are no hard ones). Context indexes inside the
    batch: positive at the sample's offset, hard negatives right after its plain negatives.
    ``samples(batch, qid, positives, negatives, hard_negatives)`` with ordered id arrays."""
    from .ranking import running_offsets
    hard = F.when(F.size("hard_negatives") == 0, F.slice("negatives", 1, num_hard)).otherwise(
        F.slice("hard_negatives", 1, num_hard))
    s = samples.select(batch, "qid", F.get(F.col("positives"), 0).alias("positive"),
                       F.slice("negatives", 1, num_other).alias("negs"), hard.alias("hards"))
    s = s.withColumn("_n", (1 + F.size("negs") + F.size("hards")).cast("long"))
    s = running_offsets(s, "_n", ["qid"], partition_by=[batch], offset_col="positive_idx", hot_rows=None)
    start = F.col("positive_idx") + 1 + F.size("negs")
    return s.withColumn("hard_idx", F.transform("hards", lambda x, i: start + i)).drop("_n")


def teacher_examples(scores: DataFrame, nway: int | None = None) -> DataFrame:
    """Per query its ``(pid, score)`` in score order: the ``nway`` best (n-way example shape), or all."""
    from .ranking import rank_by_score, topk_per_query
    top = (rank_by_score(scores, "qid", "score", "pid", rank_col="_r") if nway is None
           else topk_per_query(scores, nway, "qid", "score", "pid", rank_col="_r"))
    return top.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("_r", "pid", "score"))).alias("_s")).select(
        "qid", F.transform("_s", lambda x: F.struct(x["pid"].alias("pid"), x["score"].alias("score"))).alias("pids"))


def resolve_examples(examples: DataFrame, queries: DataFrame, passages: DataFrame) -> DataFrame:
    """``examples(qid, pids array<struct<pid,score>>)`` -> query text and passage texts in the
    example's order (posexplode, join, ordered regroup; an example is bounded by n-way)."""
    ex = examples.select("qid", F.posexplode("pids").alias("pos", "p")).select("qid", "pos", F.col("p.pid").alias("pid"),
                                                                              F.col("p.score").alias("score"))
    j = ex.join(passages, "pid")
    g = j.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "passage", "score"))).alias("_s"))
    return g.join(queries, "qid").select("qid", "query", F.transform("_s", lambda x: x["passage"]).alias("passages"),
                                         F.transform("_s", lambda x: x["score"]).alias("scores"))


def canonical_question(rows: DataFrame, mapping: DataFrame, q: str = "question") -> DataFrame:
    """Replace a question by its canonical form when the mapping has one (left join)."""
    return rows.join(mapping, q, "left").withColumn(q + "_canonical", F.coalesce(F.col("canonical"), F.col(q))).drop("canonical")


def chunk_of_pid(pids: DataFrame, chunks: DataFrame, pid: str = "pid") -> DataFrame:
    """J13 (range join): chunk with ``offset <= pid < offset + n``; a pid in no chunk gets null
    (the reference raises). An equi-join on ``pid // width``: with the width of the largest chunk, a
    chunk lies in two buckets at most."""
    width = chunks.agg(F.max("n")).first()[0] or 1
    c = chunks.filter("n > 0").select("chunk", "offset", "n")
    c = c.withColumn("_b", F.explode(F.sequence(F.floor(F.col("offset") / width), F.floor((F.col("offset") + F.col("n") - 1) / width))))
    p = pids.withColumn("_b", F.floor(F.col(pid) / width))
    inside = (p["_b"] == c["_b"]) & (p[pid] >= c["offset"]) & (p[pid] < c["offset"] + c["n"])
    return p.join(c, inside, "left").select(*[p[x] for x in pids.columns], c["chunk"])


def overlap_scorer(query: Column, passage: Column) -> Column:
    """J16 built-in test scorer (a user scorer has the same shape, e.g. a pandas UDF of two text columns):
    number of distinct lower-cased tokens shared by query and passage; null for a null text."""
    from ..functions.text import tokenize
    shared = F.size(F.array_intersect(tokenize(F.lower(query)), tokenize(F.lower(passage))))
    return F.when(query.isNotNull() & passage.isNotNull(), shared.cast("double"))


def score_pairs(pairs: DataFrame, queries: DataFrame, passages: DataFrame, scorer=overlap_scorer) -> DataFrame:
    """Query and passage text per ``(qid, pid)`` pair, scored by a batch scorer (Arrow
    batches, ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows each); order-free output."""
    j = pairs.join(queries, "qid").join(passages, "pid")
    return j.select("qid", "pid", scorer(F.col("query"), F.col("passage")).alias("score"))


def inject_gold(positives: DataFrame, gold: DataFrame) -> DataFrame:
    """``positives(qid, pid, pos)`` mined in rank order; ``gold(qid, gpos, pid, has_answer)`` the
    gold candidates in file order. The first gold candidate holding an answer is put first
    (``pos = -1``, ``gold_match``)."""
    first = gold.filter("has_answer").groupBy("qid").agg(F.min_by("pid", "gpos").alias("pid"))
    g = first.select("qid", "pid", F.lit(-1).cast("long").alias("pos"), F.lit(True).alias("gold_match"))
    return positives.select("qid", "pid", F.col("pos").cast("long"), F.lit(False).alias("gold_match")).unionByName(g)


def assemble_training_tables(positives: DataFrame, hard_negatives: DataFrame, gold_tables: DataFrame | None = None) -> DataFrame:
    """Per question the positives (injected gold first, then mined), followed by the gold
    page's tables that hold an answer, and the hard negatives; lists are ordered and bounded by
    the mining stop rule and the gold page. ``gold_tables(qid, tpos, pid, has_answer)``.

    Where positives or gold tables have an ``answer_pos`` column (the cells that hold an answer, see
    ``tables.answer_positions``), the result has ``answer_pos`` too, one entry for each positive, empty where none is known."""
    parts = [(positives, "pos", 0)] + ([(gold_tables.filter("has_answer"), "tpos", 1)] if gold_tables is not None else [])
    kinds = [df.schema["answer_pos"].dataType for df, _, _ in parts if "answer_pos" in df.columns]
    listed = None
    for df, place, phase in parts:
        fields = [F.lit(phase).alias("phase"), F.col(place).cast("long").alias("pos"), F.col("pid")]
        if kinds:
            cells = F.col("answer_pos") if "answer_pos" in df.columns else F.lit(None).cast(kinds[0])
            fields.append(F.coalesce(cells, F.array().cast(kinds[0])).alias("answer_pos"))
        rows = df.select("qid", F.struct(*fields).alias("e"))
        listed = rows if listed is None else listed.unionByName(rows)
    p = listed.groupBy("qid").agg(F.array_sort(F.collect_list("e")).alias("_p"))
    n = hard_negatives.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "pid"))).alias("_n"))
    out = p.join(n, "qid", "full")

    def ids(column, field):
        return F.coalesce(F.transform(column, lambda x: x[field]), F.array())

    return out.select("qid", ids("_p", "pid").alias("positive_ids"), *([ids("_p", "answer_pos").alias("answer_pos")] if kinds else []),
                      ids("_n", "pid").alias("hard_negative_ids"))
