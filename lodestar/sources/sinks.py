"""Writers for the reference's output formats (K1-K15). Distributed writes: one file per task;
nothing is collected. Nested JSON is built with ``array_sort(collect_list(struct))`` over groups
that are bounded by the ranking depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_control


def tsv_line(*cols) -> F.Column:
    """Raw TSV line (no quoting); null fields become empty; booleans 0/1."""
    def one(c):
        c = F.col(c) if isinstance(c, str) else c
        return F.coalesce(c.cast("string"), F.lit(""))
    return F.concat_ws("\t", *[one(c) for c in cols])


def write_tsv(df: DataFrame, path: str, cols: list, mode: str = "overwrite") -> None:
    df.select(tsv_line(*cols).alias("value")).write.mode(mode).text(path)


def write_header_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Raw TSV (no quoting, null fields empty) whose every file begins with a header line of the column names."""
    raw = {"sep": "\t", "quote": "", "escape": "", "header": "true", "nullValue": "", "emptyValue": "",
           "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    df.write.mode(mode).options(**raw).csv(path)


def write_ranking(ranking: DataFrame, path: str, provenance: dict | None = None) -> None:
    """K1: TSV ``qid, pid, rank[, score][, label]`` with booleans as 0/1, plus a one-row JSON
    provenance side file."""
    cols = [c if ranking.schema[c].dataType.typeName() != "boolean" else F.col(c).cast("int") for c in ranking.columns]
    write_tsv(ranking, path, cols)
    if provenance is not None:
        spark = ranking.sparkSession
        spark.createDataFrame([tuple(str(v) for v in provenance.values())], list(provenance.keys())) \
            .coalesce(1).write.mode("overwrite").json(path + ".meta")


def write_examples(examples: DataFrame, path: str) -> None:
    """K2: JSONL arrays ``[qid, [pid, score], ...]``, or ``[qid, pid, ...]`` where there are no scores."""
    pairs = F.transform("pids", lambda x: F.when(x["score"].isNull(), x["pid"].cast("string")).otherwise(
        F.concat(F.lit("["), x["pid"].cast("string"), F.lit(","), x["score"].cast("string"), F.lit("]"))))
    line = F.concat(F.lit("["), F.array_join(F.concat(F.array(F.col("qid").cast("string")), pairs), ","), F.lit("]"))
    examples.select(line.alias("value")).write.mode("overwrite").text(path)


def results_nested(hits: DataFrame, questions: DataFrame, passages: DataFrame | None = None) -> DataFrame:
    """K3/K4: ``{question, answers, ctxs: [{id, title, text, score (string), has_answer}]}`` in
    rank order. ``hits(qid, pid, rank, score, has_answer)``; with ``passages(pid, title, text)``
    the texts are joined (K3), otherwise they are carried on the hit (K4)."""
    h = hits if passages is None else hits.join(passages, "pid")
    ctx = F.struct(F.col("rank"), F.col("pid").cast("string").alias("id"), F.col("title"), F.col("text"),
                   F.col("score").cast("string").alias("score"), F.col("has_answer"))
    g = h.groupBy("qid").agg(F.array_sort(F.collect_list(ctx)).alias("_c"))
    g = g.select("qid", F.transform("_c", lambda c: c.dropFields("rank")).alias("ctxs"))
    return questions.join(g, "qid").select("qid", "question", "answers", "ctxs")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_kilt(results: DataFrame, mapping: DataFrame, path: str, gold: DataFrame | None = None, order: str = "qid") -> DataFrame:
    """K5: ctx ids mapped to ``(wikipedia_id, end_paragraph_id)``; id/input from the results, or from
    ``gold(pos, id, input)`` by position: result number ``pos`` (from 0, by ``order``); sizes must agree."""
    if gold is not None:
        from ..operators.ranking import zip_index
        placed = zip_index(results, [order], "_pos")
        if placed.count() != gold.count():
            raise ValueError("results and gold file differ in size")
        results = placed.join(gold, F.col("_pos") == F.col("pos")).drop("qid", "question", "_pos", "pos") \
            .withColumnsRenamed({"id": "qid", "input": "question"})
    ex = results.select("qid", "question", F.posexplode("ctxs").alias("pos", "c"))
    j = ex.join(mapping, F.col("c.id") == mapping["ctx_id"], "left")
    g = j.groupBy("qid", "question").agg(F.array_sort(F.collect_list(F.struct("pos", "wikipedia_id", "end_paragraph_id"))).alias("_p"))
    out = g.select(F.col("qid").alias("id"), F.col("question").alias("input"),
                   F.array(F.struct(F.transform("_p", lambda p: F.struct(p["wikipedia_id"].alias("wikipedia_id"),
                                                                         p["end_paragraph_id"].alias("end_paragraph_id"))).alias("provenance"))).alias("output"))
    write_json(out, path)
    return out


def write_compact_docs(docs: DataFrame, path: str) -> None:
    """K6: TSV ``dataset_id, document`` in ascending id (range-partitioned sort, one file per range)."""
    docs.orderBy("dataset_id").select(tsv_line("dataset_id", strip_control("document")).alias("value")).write.mode("overwrite").text(path)


def write_predictions(preds: DataFrame, path: str) -> None:
    """K7: ``[{dataset_id, prediction}]`` (JSON lines of the same records)."""
    write_json(preds.select("dataset_id", "prediction"), path)


def write_teacher_scores(examples: DataFrame, path: str) -> None:
    """K8: JSONL ``[qid, [[score, pid], ...]]``."""
    pairs = F.transform("pids", lambda x: F.concat(F.lit("["), x["score"].cast("string"), F.lit(","), x["pid"].cast("string"), F.lit("]")))
    line = F.concat(F.lit("["), F.col("qid").cast("string"), F.lit(",["), F.array_join(pairs, ","), F.lit("]]"))
    examples.select(line.alias("value")).write.mode("overwrite").text(path)


def metrics_nested(means: DataFrame) -> DataFrame:
    """K9: ``{mrr: {depth: v}, success: {...}, recall: {...}}`` from columns named
    ``<measure>_<depth>`` (one row)."""
    groups: dict[str, list] = {}
    for c in means.columns:
        m, _, depth = c.rpartition("_")
        groups.setdefault(m, []).append((depth, c))
    return means.select(*[F.create_map(*[x for depth, c in items for x in (F.lit(depth), F.col(c))]).alias(m)
                          for m, items in groups.items()])


def write_ctxmatch_shards(rows: DataFrame, path: str, shard_size: int = 3000) -> DataFrame:
    """``{id, question, context}``, one positive per question, shards of ``shard_size``."""
    from ..operators.ranking import zip_index
    idx = zip_index(rows, ["id"], "_i").withColumn("shard", F.floor(F.col("_i") / shard_size).cast("long")).drop("_i")
    idx.write.mode("overwrite").partitionBy("shard").json(path)
    return idx


def write_qas_tsv(qas: DataFrame, path: str) -> DataFrame:
    """``id (from 1), question, answers-list`` TSV."""
    from ..operators.ranking import zip_index
    out = zip_index(qas, ["question"], "_i").select((F.col("_i") + 1).alias("id"), "question", F.to_json("answers").alias("answers"))
    write_tsv(out, path, ["id", "question", "answers"])
    return out


def write_collection(coll: DataFrame, path: str) -> None:
    """``pid, passage`` TSV (control characters replaced)."""
    write_tsv(coll.orderBy("pid"), path, ["pid", strip_control("passage")])


def write_queries(queries: DataFrame, path: str) -> None:
    """``qid, query`` TSV (control characters replaced)."""
    write_tsv(queries.orderBy("qid"), path, ["qid", strip_control("query")])


def write_qas(qas: DataFrame, path: str) -> None:
    """JSON lines ``{qid, question, answers}`` in ascending id."""
    write_json(qas.orderBy("qid").select("qid", "question", "answers"), path)


def write_tables_csv(tables: DataFrame, path: str) -> DataFrame:
    """``id (from 1), table text, caption`` TSV; the text is the rows' cells joined by `` . ``, closed by one."""
    from ..operators.ranking import zip_index
    numbered = zip_index(tables, ["doc_id", "table_id"], "_i")
    text = F.concat(F.array_join(F.transform("rows", lambda r: F.array_join(r, " . ")), ""), F.lit(" . "))
    out = numbered.select((F.col("_i") + 1).alias("id"), strip_control(text).alias("text"), strip_control("caption").alias("caption"))
    write_tsv(out, path, ["id", "text", "caption"])
    return out


def write_ranking_columns(ranking: DataFrame, path: str) -> None:
    """K1 (column form): the ranking as Parquet, types kept."""
    ranking.write.mode("overwrite").parquet(path)


def write_vectors(vectors: DataFrame, path: str, num_shards: int) -> DataFrame:
    """``(id, embedding)`` Parquet, one folder per range shard."""
    from ..operators.ranking import assign_shards_range
    s = assign_shards_range(vectors, num_shards, ["id"])
    s.write.mode("overwrite").partitionBy("shard").parquet(path)
    return s
