"""Readers for the reference's file formats (S1-S25), all lazy DataFrame reads with fixed schemas.

Positional TSV files are read with the CSV source (tab separator, quoting off: the files carry
raw text) or as text lines when the number of columns varies. Checks that the reference makes
with ``assert`` are separate functions returning violation rows, so a caller decides whether to
fail; ``read_queries`` offers the failing form directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TSV = {"sep": "\t", "quote": "", "escape": "", "header": "false", "mode": "PERMISSIVE"}


def _tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.options(**TSV).schema(schema).csv(path)


def line_order() -> F.Column:
    """Order of lines across files: file name, then position (ids grow within a file split)."""
    return F.struct(F.input_file_name(), F.monotonically_increasing_id())


def read_queries(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """``qid, query, *ignored``; a repeated qid is an error."""
    df = spark.read.options(**TSV).csv(path)
    out = df.select(F.col("_c0").cast("long").alias("qid"), F.col("_c1").alias("query"))
    if check:
        dup = out.groupBy("qid").count().filter("count > 1").limit(1).count()
        if dup:
            raise ValueError("repeated qid in queries")
    return out


QAS_SCHEMA = "qid long, question string, answers array<string>"


def read_qas_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line keyed by ``qid`` with the text in ``question``."""
    return spark.read.schema(QAS_SCHEMA).json(path)


def read_collection(spark: SparkSession, path: str, with_title: bool = False) -> DataFrame:
    """S3: ``pid, passage[, title]``; with a title the passage is ``title | passage``."""
    schema = "pid long, passage string, title string" if with_title else "pid long, passage string"
    df = _tsv(spark, path, schema)
    if with_title:
        df = df.select("pid", F.concat_ws(" | ", "title", "passage").alias("passage"))
    return df


def collection_density_violations(coll: DataFrame) -> DataFrame:
    """S3 check: pids must be exactly ``0..n-1`` (line numbers)."""
    s = coll.agg(F.min("pid").alias("lo"), F.max("pid").alias("hi"), F.count(F.lit(1)).alias("n"),
                 F.countDistinct("pid").alias("nd"))
    return s.filter((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("nd") != F.col("n")))


def read_qrels_binary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``qid 0 pid 1``; pids de-duplicated per query. Returns (qrels, rows breaking the
    0/1 columns)."""
    df = _tsv(spark, path, "qid long, z long, pid long, one long")
    bad = df.filter((F.col("z") != 0) | (F.col("one") != 1))
    return df.select("qid", "pid").dropDuplicates(["qid", "pid"]), bad


def read_qrels_graded(spark: SparkSession, path: str) -> DataFrame:
    """``qid 0 docid rel``; the last line of a repeated ``(qid, docid)`` wins."""
    df = _tsv(spark, path, "qid string, iter string, docid string, rel int").withColumn("_o", line_order())
    return df.groupBy("qid", "docid").agg(F.max_by("rel", "_o").alias("rel"))


def read_fold_qrels(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One file per split; rows with ``rel = 0`` dropped; ``(qid, did, rel, split)``."""
    out = None
    for split, p in paths.items():
        df = _tsv(spark, p, "qid long, iter string, did long, rel int").select("qid", "did", "rel").withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df)
    return out.filter(F.col("rel") != 0)


def read_topk(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``qid, pid, query, passage``. Returns (rows, violations): a qid with several query
    texts, or a pid repeated within a qid."""
    df = _tsv(spark, path, "qid long, pid long, query string, passage string")
    multi_q = df.groupBy("qid").agg(F.countDistinct("query").alias("n")).filter("n > 1").select("qid", F.lit("query").alias("what"))
    dup_p = df.groupBy("qid", "pid").count().filter("count > 1").select("qid", F.lit("pid").alias("what"))
    return df, multi_q.unionByName(dup_p)


def read_topk_pids(spark: SparkSession, path: str, has_label: bool, qrels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``qid, pid, rest...``; with labels the last column is 0/1 and label-1 rows are the
    positives, otherwise ``qrels(qid, pid)`` are (labels and separate judgements exclude each other); every
    qid gets a (possibly empty) positive list. Returns (ranking, positives)."""
    if has_label and qrels is not None:
        raise ValueError("a labelled file has its own judgements: give no qrels")
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    df = lines.select(F.get("f", 0).cast("long").alias("qid"), F.get("f", 1).cast("long").alias("pid"),
                      (F.try_element_at("f", F.lit(-1)).cast("int") if has_label else F.lit(None).cast("int")).alias("label"))
    if qrels is not None:
        given = qrels.groupBy("qid").agg(F.array_sort(F.collect_list("pid")).alias("positives"))
        pos = df.select("qid").distinct().join(given, "qid", "left").select("qid", F.coalesce("positives", F.array().cast("array<bigint>")).alias("positives"))
    else:
        pos = df.groupBy("qid").agg(F.array_sort(F.collect_list(F.when(F.col("label") == 1, F.col("pid")))).alias("positives"))
    return df.select("qid", "pid"), pos


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    """Untyped fields: a field with ``.`` is a float, otherwise an integer."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f"))

    def typed(i):
        v = F.get("f", i)
        return F.when(v.contains("."), v.cast("double")).otherwise(v.cast("long").cast("double"))
    return lines.select(F.get("f", 0).cast("long").alias("qid"), F.get("f", 1).cast("long").alias("pid"),
                        F.get("f", 2).cast("long").alias("rank"), typed(3).alias("score"))


def read_trec_run(spark: SparkSession, path: str) -> DataFrame:
    """``qid Q0 docid rank score tag``; last line wins per ``(qid, docid)``."""
    df = _tsv(spark, path, "qid string, q0 string, docid string, rank int, score double, tag string").withColumn("_o", line_order())
    return df.groupBy("qid", "docid").agg(F.max_by(F.struct("rank", "score", "tag"), "_o").alias("_r")).select(
        "qid", "docid", "_r.rank", "_r.score", "_r.tag")


def read_examples(spark: SparkSession, path: str, nway: int) -> DataFrame:
    """JSON arrays ``[qid, pid, ...]`` or ``[qid, [pid, score], ...]`` cut to ``nway + 1``."""
    raw = spark.read.text(path).select(F.from_json("value", "array<string>").alias("a"))
    items = F.slice(F.col("a"), 2, nway)

    def item(x):
        arr = F.from_json(x, "array<string>")
        return F.when(x.startswith("["), F.struct(F.get(arr, 0).cast("long").alias("pid"), F.get(arr, 1).cast("double").alias("score"))) \
            .otherwise(F.struct(x.cast("long").alias("pid"), F.lit(None).cast("double").alias("score")))
    return raw.select(F.get("a", 0).cast("long").alias("qid"), F.transform(items, item).alias("pids"))


def read_text_triples(spark: SparkSession, path: str) -> DataFrame:
    """``query, positive, negative`` texts."""
    return _tsv(spark, path, "query string, positive string, negative string")


def read_ctx_csv(spark: SparkSession, path: str, id_prefix: str = "", normalize: bool = False) -> DataFrame:
    """``id, text, title`` with a header row whose id is ``id`` (skipped); ``"`` stripped from
    the text ends; ids prefixed."""
    df = _tsv(spark, path, "id string, text string, title string").filter(F.col("id") != "id")
    text = F.regexp_replace("text", r'^"+|"+$', "")
    if normalize:
        from ..functions.text import normalize_passage
        text = normalize_passage(text)
    from ..functions.text import prefix_id
    return df.select(prefix_id("id", id_prefix).alias("id") if id_prefix else F.col("id"), text.alias("text"), "title")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _literal_list(s):
    """Answers cell written as a Python list literal: parsed with ``ast.literal_eval`` (never eval)."""
    import ast

    import pandas as pd

    def one(x):
        if x is None:
            return None
        try:
            v = ast.literal_eval(x)
        except (ValueError, SyntaxError):
            return None
        return [str(a) for a in v] if isinstance(v, (list, tuple)) else None
    return pd.Series([one(x) for x in s])


def read_qa_csv(spark: SparkSession, path: str, start: int | None = None, size: int | None = None) -> DataFrame:
    """``question, answers-list-literal[, id]``; optional row range by line number."""
    df = spark.read.options(**TSV).csv(path)
    out = df.select(F.col("_c0").alias("question"), _literal_list(F.col("_c1")).alias("answers"))
    if start is not None:
        from ..operators.sets import row_range
        out = row_range(out.withColumn("_o", line_order()), ["_o"], start, start + (size or 1 << 62)).drop("_o")
    return out


def read_qa_jsonl(spark: SparkSession, path: str, question_attr: str = "question", answers_attr: str = "answers",
                  id_attr: str = "id") -> DataFrame:
    """Missing answers become ``[]``."""
    schema = T.StructType([T.StructField(question_attr, T.StringType()), T.StructField(answers_attr, T.ArrayType(T.StringType())),
                           T.StructField(id_attr, T.StringType())])
    df = spark.read.schema(schema).json(path)
    return df.select(F.col(question_attr).alias("question"),
                     F.coalesce(F.col(answers_attr), F.array().cast("array<string>")).alias("answers"), F.col(id_attr).alias("id"))


def read_kilt_qa(spark: SparkSession, path: str) -> DataFrame:
    """Question from ``input``; answers = ``output[].answer`` where present."""
    schema = "id string, input string, output array<struct<answer:string>>"
    df = spark.read.schema(schema).json(path)
    return df.select("id", F.col("input").alias("question"),
                     F.filter(F.transform("output", lambda o: o["answer"]), lambda a: a.isNotNull()).alias("answers"))


def read_kilt_qa_csv(spark: SparkSession, csv_path: str, kilt_path: str) -> DataFrame:
    """S16 (CSV form): the questions and answer lists of a QA file with the ids of the KILT records, matched by
    question text; records without answers in the CSV are left out."""
    gold = read_kilt_qa(spark, kilt_path).select("id", "question")
    return read_qa_csv(spark, csv_path).join(gold, "question").select("id", "question", "answers")


def read_asr_qa(spark: SparkSession, transcripts: str, originals: DataFrame) -> DataFrame:
    """Transcript lines ``text(None-<id>)``: id after ``(None-``; text lower-cased and trimmed;
    joined to the original questions on that id (the id, not a character offset)."""
    t = spark.read.text(transcripts).select(
        F.regexp_extract("value", r"\(None-([^)]*)\)\s*$", 1).alias("id"),
        F.lower(F.trim(F.regexp_replace("value", r"\(None-[^)]*\)\s*$", ""))).alias("question"))
    return t.join(originals.select(F.col("id").cast("string").alias("id"), "answers"), "id")


CTX = "struct<id:string,title:string,text:string,score:double>"
BIENC_SCHEMA = f"question string, answers array<string>, positive_ctxs array<{CTX}>, negative_ctxs array<{CTX}>, hard_negative_ctxs array<{CTX}>"


def read_biencoder_jsonl(spark: SparkSession, path: str, exclude_gold: bool = False, whole_file: bool = False,
                         start: int | None = None, size: int | None = None) -> DataFrame:
    """Samples without positives are dropped; with ``exclude_gold`` only positives that have
    a score are kept when there is at least one. ``whole_file``: each file is one JSON array. ``start`` and
    ``size`` take a range of the lines, before any are dropped."""
    df = spark.read.schema(BIENC_SCHEMA).option("multiLine", whole_file).json(path)
    if start is not None:
        from ..operators.sets import row_range
        df = row_range(df.withColumn("_o", line_order()), ["_o"], start, start + (size or 1 << 62)).drop("_o")
    df = df.filter(F.size("positive_ctxs") > 0)
    if exclude_gold:
        scored = F.filter("positive_ctxs", lambda c: c["score"].isNotNull())
        df = df.withColumn("positive_ctxs", F.when(F.size(scored) > 0, scored).otherwise(F.col("positive_ctxs")))
    return df


def read_encoded_vectors(spark: SparkSession, paths: list[str], prefixes: list[str]) -> DataFrame:
    """Union of vector shard files; each file's ids get its prefix unless already present."""
    out = None
    for p, pre in zip(paths, prefixes):
        df = spark.read.parquet(p)
        sid = F.col("id").cast("string")
        df = df.withColumn("id", F.when(sid.startswith(pre), sid).otherwise(F.concat(F.lit(pre), sid)))
        out = df if out is None else out.unionByName(df)
    return out


def read_id_text(spark: SparkSession, path: str, judged: DataFrame | None = None) -> DataFrame:
    """Header TSV ``id, text``; kept only for judged ids when given (left semi)."""
    df = spark.read.options(**{**TSV, "header": "true"}).schema("id long, text string").csv(path)
    return df.join(judged.select("id").distinct(), "id", "left_semi") if judged is not None else df


def read_token_tables_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``tokens, html_mask, title`` documents."""
    return spark.read.schema("tokens array<string>, html_mask array<int>, title string").json(path)


def read_gold_passages(spark: SparkSession, path: str) -> DataFrame:
    """JSON ``{data: [...]}``; both the question and its tokenised form map to the gold
    passage (title lower-cased); the last duplicate wins."""
    schema = "data array<struct<question:string,question_tokens:string,title:string,context:string,example_id:string>>"
    df = spark.read.schema(schema).option("multiLine", "true").json(path)
    ex = df.withColumn("_f", F.input_file_name()).select("_f", F.posexplode("data").alias("_p", "g")) \
        .select(F.struct("_f", "_p").alias("pos"), "g")      # last = greatest (file, position)
    keys = ex.select(F.col("g.question").alias("key"), "pos", "g").unionByName(
        ex.select(F.col("g.question_tokens").alias("key"), "pos", "g"))
    best = keys.groupBy("key").agg(F.max_by("g", "pos").alias("g"))
    return best.select("key", F.lower("g.title").alias("title"), F.col("g.context").alias("context"),
                       F.col("g.example_id").alias("example_id"))


def read_portal_metadata(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of dataset metadata; ``tags`` is a JSON array inside a string."""
    schema = "dataset_id string, title string, description string, author string, tags string, url string"
    df = spark.read.schema(schema).option("multiLine", "true").json(path)
    return df.withColumn("tags", F.from_json("tags", "array<string>"))


RDF_TABLES = ("dataset_summary", "pid", "rdf_term", "rdf_term_deduplicate", "snippet")


def read_rdf_tables(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The five relational tables (Parquet folders; a JDBC source works the same way)."""
    return {t: spark.read.parquet(f"{base}/{t}") for t in RDF_TABLES}


SOURCES: dict = {}


def register_source(name: str, reader) -> None:
    SOURCES[name] = reader


def _read_path(spark: SparkSession, path: str) -> DataFrame:
    """A file, folder or glob, by the ending of its name: delimited text with a header, JSON lines, else Parquet."""
    name = path.rstrip("/*").lower()
    for ending, sep in ((".tsv", "\t"), (".csv", ",")):
        if name.endswith(ending):
            return spark.read.options(header=True, sep=sep, escape='"').csv(path)
    return spark.read.json(path) if name.endswith((".json", ".jsonl")) else spark.read.parquet(path)


def read_source_by_name(spark: SparkSession, names: str | list[str], reader=None) -> DataFrame:
    """A name resolves to a registered source; any other name is a file, folder or glob, read by
    ``reader(spark, path)`` or by its ending (a path that matches nothing raises Spark's own error). Several names
    are concatenated by column name; none is an error."""
    names = [names] if isinstance(names, str) else list(names)
    if not names:
        raise ValueError("no source named")
    out = None
    for n in names:
        df = SOURCES[n](spark) if n in SOURCES else (reader or _read_path)(spark, n)
        out = df if out is None else out.unionByName(df)
    return out
