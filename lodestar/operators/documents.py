"""Compact documents for datasets.

The reference runs one SQL round trip per dataset and per RDF term; here every step is a
set-based join over all datasets at once. Labels are looked up by equi-joins; the per-dataset
ordered concatenation is an aggregate over one snippet (bounded by the snippet's length).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CLS, SEP, metadata_document, strip_control, tokenize, truncate_tokens


def explode_snippet(snippets: DataFrame) -> DataFrame:
    """``(dataset_id, snippet "s p o,s p o")`` -> ``(dataset_id, pos, sub, pre, obj)`` term ids."""
    ex = snippets.filter(F.col("snippet") != "").select("dataset_id", F.posexplode(F.split("snippet", ",")).alias("pos", "t"))
    parts = F.split(F.trim(F.col("t")), " ")
    return ex.select("dataset_id", F.col("pos").cast("long"),
                     parts[0].cast("long").alias("sub"), parts[1].cast("long").alias("pre"),
                     parts[2].cast("long").alias("obj"))


def term_label_lookup(terms: DataFrame, pid: DataFrame, rdf_term: DataFrame, rdf_term_dedup: DataFrame) -> DataFrame:
    """Label of each ``(dataset_id, id)``. A dataset with exactly one file looks up
    ``rdf_term(file_id, id)``; a dataset with several files looks up
    ``rdf_term_deduplicate(dataset_id, id)``. Two joins on disjoint dataset sets, then a union."""
    files = pid.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_nf"), F.min("file_id").alias("file_id"))
    t = terms.join(files, "dataset_id")
    single = (t.filter(F.col("_nf") == 1)
              .join(rdf_term.select("file_id", "id", "label"), ["file_id", "id"], "left")
              .select("dataset_id", "id", "label"))
    multi = (t.filter(F.col("_nf") > 1)
             .join(rdf_term_dedup.select("dataset_id", "id", "label"), ["dataset_id", "id"], "left")
             .select("dataset_id", "id", "label"))
    return single.unionByName(multi)


def triple_text(sub_label, pre_label, obj_label, max_tokens: int = 45, tokenizer=None):
    """P3/P4 for one triple: labels (null = empty, P1-cleaned) joined by spaces, trimmed, cut to
    ``max_tokens`` tokens (lower-cased; tokenizer pluggable, default P12) and re-joined."""
    labels = [F.coalesce(strip_control(c), F.lit("")) for c in (sub_label, pre_label, obj_label)]
    text = F.trim(F.concat_ws(" ", *labels))
    toks = (tokenizer or (lambda c: tokenize(F.lower(c))))(text)
    return truncate_tokens(toks, max_tokens)


def content_document(triples: DataFrame, datasets: DataFrame, max_tokens: int = 45) -> DataFrame:
    """``triples(dataset_id, pos, sub_label, pre_label, obj_label)`` and
    ``datasets(dataset_id, title)`` -> ``(dataset_id, document)``:
    ``"[CLS] t1 [SEP] t2 [SEP]"``; a dataset with no triples gets ``""``; null titles are dropped."""
    tt = triples.select("dataset_id", "pos",
                        triple_text(F.col("sub_label"), F.col("pre_label"), F.col("obj_label"), max_tokens).alias("t"))
    docs = tt.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("_ts"))
    docs = docs.select("dataset_id", F.concat(F.lit(CLS), F.array_join(
        F.transform("_ts", lambda x: F.concat(F.lit(" "), x["t"], F.lit(" " + SEP))), "")).alias("document"))
    titled = datasets.filter(F.col("title").isNotNull()).select("dataset_id")
    return titled.join(docs, "dataset_id", "left").select("dataset_id", F.coalesce("document", F.lit("")).alias("document"))


def metadata_documents(summary: DataFrame) -> DataFrame:
    """P2 over ``dataset_summary(dataset_id, title, description, tags, author)``; rows with a null
    title are kept (the reference keeps them here)."""
    return summary.select("dataset_id", metadata_document("title", "description", "tags", "author").alias("document"))


def distant_supervision(summary: DataFrame) -> DataFrame:
    """The title becomes the query; the document is the metadata document built without the
    title; the dataset itself is the positive."""
    return summary.filter(F.col("title").isNotNull()).select(
        F.col("dataset_id").alias("positive_id"), strip_control("title").alias("query"),
        metadata_document("description", "tags", "author").alias("document"))
