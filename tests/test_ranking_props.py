"""Global numbering without a single-task window: zip_index and running_offsets equal their
definitions on data spread over many partitions, also where a sort is cut into unlike partitions."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators.ranking import _running_slices, rank_by_score, running_in_keys, running_offsets, zip_index


def test_zip_index_and_running_offsets(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("k"),
                                                      (F.col("id") % 13).alias("len"))
    z = zip_index(df, ["k"], "i").collect()
    assert sorted((r.k, r.i) for r in z) == [(k, k) for k in range(5000)]
    off = {r.k: r.offset for r in running_offsets(df, "len", ["k"]).collect()}
    lens = {r.k: r.len for r in df.collect()}
    acc = 0
    for k in range(5000):
        assert off[k] == acc
        acc += lens[k]


@pytest.mark.parametrize("settings", [{}, {"spark.sql.adaptive.coalescePartitions.enabled": "false"},
                                      {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k"}])
def test_numbering_of_many_wide_rows(spark, settings):
    n = 1_000_000
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), (F.col("id") % 13).alias("len"), F.lpad(F.md5(F.col("id").cast("string")), 128, "x").alias("wide"))
        got = zip_index(rows, ["k"], "i").agg(F.count("*"), F.countDistinct("i"), F.min("i"), F.max("i"), F.sum((F.col("i") != F.col("k")).cast("int")), F.max(F.length("wide"))).first()
        assert tuple(got) == (n, n, 0, n - 1, 0, 128)
        if settings:
            off = running_offsets(rows, "len", ["k"]).select("k", "len", "offset").toPandas().sort_values("k")
            assert (off.offset.to_numpy() == off.len.cumsum().to_numpy() - off.len.to_numpy()).all() and len(off) == n
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("spread_out", [False, True])
def test_hot_keys_in_slices(spark, spread_out):
    """A key (and the null key) above the limit, small keys beside them: places and sums as one window per key gives them."""
    n = 300_000
    rows = spark.range(n, numPartitions=9).select(
        F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).when(F.col("id") % 3 == 1, F.lit("hot"))
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string"))).alias("qid"),
        F.col("id").alias("docid"), (F.col("id") * 7919 % 1000).alias("score"), (F.col("id") % 17).alias("len"))
    if spread_out:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running_in_keys(rank_by_score(rows, hot_rows=20_000), ["qid"], [F.col("score").desc(), "docid"], "len", "off", hot_rows=20_000).toPandas()
        parts = _running_slices(rows, ["qid"], ["docid"], F.lit(1), "long", "i").groupBy("qid").agg(F.countDistinct("i").alias("d"), F.max("i").alias("m")).where("d <> m + 1").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts == 0 and len(got) == n
    got = got.fillna({"qid": ""}).sort_values(["qid", "score", "docid"], ascending=[True, False, True])
    g = got.groupby("qid")
    assert (got["rank"] == g.cumcount() + 1).all()
    assert (got["off"] == g["len"].cumsum() - got["len"]).all()


def test_hot_keys_edges(spark):
    none = spark.createDataFrame([], "qid long, docid long, score double")
    assert rank_by_score(none, hot_rows=1).collect() == [] and running_in_keys(none, ["qid"], ["docid"]).collect() == []
    one = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (2, 3, None)], "qid long, docid long, score double")
    assert sorted((r.qid, r.docid, r["rank"]) for r in rank_by_score(one, hot_rows=1).collect()) == [(1, 1, 1), (1, 2, 2), (2, 3, 1)]
    two = running_in_keys(one, ["qid", "score"], ["docid"], "score", "off", hot_rows=0)
    assert sorted((r.docid, r.off) for r in two.collect()) == [(1, 0.0), (2, 0.5), (3, 0.0)]
