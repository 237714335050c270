"""Loops of joins: what the optimiser holds for a round's tables must not grow with the rounds, nor the rounds with a region's sets."""

import random
from collections import Counter

from lodestar.llm import jaccard_join

from .test_group_operators import classes


def _size(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()


def test_size_estimate_stays_small_over_rounds(spark):
    """A path of 300 nodes takes many rounds; as a product for each join the estimate had thousands of digits."""
    path = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    labels = jaccard_join.components(path)
    assert _size(labels) < 1 << 30
    assert {(r.node, r.label) for r in labels.collect()} == {(i, 0) for i in range(301)} | {(1000, 1000), (1001, 1000)}


def test_large_region_without_links_takes_few_rounds(spark, monkeypatch):
    """Documents of one template, at distance 0.3 of each other: a region without one link, all of whose sets must be pivots."""
    r = random.Random(4)
    words = lambda n: ["".join(r.choices("abcdefghij", k=6)) for _ in range(n)]
    base = words(76)
    rows = [(i, " ".join(base + words(16))) for i in range(100)] + [(200 + i, " ".join(base + words(3) * 2)) for i in range(3)]
    rows += [(i + 300, t) for i, t in rows[:2]]
    rounds, sizes, found = [], [], jaccard_join.components

    def counted(edges):
        rounds.append(1)
        out = found(edges)
        sizes.append(_size(out))
        return out

    monkeypatch.setattr(jaccard_join, "components", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.link_documents(docs, region_sets=60, pivots=4).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == classes(rows)
    assert max(sizes) < 1 << 30
    assert len(rounds) - 1 <= 6                                    # 26 of four pivots each
