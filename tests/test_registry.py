"""Driver contract and a representative oracle comparison at sf0.001 (the full comparison of
every query is ``tools/check.py``)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from lodestar.session import TABLES

SF = "/root/testdata/sf0.001"

SAMPLE = ["A9_ndcg_cut", "A10_map_cut", "A11_mean_over_fixed_n", "A1_mrr_at", "A5_em_success_counts", "W4_assign_batches",
          "W8_running_offsets", "L7_row_range", "G5_distinct_tables", "P3_content_document", "P10_normalize_answer",
          "P12_tokenize", "J4_term_label_lookup", "V7_knn_flat", "V4_maxsim", "V17_compress", "V26_search_all",
          "J8_answer_in_passage", "J8_answer_in_corpus", "D5_mine_from_ranking", "D12_compose_batch", "S5_read_qrels_graded",
          "A13_rouge_1", "V30_index_add", "ST2_stream_metrics"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 1
    assert set(df.columns) == {"ndcg_cut_5", "ndcg_cut_10", "map_cut_5", "map_cut_10"}


def test_oracle_keys_subset():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 150


def _norm(v):
    import decimal
    if isinstance(v, decimal.Decimal):
        raise AssertionError("oracle returned DECIMAL; cast it to DOUBLE")
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    a = sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in df.collect())
    res = duck.execute(E.oracle_sql()[name])
    ocols = [c[0] for c in res.description]
    assert sorted(ocols) == cols
    b = sorted(repr(tuple(_norm(row[ocols.index(c)]) for c in cols)) for row in res.fetchall())
    assert a == b
