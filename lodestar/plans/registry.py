"""Registry of named queries: each binds library operators to the test tables.

``QUERIES[name] = fn(spark, sf_dir) -> DataFrame`` and, where the operator is expressible in SQL,
``ORACLE[name]`` is the same computation in DuckDB SQL over the raw tables. Names are the
operator id from the survey plus the operator name (``A9_ndcg_cut``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module (each registers itself)."""
    from . import q_index, q_io, q_maint, q_metrics, q_qa, q_ranking, q_reader, q_tables, q_text, q_vectors, q_weak  # noqa: F401
