"""Binding of the shared test tables to the library's domain tables.

Each binding has a Spark form (a function of the session and table folder) and the same
definition as a DuckDB common table expression, used by the oracle SQL of ``catalog``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def run_events(spark: SparkSession, d: str) -> DataFrame:
    """A TREC-style run: query = user, document = event (string id), score = value."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("qid"), F.col("event_id").cast("string").alias("docid"),
        F.col("value").cast("double").alias("score"))


def qrels_events(spark: SparkSession, d: str) -> DataFrame:
    """Graded judgements: purchase = 2, click = 1, anything else = 0 (judged, not relevant)."""
    e = table(spark, d, "events")
    rel = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    return e.select(F.col("user_id").alias("qid"), F.col("event_id").cast("string").alias("docid"),
                    rel.cast("int").alias("rel"))


def ranking_events(spark: SparkSession, d: str) -> DataFrame:
    """A ranking ``(qid, pid, rank, score)``: rank by score desc, ties by pid."""
    from ..operators.ranking import rank_by_score
    e = table(spark, d, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("pid"),
                                         F.col("value").cast("double").alias("score"))
    return rank_by_score(e, "qid", "score", "pid")


def gold_events(spark: SparkSession, d: str) -> DataFrame:
    """Binary gold ``(qid, pid)``: purchases."""
    e = table(spark, d, "events")
    return e.filter(F.col("event_type") == "purchase").select(F.col("user_id").alias("qid"),
                                                              F.col("event_id").alias("pid"))


def queries_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("qid")).distinct()


def run_orders(spark: SparkSession, d: str) -> DataFrame:
    """The large run: customer = query, order = document, total price = score."""
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("qid"), F.col("o_orderkey").cast("string").alias("docid"),
        F.col("o_totalprice").cast("double").alias("score"))


def qrels_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    rel = F.when(F.col("o_orderpriority") == "1-URGENT", 2).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(0)
    return o.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").cast("string").alias("docid"),
                    rel.cast("int").alias("rel"))


# ---- DuckDB forms of the same bindings -----------------------------------------------------------

SQL_RUN_EVENTS = ("run AS (SELECT user_id AS qid, CAST(event_id AS VARCHAR) AS docid, "
                  "CAST(value AS DOUBLE) AS score FROM events)")
SQL_QRELS_EVENTS = ("qrels AS (SELECT user_id AS qid, CAST(event_id AS VARCHAR) AS docid, "
                    "CAST(CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS INTEGER) AS rel "
                    "FROM events)")
SQL_RANKING_EVENTS = ("ranking AS (SELECT user_id AS qid, event_id AS pid, CAST(value AS DOUBLE) AS score, "
                      "row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events)")
SQL_GOLD_EVENTS = "gold AS (SELECT user_id AS qid, event_id AS pid FROM events WHERE event_type = 'purchase')"
SQL_QUERIES_EVENTS = "queries AS (SELECT DISTINCT user_id AS qid FROM events)"
SQL_RUN_ORDERS = ("run AS (SELECT o_custkey AS qid, CAST(o_orderkey AS VARCHAR) AS docid, "
                  "CAST(o_totalprice AS DOUBLE) AS score FROM orders)")
SQL_QRELS_ORDERS = ("qrels AS (SELECT o_custkey AS qid, CAST(o_orderkey AS VARCHAR) AS docid, "
                    "CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 ELSE 0 END AS INTEGER) AS rel "
                    "FROM orders)")


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
