"""Views that give the test tables the roles of the change-risk data model.

Each view has a DataFrame form and an SQL form (a CTE body) for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.folds import time_folds, time_order
from riskloom.plans.registry import table


def change_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as commits: key, date, advisory id and two labels."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("commit"),
        F.col("o_orderdate").alias("date"),
        F.col("o_custkey").alias("id"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )


CHANGES_SQL = """changes AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS commit, o_orderdate AS date, o_custkey AS id,
         o_orderpriority AS priority, o_orderstatus AS status
  FROM orders)"""

ORDERED_SQL = (
    CHANGES_SQL
    + """,
ordered AS (
  SELECT commit, date, row_number() OVER (ORDER BY date, commit) - 1 AS position,
         count(*) OVER () AS n
  FROM (SELECT commit, min(date) AS date FROM changes GROUP BY commit))"""
)


def part_sql(k: int, source: str = "ordered", position: str = "position") -> str:
    """SQL for the part index of a position among n rows."""
    return (
        f"CAST(list_sum(list_transform(range(1, {k}), "
        f"lambda i: CASE WHEN {position} >= floor((i * (CAST(1 AS DOUBLE) / {k})) * n) "
        f"THEN 1 ELSE 0 END)) AS INTEGER)"
    )


PARTS_SQL = (
    ORDERED_SQL
    + f""",
parts AS (SELECT commit, date, position, {part_sql(12)} AS time_partition FROM ordered)"""
)


def commit_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Commits in time order with their time part."""
    return time_folds(time_order(change_stream(spark, sf)))
