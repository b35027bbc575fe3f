"""Registered queries: each operator on the given tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} registered twice")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r(col: str | Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, digits) + F.lit(0.0)


def gaps_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose negative balances count as missing."""
    c = table(spark, sf_dir, "customer")
    return c.withColumn("acct", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))


def orders_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer; some balances and segments count as missing."""
    o, c = table(spark, sf_dir, "orders"), gaps_customer(spark, sf_dir)
    joined = o.join(c, o["o_custkey"] == c["c_custkey"])
    return joined.withColumn(
        "segment", F.when(F.col("acct").isNotNull(), F.col("c_mktsegment"))
    ).withColumn("price", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))


ORDERS_CUSTOMER_SQL = """
oc AS (
  SELECT o.*, c.*,
         CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS acct,
         CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price
  FROM orders o JOIN customer c ON o_custkey = c_custkey
)"""

GAPS_SQL = """
gc AS (SELECT *, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS acct FROM customer)"""
