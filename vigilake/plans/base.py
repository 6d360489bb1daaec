"""The registry that plan modules add their queries to, and the shapes they share.

The input tables stand for the engine's own: nation = organization, customer =
machine, orders = software component, lineitem = exposure, part = vulnerability,
supplier = source, events = run and alert log, pages = URL observations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def tasks(rows: DataFrame, each: int = 500_000) -> int:
    """Tasks for `rows` at so many rows each, and no fewer than run at once."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))


def spread(df: DataFrame, n: int, *by: str) -> DataFrame:
    """`df` over `n` tasks by the columns `by`, evenly without any. AQE does not put such
    tasks together again, so that what one holds does not grow with the table."""
    return df.repartition(n, *by)


def priority_of(quantity: Column) -> Column:
    return F.when(quantity >= 45, "CRITICAL").when(quantity >= 30, "HIGH").when(quantity >= 15, "MEDIUM").when(quantity >= 5, "LOW")


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as exposures."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("component_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("vulnerability_id"),
            F.col("l_suppkey").alias("source_id"),
        priority_of(F.col("l_quantity")).alias("priority"), (F.col("l_linestatus") == "F").alias("is_kev"),
        F.when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "N", "potential").otherwise("not_applicable").alias("applicability"),
        F.col("l_shipdate").alias("detected_at"),
    )


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as software components."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("component_id"), F.col("o_custkey").alias("machine_id"), F.col("o_orderstatus").alias("component_type"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("ecosystem"), F.col("o_orderdate").alias("seen_at"),
            F.col("o_totalprice").alias("price"),
    )


def machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as machines."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("machine_id"), F.col("c_name").alias("hostname"),
        F.col("c_nationkey").alias("organization_id"), F.col("c_mktsegment").alias("os_name"))


#: The same shapes in SQL.
EXPOSURES = """exposures AS (
  SELECT l_orderkey AS component_id, l_linenumber AS line, l_partkey AS vulnerability_id, l_suppkey AS source_id,
         CASE WHEN l_quantity >= 45 THEN 'CRITICAL' WHEN l_quantity >= 30 THEN 'HIGH' WHEN l_quantity >= 15 THEN 'MEDIUM' WHEN l_quantity >= 5 THEN
           'LOW' END AS priority,
         l_linestatus = 'F' AS is_kev,
         CASE l_returnflag WHEN 'A' THEN 'confirmed' WHEN 'N' THEN 'potential' ELSE 'not_applicable' END AS applicability, l_shipdate AS detected_at
  FROM lineitem)"""
COMPONENTS = """components AS (
  SELECT o_orderkey AS component_id, o_custkey AS machine_id, o_orderstatus AS component_type,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS ecosystem, o_orderdate AS seen_at, o_totalprice AS price FROM
           orders)"""
MACHINES = """machines AS (
  SELECT c_custkey AS machine_id, c_name AS hostname, c_nationkey AS organization_id, c_mktsegment AS os_name FROM customer)"""
RANK = "CASE priority WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE -1 END"
