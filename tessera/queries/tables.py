"""The driver's tables, and a graph derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers linked to the parts they ordered: one edge a line item."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    text = lambda c: F.col(c).cast("string")
    return lines.select(
        F.concat_ws("-", F.lit("e"), text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey")).alias("id"),
        F.concat(F.lit("c"), text("o_custkey")).alias("source_id"),
        F.col("l_returnflag").alias("predicate"),
        F.concat(F.lit("p"), text("l_partkey")).alias("target_id"),
        F.col("l_linestatus").alias("youtube_video_id"),
        F.col("l_linenumber").cast("int").alias("earliest_seconds"),
        F.round(1 - F.col("l_discount"), 6).alias("confidence"),
        F.array(F.concat(F.lit("u"), text("l_suppkey"))).alias("utterance_ids"),
    )


EDGES = """edges AS (
  SELECT 'e-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, 'c' || o_custkey AS source_id,
    l_returnflag AS predicate, 'p' || l_partkey AS target_id, l_linestatus AS youtube_video_id, CAST(l_linenumber AS INTEGER) AS earliest_seconds,
    round(1 - l_discount, 6) AS confidence, ['u' || l_suppkey] AS utterance_ids
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step, a, b), some twice: every customer with the parts ordered, and every order with the customer's next: a large component, and many small ones that are long chains.  Steps are the lines' return flags, and C for chains."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    bought = lines.select(F.col("l_returnflag").alias("step"), F.col("o_custkey").cast("long").alias("a"), (F.col("l_partkey") + 1_000_000_000_000).alias("b"))
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    chains = orders.select(F.lit("C").alias("step"), (F.col("o_orderkey") + 2_000_000_000_000).alias("a"), (following + 2_000_000_000_000).alias("b")).where("b is not null")
    return bought.unionByName(chains)


#: Links in both directions, and for each node the smallest that it reaches.
REACH = """links AS (SELECT CAST(o_custkey AS BIGINT) AS a, l_partkey + 1000000000000 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION SELECT a, b FROM (SELECT o_orderkey + 2000000000000 AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) + 2000000000000 AS b FROM orders) WHERE b IS NOT NULL),
both_ways AS MATERIALIZED (SELECT a AS x, b AS y FROM links UNION SELECT b, a FROM links),
reach(node, component) USING KEY (node) AS (SELECT x, min(least(x, y)) FROM both_ways GROUP BY x
  UNION SELECT y, min(r.component) FROM reach r JOIN both_ways ON r.node = x JOIN recurring.reach o ON o.node = y WHERE r.component < o.component GROUP BY y),
parts AS (SELECT node, component FROM reach)"""
