"""Connected components of an undirected edge table, as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.workspace import Workspace


def connected_components(edges: DataFrame, a: str, b: str, workspace: Workspace | None = None) -> DataFrame:
    """``(node, component)`` for every node that an edge touches; the component is its smallest node.

    Alternates the small-star and large-star steps of Kiveris et al. (2014),
    the small one first, as it leaves fewer edges to the large one:
    every step groups by one node and replaces its edges by edges to the
    smallest neighbour, so the table never has more rows than the input and
    the number of rounds is logarithmic.  Loops, repeated and null-ended
    edges are allowed; null ends are ignored.  Each round is written to the
    shared folder, and superseded rounds are deleted.
    """
    workspace = workspace or Workspace(edges.sparkSession, "components")
    nodes = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    current = workspace.save(nodes.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    first, state = current, None
    while True:
        # edges point from the greater to the smaller end from the start, so the first round has no need of a large star
        following = workspace.save(_small_star(current if current is first else _large_star(current)))
        now = following.where("u <> v").agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if current is not first:
            workspace.drop(current)
        current = following
        if now == state:
            break
        state = now
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.union(roots.select("component", "component")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v >= u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m"))).distinct()


def add_links(labels: DataFrame, links: DataFrame, a: str, b: str, workspace: Workspace | None = None) -> DataFrame:
    """The rows of ``labels`` (node, component) that new links change or add; all others stay as they are.

    Links are taken between the components of their ends, and components are found
    among these alone, so the work grows with the links and the components that they
    join, not with the graph.  A node without a label is a component of its own, and
    a component is still named after its smallest node.
    """
    workspace = workspace or Workspace(links.sparkSession, "links")
    pairs = workspace.save(links.select(F.col(a).alias("_a"), F.col(b).alias("_b")).where("_a is not null and _b is not null").distinct())
    ends = pairs.select(F.col("_a").alias("node")).union(pairs.select("_b")).distinct()
    known = workspace.save(ends.join(labels.select("node", F.col("component").alias("_c")), "node", "left").select("node", F.coalesce("_c", "node").alias("now"), F.col("_c").isNull().alias("fresh")))
    of = lambda end, name: known.select(F.col("node").alias(end), F.col("now").alias(name))
    joined = pairs.join(of("_a", "x"), "_a").join(of("_b", "y"), "_b").where("x <> y")
    parts = workspace.save(connected_components(joined, "x", "y", workspace).withColumnRenamed("node", "now"))
    fresh = known.where("fresh").join(parts, "now", "left").select("node", F.coalesce("component", "now").alias("component"))
    moved = labels.withColumnRenamed("component", "now").join(parts.where("now <> component"), "now").select("node", "component")
    return moved.unionByName(fresh)
