"""The graph clean-up as one plan: remap, merge, rewrite, collapse, rank, filter, verify."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import fuzzy
from tessera.functions import vocabulary as v
from tessera.operators import graph
from tessera.plans.workspace import Workspace


def clean_graph(nodes: DataFrame, edges: DataFrame, similarity=fuzzy.fuzz_ratio, pair_least: float = 0.7, cluster_least: float = 0.5, workspace: Workspace | None = None) -> dict[str, DataFrame]:
    """Cleaned nodes and edges, the merge map, dropped edges with reasons, violations left, and metrics.

    Nodes have id, type, label, aliases and embedding; edges what
    ``graph.collapse_edges`` takes.  Edges are collapsed before they are ranked, so
    support counts in their scores.
    """
    workspace = workspace or Workspace(nodes.sparkSession, "cleanup")
    nodes = nodes.withColumn("type", graph.remapped(F.col("type"), v.NODE_TYPES, v.NODE_TYPE_REMAPS)).where("type is not null")
    edges = edges.withColumn("predicate", F.coalesce(graph.remapped(F.col("predicate"), v.PREDICATES, v.PREDICATE_REMAPS), F.col("predicate")))
    ends = edges.select("source_id", "target_id").union(edges.select("target_id", "source_id")).toDF("id", "other")
    near = ends.groupBy("id").agg(F.array_sort(F.collect_set("other")).alias("neighbors"))
    degree = graph.node_degree(edges).withColumnRenamed("node", "id")
    known = workspace.save(nodes.join(near, "id", "left").join(degree, "id", "left").fillna(0, ["degree"]))
    facts = known.select("id", "label", "degree", F.size(F.coalesce("aliases", F.array().cast("array<string>"))).alias("alias_count"), F.startswith("id", F.lit("speaker_")).alias("is_speaker"))
    pairs = workspace.save(graph.candidate_pairs(known, similarity, pair_least))
    mapping = workspace.save(graph.merge_map(pairs, facts, cluster_least, workspace))
    merged_nodes = workspace.save(graph.collapse_nodes(known, mapping))
    judged = workspace.save(graph.with_drop_reason(graph.rewrite_endpoints(edges, mapping), merged_nodes))
    collapsed = workspace.save(graph.collapse_edges(judged.where("reason is null").drop("reason")))
    ranks = graph.pagerank(collapsed, merged_nodes, workspace=workspace)
    ranked = workspace.save(graph.rank_edges(collapsed, ranks))
    final = merged_nodes.join(ranks.withColumnRenamed("node", "id"), "id", "left").withColumnRenamed("score", "pagerank_score")
    metrics = [("nodes_before", nodes), ("nodes_after", merged_nodes), ("edges_before", edges), ("edges_after", ranked), ("edges_dropped", judged.where("reason is not null")), ("pairs", pairs)]
    counted = None
    for name, rows in metrics:
        one = rows.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
        counted = one if counted is None else counted.unionByName(one)
    return {"nodes": final, "edges": ranked, "merge_map": mapping, "dropped": judged.where("reason is not null"), "violations": graph.verification(merged_nodes, ranked), "metrics": counted}
