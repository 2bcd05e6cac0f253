"""Ranked retrieval: exact vector search, lexical search, fusion, reranking, search with evidence."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import score
from tessera.functions import text as ft
from tessera.functions import vocabulary as v
from tessera.operators import graph, matching
from tessera.operators.sequence import running_number, top_per_group
from tessera.plans.workspace import Workspace


def vector_topk(rows: DataFrame, key: str, embedding: str, query: Sequence[float], k: int) -> DataFrame:
    """The ``k`` rows nearest to a vector by cosine distance, ties by key; rows of another length are left out."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    found = rows.withColumn("distance", score.cosine_distance(F.col(embedding), wanted)).where("distance is not null")
    return found.orderBy("distance", key).limit(k)


def lexical_search(rows: DataFrame, key: str, text: str, query: Sequence[str], k: int | None = None) -> DataFrame:
    """Rows whose text has every query term, best ``rank`` first; all of them without ``k``."""
    terms = F.array(*[F.lit(t) for t in dict.fromkeys(query)])
    # texts without the terms are left out before they are split into words
    words = rows
    for t in dict.fromkeys(query):
        words = words.where(F.contains(F.lower(F.col(text)), F.lit(t)))
    words = words.withColumn("_w", ft.tokens(F.col(text)))
    for t in dict.fromkeys(query):
        words = words.where(F.array_contains("_w", t))
    found = words.withColumn("rank", ft.lexical_rank(terms, F.col("_w"))).drop("_w")
    return found.orderBy(F.desc("rank"), key).limit(k) if k is not None else found


def in_rank_order(rows: DataFrame, channel: str, order: Sequence[Column], key: str, k: int) -> DataFrame:
    """(key, channel, rank) of the first ``k`` distinct keys of a channel."""
    best = top_per_group(rows.select(key, *[o.alias(f"_o{i}") for i, o in enumerate(order)]), [key], [F.col(f"_o{i}") for i in range(len(order))])
    few = best.orderBy(*[f"_o{i}" for i in range(len(order))], key).limit(k)
    rank = F.row_number().over(Window.orderBy(*[f"_o{i}" for i in range(len(order))], key))
    return few.select(key, F.lit(channel).alias("channel"), rank.alias("rank"))


def fuse(channels: Sequence[DataFrame], key: str, k: int = 60) -> DataFrame:
    """(key, channels, fused): reciprocal-rank fusion of ranked channels."""
    every = channels[0]
    for c in channels[1:]:
        every = every.unionByName(c)
    return every.groupBy(key).agg(F.array_sort(F.collect_set("channel")).alias("channels"), F.sum(score.reciprocal_rank(F.col("rank"), k)).alias("fused"))


def boosted(fused: DataFrame, label: str, aliases: str, intent: Column) -> DataFrame:
    """``fused`` with ``score``: the fused score with what label and aliases say to a query's ``text.query_intent``.

    +0.10 for each of up to three topic terms that are words of them, +0.05 if one
    occurs in them at all, +0.03 for a query after recent things, and -0.05 for a
    topical query with general terms too if none of the topic terms is a word.
    """
    said = F.lower(F.concat_ws(" ", label, F.array_join(F.coalesce(aliases, F.array().cast("array<string>")), " ")))
    shared = F.size(F.array_intersect(intent["topic_terms"], ft.words_of(said)))
    points = 0.10 * F.least(shared, F.lit(3)) + F.when(F.exists(intent["topic_terms"], lambda t: F.contains(said, t)), 0.05).otherwise(0.0) + F.when(intent["has_recency"], 0.03).otherwise(0.0)
    aside = (F.size(intent["generic_terms"]) > 0) & intent["is_topical"] & (shared == 0)
    return fused.withColumn("score", F.col("fused") + points - F.when(aside, 0.05).otherwise(0.0))


def prefer_mentioned(rows: DataFrame, label: str, aliases: str, query: str) -> DataFrame:
    """Rows whose label or an alias occurs in the query, or all rows if none does."""
    low = F.lit(query.lower())
    hit = F.contains(low, F.lower(F.col(label))) | F.exists(F.coalesce(F.col(aliases), F.array().cast("array<string>")), lambda a: F.contains(low, F.lower(a)))
    flagged = rows.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    return flagged.withColumn("_any", F.max("_hit").over(Window.partitionBy())).where(F.col("_hit") | ~F.col("_any")).drop("_hit", "_any")


def seed_nodes(nodes: DataFrame, aliases: DataFrame, query: str, vector: Sequence[float] | None, k: int) -> DataFrame:
    """The ``k`` best nodes for a query over four channels: vector and full text (2k each), its first two terms as a phrase, and exact aliases (10).

    Nodes have id, type, label, aliases and embedding; aliases alias_norm and node_id.
    """
    terms = list(dict.fromkeys(t.lower() for t in re.findall(r"\b[a-zA-Z][a-zA-Z0-9-]{2,}\b", query) if t.lower() not in v.QUERY_STOPWORDS))
    words = list(dict.fromkeys(w for t in terms for w in re.findall("[a-z0-9]+", t)))
    described = nodes.withColumn("_text", F.concat_ws(" ", "label", F.array_join("aliases", " ")))
    channels = []
    if vector is not None:
        near = vector_topk(nodes, "id", "embedding", vector, 2 * k)
        channels.append(in_rank_order(near, "vector", [F.col("distance")], "id", 2 * k))
    if terms:
        full = lexical_search(described, "id", "_text", words, 2 * k)
        channels.append(in_rank_order(full, "fulltext", [-F.col("rank")], "id", 2 * k))
        phrase = described.where(F.contains(ft.normalize_label(F.col("_text")), F.lit(" ".join(terms[:2]))))
        channels.append(in_rank_order(phrase, "phrase", [F.length("label")], "id", 2 * k))
    known = aliases.where(F.col("alias_norm").isin([*terms, " ".join(query.lower().split())])).select(F.col("node_id").alias("id"))
    channels.append(in_rank_order(known, "alias", [F.lit(0)], "id", 10))
    fused = fuse(channels, "id").join(nodes.select("id", "type", "label", "aliases"), "id")
    ranked = boosted(fused, "label", "aliases", ft.query_intent(F.lit(query)))
    return prefer_mentioned(ranked, "label", "aliases", query).orderBy(F.desc("score"), "id").limit(k)


def graph_search(nodes: DataFrame, aliases: DataFrame, edges: DataFrame, sentences: DataFrame, query: str, vector=None, seeds: int = 12, hops: int = 1, most_edges: int = 90, most_citations: int = 12, least_rank: float = 0.0) -> dict[str, DataFrame]:
    """Seeds, the edges around them, those edges' nodes, and the sentences they cite in order of video and time.

    Edges are taken by edge_rank_score, then confidence (null last), then time.
    ``least_rank`` of 0.05 or more, as of edges without any score, is ignored.
    Counts below 1 mean 1; a blank query finds nothing.
    """
    query, seeds, hops, most_edges, most_citations = query.strip(), max(1, seeds), max(1, hops), max(1, most_edges), max(1, most_citations)
    if not query:
        return {"seeds": nodes.where("false"), "edges": edges.where("false"), "nodes": nodes.where("false"), "citations": sentences.where("false")}
    found = seed_nodes(nodes, aliases, query, vector, seeds)
    order = [F.desc_nulls_last("edge_rank_score"), F.desc_nulls_last("confidence"), F.asc_nulls_last("earliest_seconds")]
    near = graph.expand(edges, found.select(F.col("id").alias("node")), hops, order, most_edges)
    if 0 < least_rank < 0.05:
        scored = F.max(F.col("edge_rank_score").isNotNull()).over(Window.partitionBy())
        near = near.withColumn("_s", scored).where(~F.col("_s") | (F.col("edge_rank_score") >= least_rank)).drop("_s")
    ends = near.select(F.explode(F.array("source_id", "target_id")).alias("id")).union(found.select("id")).distinct()
    cited = near.select(F.explode("utterance_ids").alias("id")).distinct().join(sentences, "id").orderBy("video_id", "seconds_since_start", "id").limit(most_citations)
    return {"seeds": found, "edges": near, "nodes": nodes.join(ends, "id", "left_semi"), "citations": cited}


def question_nodes(nodes: DataFrame, aliases: DataFrame, question: str, vector: Sequence[float], k: int = 25, most_aliases: int = 5) -> DataFrame:
    """The nodes nearest to a question by vector, then those that have it as an alias (at distance 0); each once, the vector's first."""
    near = vector_topk(nodes, "id", "embedding", vector, k).select("id", "type", "label", "aliases", "distance", F.lit("vector").alias("source"))
    known = aliases.where(F.col("alias_norm") == ft.normalize_label(F.lit(question))).select(F.col("node_id").alias("id")).distinct()
    named = nodes.join(known, "id", "left_semi").orderBy("id").limit(most_aliases)
    named = named.select("id", "type", "label", "aliases", F.lit(0.0).alias("distance"), F.lit("alias").alias("source"))
    return near.union(named.join(near.select("id"), "id", "left_anti").select(near.columns))


def edges_of_nodes(edges: DataFrame, ids: DataFrame, most: int = 50) -> DataFrame:
    """Edges with an end among ``ids`` (column id), the surest first, then the earliest."""
    found = matching.in_any(edges, ids, "id", ["source_id", "target_id"])
    return found.orderBy(F.desc_nulls_last("confidence"), F.asc_nulls_last("earliest_seconds"), "id").limit(most)


def capped_excerpts(hits: DataFrame, group: str, points: Column, key: str, per_group: int, most: int) -> DataFrame:
    """The best hits with at most ``per_group`` of one group, ``most`` in all."""
    scored = hits.withColumn("score", points)
    return top_per_group(scored, [group], [F.desc("score"), F.col(key)], per_group).orderBy(F.desc("score"), key).limit(most)


def temporal_search(sentences: DataFrame, embedding: str, query: Sequence[float], key: str, day: str, start: date | None = None, end: date | None = None, speaker: str | None = None, entities: DataFrame | None = None, k: int = 20) -> DataFrame:
    """Nearest sentences within dates, of a speaker, and mentioning any of some entities (column sentence_id of ``entities``)."""
    rows = sentences.where(matching.date_between(F.col(day), start, end))
    if speaker is not None:
        rows = rows.where(F.col("speaker_id") == speaker)
    if entities is not None:
        rows = rows.join(entities.select(F.col("sentence_id").alias(key)), key, "left_semi")
    return vector_topk(rows, key, embedding, query, k)


def daily_mentions(mentions: DataFrame, day: Column, what: str) -> DataFrame:
    return mentions.groupBy(day.alias("day")).agg(F.count_distinct(what).alias("mentions"))


def trend_summary(daily: DataFrame) -> DataFrame:
    """Total, mean over present days, first and last day, and the first day of most mentions."""
    peak = F.max(F.struct("mentions", (-F.unix_date("day")).alias("d"))).alias("_p")
    out = daily.agg(F.sum("mentions").alias("total"), (F.sum("mentions") / F.count("*")).alias("mean"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), peak)
    return out.select("total", "mean", "first_day", "last_day", F.col("_p.mentions").alias("peak"), F.date_from_unix_date(-F.col("_p.d")).alias("peak_day"))


def merge_hits(hits: DataFrame, key: str, points: str, order: str) -> DataFrame:
    """Each key once with its best points, in the order of its first place."""
    first = hits.withColumn("_first", F.min(order).over(Window.partitionBy(key)))
    return top_per_group(first, [key], [F.desc(points), F.col(order)]).withColumn(order, F.col("_first")).drop("_first")


def keyed_union(first: DataFrame, second: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both, each key once: the last row's values, in the first row's place (``order`` runs from 1 over both)."""
    both = first.withColumn("_l", F.lit(0)).unionByName(second.withColumn("_l", F.lit(1)))
    own = Window.partitionBy(key)
    marked = both.withColumn("_first", F.min(F.struct("_l", order)).over(own)).withColumn("_r", F.row_number().over(own.orderBy(F.desc("_l"), F.desc(order)))).where("_r = 1")
    return running_number(marked.select(*[c for c in first.columns if c != order], "_first"), ["_first", key], order).drop("_first").select(first.columns)


def grouped_sources(rows: DataFrame, group: str, position: str, order: Sequence[str], workspace: Workspace | None = None) -> DataFrame:
    """``rows`` with a running ``number``: groups by first appearance, rows in order within them."""
    first = rows.groupBy(F.col(group).alias("_k")).agg(F.min(position).alias("_g"))
    found = rows.join(first, F.col(group).eqNullSafe(F.col("_k")), "left").drop("_k")
    return running_number(found, ["_g", group, *order], "number", workspace).drop("_g")
