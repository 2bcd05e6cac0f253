"""Scores of retrieval, matching and graph ranking, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where lengths differ, a side is null or has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), 1 - dot(a, b) / norms)


def parse_vector(text: Column) -> Column:
    """array<double> of "[1,2]"; null if it isn't one."""
    parsed = F.from_json(text, "array<double>")
    return F.when(F.size(parsed) > 0, F.when(~F.exists(parsed, lambda x: x.isNull()), parsed))


def format_vector(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    return 1 / (k + rank)


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b| of arrays; 0 if both are empty or null."""
    a, b = F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def merge_score(label: Column, vector: Column, neighbours: Column, aliases: Column) -> Column:
    return 0.45 * label + 0.30 * vector + 0.15 * neighbours + 0.10 * aliases


def edge_weight(confidence: Column, support: Column, prior: Column) -> Column:
    """Half the weight from support, on a logarithmic scale up to 1, then confidence and the predicate's prior."""
    return 0.50 * F.least(F.log1p(support) / 10, F.lit(1.0)) + 0.35 * F.coalesce(confidence, F.lit(0.5)) + 0.15 * prior


def edge_rank(weight: Column, rank_a: Column, rank_b: Column, support: Column) -> Column:
    return weight * (rank_a + rank_b) / 2 * F.log1p(support)


def max_normalized(c: Column, *by: str) -> Column:
    """c over its largest value; 0 where that is 0."""
    most = F.max(c).over(Window.partitionBy(*by))
    return F.when(most > 0, c / most).otherwise(0.0)


def rerank_blend(relevance: Column, topic_match: Column, specificity: Column, recency_fit: Column) -> Column:
    """A judge's four marks from 0 to 1 as one; a missing mark counts as a half."""
    half = F.lit(0.5)
    return 0.55 * F.coalesce(relevance, half) + 0.20 * F.coalesce(topic_match, half) + 0.15 * F.coalesce(specificity, half) + 0.10 * F.coalesce(recency_fit, half)


def bill_score(distance: Column, rank: Column, known: Column) -> Column:
    """Hybrid score of an excerpt: 3/4 vector, 1/4 lexical, and a boost if its bill is among the seeds."""
    return 0.75 * (1 - F.coalesce(distance, F.lit(1.0))) + 0.25 * F.least(F.coalesce(rank, F.lit(0.0)), F.lit(1.0)) + F.when(known, 0.08).otherwise(0.0)


def date_score(days: Column) -> Column:
    """Points for the distance between an upload and a sitting; none if it is unknown."""
    apart = F.abs(days)
    return F.when(apart == 0, 55).when(apart == 1, 35).when(apart <= 3, 20).when(apart <= 7, 8).otherwise(0)


def title_score(days: Column, same_chamber: Column) -> Column:
    """Points for the distance between the date in a title and a sitting, and for a chamber that both name."""
    apart = F.abs(days)
    return F.when(apart == 0, 35).when(apart == 1, 20).when(apart <= 3, 8).otherwise(0) + F.when(same_chamber, 10).otherwise(0)


def match_confidence(points: Column) -> Column:
    return F.when(points >= 75, "high").when(points >= 60, "medium").otherwise("low")


def match_status(confidence: Column) -> Column:
    return F.when(confidence == "high", "auto_matched").otherwise("needs_review")
