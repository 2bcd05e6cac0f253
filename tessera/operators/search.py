"""Sentence search: by nearest entities and paragraphs, and by words within dates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import matching, retrieval
from tessera.operators.sequence import top_per_group


def with_speakers(sentences: DataFrame, speakers: DataFrame, keep_unknown: bool = True) -> DataFrame:
    """``sentences`` with ``speaker_name``: full name, else normalised name, else the id; without ``keep_unknown`` those of unknown speakers go."""
    named = speakers.select(F.col("id").alias("speaker_id"), F.coalesce("full_name", "normalized_name").alias("_name"))
    joined = sentences.join(named, "speaker_id", "left" if keep_unknown else "inner")
    return joined.withColumn("speaker_name", F.coalesce("_name", F.col("speaker_id").cast("string"))).drop("_name")


def sentences_cited(ids: DataFrame, sentences: DataFrame, speakers: DataFrame) -> DataFrame:
    """The sentences of some ids (column id) with ``full_name`` and ``normalized_name``, which is the speaker's id where there is none; an empty title for none."""
    named = speakers.select(F.col("id").alias("speaker_id"), F.col("full_name").alias("_full"), F.col("normalized_name").alias("_norm"))
    found = sentences.join(ids.select("id").distinct(), "id", "left_semi").join(named, "speaker_id", "left")
    name = F.coalesce(F.nullif("_norm", F.lit("")), F.col("speaker_id").cast("string"))
    title = {"video_title": F.coalesce("video_title", F.lit(""))} if "video_title" in sentences.columns else {}
    return found.withColumns(title).select(*sentences.columns, F.col("_full").alias("full_name"), name.alias("normalized_name"))


def hybrid_sentences(entities: DataFrame, paragraphs: DataFrame, mentions: DataFrame, sentences: DataFrame, speakers: DataFrame, query: Sequence[float], k: int = 10, most: int = 20, skip: int = 0) -> DataFrame:
    """Sentences that mention the ``k`` entities nearest to a vector, or lie in the ``k`` nearest paragraphs, best ``score`` first.

    A sentence scores 1 minus its nearest entity's distance; one found by its
    paragraph alone 0.5.  Sentences of paragraphs need a known speaker, the others
    don't.  Entities and paragraphs have id and embedding, mentions sentence_id and
    entity_id, sentences id, paragraph_id and speaker_id.
    """
    near = retrieval.vector_topk(entities.select("id", "embedding"), "id", "embedding", query, k).select(F.col("id").alias("entity_id"), (1 - F.col("distance")).alias("score"))
    close = retrieval.vector_topk(paragraphs.select("id", "embedding"), "id", "embedding", query, k).select(F.col("id").alias("paragraph_id"))
    of_entities = mentions.join(F.broadcast(near), "entity_id").groupBy(F.col("sentence_id").alias("id")).agg(F.max("score").alias("score"))
    first = with_speakers(sentences.join(of_entities, "id"), speakers)
    second = with_speakers(sentences.join(F.broadcast(close), "paragraph_id", "left_semi"), speakers, keep_unknown=False).withColumn("score", F.lit(0.5))
    every = first.withColumn("_by", F.lit(0)).unionByName(second.withColumn("_by", F.lit(1)))
    # a sentence found both ways keeps the score of its entity
    sole = top_per_group(every, ["id"], [F.col("_by")]).drop("_by")
    return sole.orderBy(F.desc("score"), "id").offset(skip).limit(most)


def words_within(sentences: DataFrame, speakers: DataFrame, text: str, query: Sequence[str], day: str, start: date | str | None = None, end: date | str | None = None, speaker=None, most: int = 20) -> DataFrame:
    """Sentences with every word of a query within dates, of a speaker, best rank first: what temporal search gives without vectors."""
    rows = sentences.where(matching.date_between(F.col(day), start, end))
    if speaker is not None:
        rows = rows.where(F.col("speaker_id") == speaker)
    return retrieval.lexical_search(with_speakers(rows, speakers), "id", text, query, most)


def candidate_nodes(nodes: DataFrame, pinned: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """Nodes for a window's context: the pinned ones (column id) first, then the nearest to a vector up to ``k``, but all of the pinned; ``place`` tells the order."""
    first = nodes.join(pinned.select("id").distinct(), "id", "left_semi").withColumn("_p", F.lit(0)).withColumn("distance", F.lit(0.0))
    near = retrieval.vector_topk(nodes, "id", "embedding", query, k).withColumn("_p", F.lit(1))
    sole = top_per_group(first.unionByName(near), ["id"], [F.col("_p")])
    ranked = retrieval.in_rank_order(sole, "context", [F.col("_p"), F.col("distance")], "id", max(k, pinned.select("id").distinct().count()))
    return nodes.join(ranked.select("id", F.col("rank").alias("place")), "id")


def named_in(speakers: DataFrame, message: str, query: str, most: int = 25) -> DataFrame:
    """Speakers whose whole name is in a message but not yet in the query: names with any of its first five words of three or more letters, ``most`` of them by id, are looked at."""
    from tessera.functions import text as ft

    words = [w for w in " ".join(message.lower().split()).split(" ") if len(w) > 2][:5]
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower("full_name"), F.lit(w))
    name = ft.normalize_label(F.col("full_name"))
    few = speakers.where(hit).orderBy("id").limit(most)
    said, asked = (F.lit(" ".join(x.lower().split())) for x in (message, query))
    return few.where((name != "") & F.contains(said, name) & ~F.contains(asked, name))


def with_recency(query: str, message: str, year: int) -> str:
    """A query with the year added, if the message asks for recent things and the query names no year."""
    import re

    base = (query or "").strip()
    recent = any(t in (message or "").lower() for t in ("recent", "recently", "latest", "current", "new"))
    return f"{base} {year}" if base and recent and not re.search(r"\b(19|20)\d{2}\b", base) else base
