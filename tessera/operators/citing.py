"""From the links of an answer to known sources, and from sources to what is shown of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as ft
from tessera.operators.sequence import top_per_group


def resolve_citations(cited: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, position, id): which known ids an answer cites, each once, in the order of their first citation.

    ``cited`` has key and ids (``text.cited_ids``), ``known`` key and id.  An id
    is known as it is, in lower case, and without or with the utterance prefix;
    bare seconds mean the only known id that ends in them.  Bills' ids must be
    known as they are.  What isn't known is left out.
    """
    wanted = cited.select(key, F.posexplode("ids").alias("position", "cited"))
    keyed = wanted.select(key, "position", "cited", F.posexplode(F.when(F.startswith("cited", F.lit("bill:")), F.array("cited")).otherwise(ft.citation_keys(F.col("cited")))).alias("_p", "_k"))
    names = known.select(key, "id", F.explode(F.when(F.startswith("id", F.lit("bill:")), F.array("id")).otherwise(ft.citation_keys(F.col("id")))).alias("_k"))
    # the last of several known ids of one form wins
    names = names.groupBy(key, "_k").agg(F.max("id").alias("id"))
    direct = keyed.join(names, [key, "_k"]).groupBy(key, "position").agg(F.min_by("id", "_p").alias("id"))
    ends = known.where(~F.startswith("id", F.lit("bill:"))).select(key, "id", F.regexp_extract("id", r":(\d+)$", 1).alias("s")).where("s <> ''").groupBy(key, "s").agg(F.min("id").alias("by_end"), F.count("*").alias("c")).where("c = 1").drop("c")
    bare = wanted.withColumn("s", F.regexp_extract("cited", r"(?i)^(?:utt_)?(\d+)$", 1)).join(ends, [key, "s"], "left")
    found = bare.join(direct, [key, "position"], "left").withColumn("id", F.coalesce("id", "by_end")).where("id is not null")
    first = found.groupBy(key, "id").agg(F.min("position").alias("_at"))
    return first.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("_at")) - 1).alias("position"), "id")


def append_unique(first: DataFrame, more: DataFrame, key: str, id_: str, order: str, most: int) -> DataFrame:
    """Each key's ids of ``first``, then those of ``more`` that it lacks, up to ``most`` in all, numbered again."""
    both = first.withColumn("_l", F.lit(0)).unionByName(more.withColumn("_l", F.lit(1)))
    sole = top_per_group(both, [key, id_], [F.col("_l"), F.col(order)])
    ranked = sole.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_l", order)))
    return ranked.where(F.col("_r") <= most).withColumn(order, F.col("_r") - 1).drop("_l", "_r")


def role_of_each(roles: DataFrame, by: list[str]) -> DataFrame:
    """(by, role_label): the role of the best source, then of the best kind, then the shortest label."""
    rank = lambda c, names: F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col(c)) - 1, F.lit(-1))
    last = lambda r, names: F.when(r < 0, len(names)).otherwise(r)
    sources, kinds = ["order_paper_pdf", "order_paper", "transcript"], ["executive", "procedural", "parliamentary", "constituency", "committee"]
    order = [last(rank("source", sources), sources), last(rank("role_kind", kinds), kinds), F.length("role_label"), F.col("role_label")]
    return top_per_group(roles, by, order).select(*by, "role_label")


def hydrate(citations: DataFrame, sentences: DataFrame, speakers: DataFrame, roles: DataFrame) -> DataFrame:
    """What is shown of cited sentences: text, time, link, speaker's name and role in that video, in order of time.

    ``speakers`` has id, name (``naming.shown_names``) and position, ``roles``
    youtube_video_id, speaker_id, source, role_kind and role_label.
    """
    best = role_of_each(roles, ["youtube_video_id", "speaker_id"])
    position = F.when(F.lower(F.trim("position")) != "unknown", F.nullif(F.trim("position"), F.lit("")))
    rows = citations.join(sentences, "id").join(speakers.select(F.col("id").alias("speaker_id"), "name", "position"), "speaker_id", "left").join(best, ["youtube_video_id", "speaker_id"], "left")
    url = ft.timed_url(F.concat(F.lit("https://www.youtube.com/watch?v="), "youtube_video_id"), F.greatest(F.coalesce("seconds", F.lit(0)), F.lit(0)))
    return rows.select(*citations.columns, "text", "seconds", "youtube_video_id", url.alias("url"), "speaker_id", F.coalesce("name", F.col("speaker_id").cast("string")).alias("speaker_name"), F.coalesce(F.nullif("role_label", F.lit("")), position).alias("speaker_title"))
