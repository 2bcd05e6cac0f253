"""Sinks: CSV with a fixed field list, JSON lines, and the clean-up's artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as ft


def to_csv(rows: DataFrame, path: str, fields: list[str], single: bool = False) -> None:
    """Write the named fields, in order, with a header; arrays and structs as JSON, missing fields empty.

    ``single`` writes one file, for small results only.
    """
    nested = (T.ArrayType, T.StructType, T.MapType)
    shown = [F.lit(None).cast("string").alias(c) if c not in rows.columns else F.to_json(c).alias(c) if isinstance(rows.schema[c].dataType, nested) else F.col(c) for c in fields]
    out = rows.select(*shown)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def transcripts_to_json(sentences: DataFrame, path: str) -> None:
    """A JSON file for each video, in a folder of its id, as ``readers.transcripts`` reads them.

    Sentences have video_id, seconds, text and speaker_id, and may have voice_id,
    video_title and video_date; utterances are in order of time, then text.
    """
    have = lambda c, kind: F.col(c).cast(kind) if c in sentences.columns else F.lit(None).cast(kind)
    item = F.struct(ft.to_timestamp_text(F.col("seconds")).alias("start"), "text", have("voice_id", "int").alias("voice_id"), "speaker_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seconds", "text", item.alias("t")))), lambda x: x["t"])
    about = F.struct(F.max(have("video_title", "string")).alias("title"), F.max(F.date_format(have("video_date", "date"), "yyyyMMdd")).alias("upload_date"))
    packed = sentences.groupBy("video_id").agg(about.alias("video_metadata"), ordered.alias("transcripts"))
    packed.write.mode("overwrite").partitionBy("video_id").json(path)


def export_clean_up(result: dict[str, DataFrame], folder: str) -> None:
    """The tables that ``cleanup.clean_graph`` returns, each as CSV in a folder of its name."""
    for name, rows in result.items():
        to_csv(rows, f"{folder}/{name}", rows.columns)


def graph_json(nodes: DataFrame, edges: DataFrame, video: str | None = None, run: str | None = None, most: int = 1000) -> DataFrame:
    """One row with ``graph``: the JSON of a video's or a run's first ``most`` edges (both given is an error) and of the nodes at their ends."""
    if video is not None and run is not None:
        raise ValueError("a graph is exported by video or by run")
    few = edges.where(F.col("youtube_video_id") == video) if video is not None else edges.where(F.col("run_id") == run) if run is not None else edges
    few = few.orderBy(F.asc_nulls_last("earliest_seconds"), "id").limit(most)
    ends = few.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    shown = nodes.join(F.broadcast(ends), "id", "left_semi")
    # both lists are bounded by ``most``
    a = few.agg(F.array_sort(F.collect_list(F.struct("earliest_seconds", "id", "source_id", "predicate", "target_id"))).alias("edges"))
    b = shown.agg(F.array_sort(F.collect_list(F.struct("id", "type", "label"))).alias("nodes"))
    return b.join(a).select(F.to_json(F.struct("nodes", "edges")).alias("graph"))


def report(tables: dict[str, DataFrame], path: str) -> None:
    """Write small results as one Markdown text, a heading and a table for each."""
    from tessera.operators.quality_reports import markdown_table

    spark = next(iter(tables.values())).sparkSession
    body = "\n\n".join(f"## {name}\n\n{markdown_table(rows)}" for name, rows in tables.items())
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)
