"""Incremental ingestion: new transcript files as a stream, put into a keyed table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as ft
from tessera.operators import sequence, upsert
from tessera.sources.readers import TRANSCRIPT
from tessera.streaming.versioned import VersionedTable


def sentence_rows(raw: DataFrame) -> DataFrame:
    """One row for each utterance of transcript records with a ``video_id``: ids by video and second with suffixes."""
    rows = raw.select("video_id", F.posexplode("transcripts").alias("position", "t")).select("video_id", "position", "t.text", "t.speaker_id", ft.to_seconds(F.col("t.start")).alias("seconds"))
    base = F.concat_ws(":", "video_id", F.col("seconds").cast("string"))
    return sequence.suffixed_ids(rows.where("seconds is not null"), ["video_id", "seconds"], ["position"], base)


#: Columns of the table of sentences.
SENTENCES = "id string, video_id string, position int, text string, speaker_id string, seconds long"


def sentence_table(spark: SparkSession, folder: str, buckets: int = 64) -> VersionedTable:
    """The table of sentences in a folder, with their search words; a new one if there is none."""
    words = lambda rows: upsert.with_search_words(rows, F.col("text"))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifests")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return VersionedTable(spark, folder, words)
    return VersionedTable.create(spark, folder, SENTENCES, ["id"], buckets, words)


def ingest_new(spark: SparkSession, folder: str, table: VersionedTable, state: str):
    """Read the files of ``folder`` not seen before and put their sentences into ``table`` (of ``sentence_table``); returns the finished query.

    Every batch is one change that touches the buckets of its sentences only, and
    counts once even if the stream repeats it after a failure.
    """
    stream = spark.readStream.schema(TRANSCRIPT).option("multiLine", True).json(folder)
    stream = stream.withColumn("video_id", F.regexp_extract(F.col("_metadata.file_name"), r"(?:transcription_output_)?(.+?)\.json$", 1))

    def put(batch: DataFrame, number: int) -> None:
        rows = sentence_rows(batch).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in SENTENCES.split(", ")])
        table.merge(rows, source=state, number=number)

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and event-time window, of a stream or a table with ts; later rows than ``late`` are ignored in a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
