"""Readers of transcripts, bills, graph tables, overrides, captions, order papers and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as ft

TRANSCRIPT = """video_metadata struct<title:string,upload_date:string,duration:string>,
speakers array<struct<speaker_id:string,voice_id:int,name:string,position:string,role_in_video:string>>,
transcripts array<struct<start:string,text:string,voice_id:int,speaker_id:string>>,
legislation array<struct<id:string,name:string,description:string,source:string>>"""
BILL = "bill_id string, bill_number string, title string, description string, source_text string, source_url string, introduced_date string, keywords array<string>"
NODE = "id string, type string, label string, aliases string, merge_cluster_id string"
EDGE = "id string, source_id string, predicate string, target_id string, youtube_video_id string, earliest_seconds int, confidence double, evidence string, utterance_ids string"
FLAGS = "video_id string, speaker_id string, speaker_name string, voice_id string, sample_timestamps string"
OVERRIDE = "video_id string, start string, end string, new_speaker_id string, old_speaker_id string, voice_id int, note string"


def _video_id():
    """The video's id of its folder, ``video_id=...``, or else of the file's name."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), "/video_id=([^/]+)/[^/]*$", 1)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"(?:transcription_output_)?(.+?)\.json$", 1)
    # the folder's name is encoded, and its path once more
    decoded = lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    return F.when(folder != "", decoded(decoded(folder))).otherwise(name)


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each utterance of the transcript files below a path, with the id of their video."""
    raw = spark.read.schema(TRANSCRIPT).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    video = _video_id()
    rows = raw.select(video.alias("video_id"), "video_metadata", F.posexplode("transcripts").alias("position", "t"))
    day = ft.to_date_or_null(F.col("video_metadata.upload_date"))
    return rows.select("video_id", "position", "t.start", ft.to_seconds(F.col("t.start")).alias("seconds"), "t.text", "t.voice_id", "t.speaker_id", F.col("video_metadata.title").alias("video_title"), day.alias("video_date"))


def transcript_speakers(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(TRANSCRIPT).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return raw.select(_video_id().alias("video_id"), F.explode("speakers").alias("s")).select("video_id", "s.*")


def bills(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BILL).option("multiLine", True).json(path)


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header; arrays (JSON text in a cell) are for the caller to parse."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def flags(spark: SparkSession, path: str) -> DataFrame:
    """Flagged speakers with their sample times as an array; rows without ids or samples are left out."""
    rows = spark.read.option("header", True).schema(FLAGS).csv(path)
    samples = F.filter(F.transform(F.split("sample_timestamps", ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.withColumn("samples", samples).where("video_id <> '' and speaker_id <> '' and size(samples) > 0").drop("sample_timestamps")


def overrides(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) overrides; rejected ones have a ``reason``."""
    rows = spark.read.schema(OVERRIDE).option("multiLine", True).json(path)
    rows = rows.withColumns({"start_seconds": ft.to_seconds(F.col("start")), "end_seconds": ft.to_seconds(F.col("end"))})
    missing = F.col("video_id").isNull() | F.col("new_speaker_id").isNull() | F.col("start").isNull() | F.col("end").isNull()
    reason = F.when(missing, "missing field").when(F.col("start_seconds").isNull() | F.col("end_seconds").isNull(), "bad time").when(F.col("start_seconds") > F.col("end_seconds"), "start after end")
    judged = rows.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def verifications(spark: SparkSession, path: str) -> DataFrame:
    """One row for each result of checks of who is on the screen: (video_id, timestamp, speaker_id, name, match_requested, confidence); results without a body are left out."""
    body = "results array<struct<video_id:string,timestamp:string,speaker_id:string,result:struct<name:string,on_screen_text:string,match_requested:boolean,confidence:double>>>"
    rows = spark.read.schema(body).option("multiLine", True).json(path).select(F.explode("results").alias("r"))
    return rows.where("r.result is not null").select("r.video_id", "r.timestamp", "r.speaker_id", "r.result.name", "r.result.match_requested", "r.result.confidence")


def has_column(rows: DataFrame, name: str) -> bool:
    return name in rows.columns


def chamber_of(explicit, parsed, title):
    """house or senate: what is stated, else what was read from the paper, else what the title says, else the house."""
    known = lambda c: F.when(F.lower(F.trim(c)).isin("house", "senate"), F.lower(F.trim(c)))
    return F.coalesce(known(explicit), known(parsed), F.when(F.contains(F.lower(title), F.lit("senate")), "senate"), F.lit("house"))


def watch_list(spark: SparkSession, path: str) -> DataFrame:
    """(id, title) lines ``ID|TITLE``; blank lines and comments are left out."""
    rows = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")
    parts = F.split("value", r"\|", 2)
    return rows.select(F.trim(parts[0]).alias("id"), F.trim(F.get(parts, F.lit(1))).alias("title"))


def _clock(c):
    """Seconds of H:MM:SS.mmm or MM:SS.mmm."""
    p = F.split(F.regexp_replace(c, ",", "."), ":")
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc * 60 + F.coalesce(x.try_cast("double"), F.lit(0.0)))


def caption_cues(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, start, end, text) of the cues of WebVTT texts, tags removed, cues without text left out."""
    blocks = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), r"\n[ \t]*\n")
    rows = files.select(key, F.posexplode(blocks).alias("position", "block"))
    timing = r"((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})\s*-->\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})[^\n]*\n?"
    rows = rows.where(F.col("block").rlike(timing)).withColumn("start", _clock(F.regexp_extract("block", timing, 1))).withColumn("end", _clock(F.regexp_extract("block", timing, 2)))
    body = F.regexp_replace(F.regexp_replace(F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)$", 1), r"<[^>]*>", ""), r"\s+", " ")
    return rows.select(key, "position", "start", "end", F.trim(body).alias("text")).where("text <> ''")


def caption_text(cues: DataFrame, key: str, most_seconds: float) -> DataFrame:
    """The joined text of the cues that start by a time."""
    parts = F.array_sort(F.collect_list(F.struct("position", "text")))
    return cues.where(F.col("start") <= most_seconds).groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def order_paper_items(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sequence, heading, item) of order papers: headings are lines of capitals or with #, items begin with a number or a dash."""
    lines = files.select(key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line", "value")).withColumn("value", F.trim("value")).where("value <> ''")
    heading = F.col("value").rlike(r"^#+\s") | F.col("value").rlike(r"^[A-Z][A-Z &'’,.()-]{3,}$")
    marked = lines.withColumn("heading", F.when(heading, F.regexp_replace("value", r"^#+\s*", "")))
    order = Window.partitionBy(key).orderBy("line")
    marked = marked.withColumn("heading", F.last("heading", ignorenulls=True).over(order))
    items = marked.where(F.col("value").rlike(r"^(?:\d+[.)]|[-*•])\s+"))
    return items.select(key, F.row_number().over(order).alias("sequence"), "heading", F.regexp_replace("value", r"^(?:\d+[.)]|[-*•])\s+", "").alias("item"))


def order_paper_facts(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sitting_date, session, number, chamber) found in order papers."""
    session = F.nullif(F.regexp_extract(F.col(text), r"(?i)((?:first|second|third|fourth|fifth) session[^\n]*)", 1), F.lit(""))
    chamber = F.when(F.lower(F.col(text)).contains("senate"), "senate").otherwise("house")
    number = F.regexp_extract(F.col(text), r"(?i)\bno\.?\s*(\d+)", 1).try_cast("int")
    return files.select(key, ft.prose_date(F.col(text)).alias("sitting_date"), session.alias("session"), number.alias("number"), chamber.alias("chamber"))


def labelled_papers(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, session, sitting_number, sitting_date, number, error) of order papers with bold labels.

    A paper needs a date and a number: ``error`` says which is missing or can't be
    read, and is null for a good one.
    """
    value = lambda label, form=r"\s*([^\n]+)": F.trim(F.regexp_extract(_lines(text), rf"\*\*{label}:\*\*{form}", 1))
    said = value("Date")
    form = r"\b(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]+)\s*,\s*(\d{4})\b"
    day, month, year = (F.regexp_extract(said, form, i) for i in (1, 2, 3))
    number = F.array_position(F.array(*map(F.lit, ft.MONTHS)), F.lower(month))
    date = F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    paper = value("Order Paper Number", r"\s*No\.\s*(\d+)")
    error = F.when(said == "", "no date").when(day == "", "unreadable date").when(number == 0, "unknown month").when(paper == "", "no number")
    return files.select(key, value("Session").alias("session"), value("Sitting Number").alias("sitting_number"), F.when((day != "") & (number > 0), date).alias("sitting_date"), paper.alias("number"), error.alias("error"))


def labelled_bills(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sequence, item_type, title, mover, action, status) of the bills in order papers with bold labels: bold list items of the third section, with the fields below them."""
    section = F.regexp_extract(_lines(text), r"(?s)\*\*3\.\s*Bills on the Order Paper:\*\*(.*?)(?:\n\*\*4\.|\z)", 1)
    heading = r"(?m)^\*\s+\*\*(.+?)\*\*\s*$"
    titles = F.regexp_extract_all(section, F.lit(heading), F.lit(1))
    # what stands before the first heading belongs to no bill
    blocks = F.slice(F.split(section, heading, -1), F.lit(2), F.size(titles))
    rows = files.select(key, F.posexplode(F.arrays_zip(titles.alias("title"), blocks.alias("block"))).alias("place", "b"))
    field = lambda name: F.nullif(F.trim(F.regexp_extract("b.block", rf"(?<![\p{{L}}\p{{N}}_]){name}:\s*([^\n]+)", 1)), F.lit(""))
    return rows.select(key, (F.col("place") + 1).alias("sequence"), F.lit("BILL").alias("item_type"), F.trim("b.title").alias("title"), *[field(n).alias(n.lower()) for n in ("Mover", "Action", "Status")])


def _lines(text: str):
    """A text with plain line ends, and lines without blanks at their ends."""
    return F.regexp_replace(F.regexp_replace(F.col(text), r"\r\n?", "\n"), r"[ \t\f]+(?=\n|\z)", "")


def overrides_to_speakers(entries: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overrides (with new_speaker_name) with ``new_speaker_id``, and those whose name nobody has.

    ``names`` (id, full_name, normalized_name): the trimmed full name counts before the normalised one; of equal names the smallest id.
    """
    asked = entries.withColumn("_name", F.trim(F.coalesce("new_speaker_name", F.lit("")))).withColumn("_norm", ft.fold(F.col("_name")))
    by = lambda c, k, i: names.where(F.col(c).isNotNull() & (F.col(c) != "")).groupBy(F.col(c).alias(k)).agg(F.min("id").alias(i))
    found = asked.join(by("full_name", "_name", "_i"), "_name", "left").join(by("normalized_name", "_norm", "_j"), "_norm", "left").withColumn("new_speaker_id", F.coalesce("_i", "_j"))
    columns = entries.columns
    return found.where("new_speaker_id is not null").select(*[c for c in columns if c != "new_speaker_id"], "new_speaker_id"), found.where("new_speaker_id is null").select(*[c for c in columns if c != "new_speaker_id"])


def table_links(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, row, cells, title, url) of table rows that have a link."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(markup), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "r"))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))
    cells = F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)), plain)
    url = F.regexp_extract("r", r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']+)["']""", 1)
    title = plain(F.regexp_extract("r", r"(?is)<a\b[^>]*>(.*?)</a>", 1))
    return rows.select(key, "row", cells.alias("cells"), title.alias("title"), url.alias("url")).where("url <> ''")


def first_fields(pages: DataFrame, key: str, markup: str, fields: dict[str, list[str]]) -> DataFrame:
    """For each field the first group of the first of its patterns that matches a page, with tags removed."""
    found = lambda p: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(F.col(markup), p, 1), r"<[^>]*>", "")), F.lit(""))
    return pages.select(key, *[F.coalesce(*map(found, patterns)).alias(name) for name, patterns in fields.items()])


def first_page_of_each(pages: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Extracted pages with the first of equal page numbers kept."""
    return pages.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
