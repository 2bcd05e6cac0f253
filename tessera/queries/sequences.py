"""Sequences: paragraphs, windows, ids, blocks, timestamps, over conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as ft
from tessera.operators import retrieval, sequence
from tessera.queries.tables import table


def _talk(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def paragraphs_islands(spark, sf_dir):
    found = sequence.paragraphs(_talk(spark, sf_dir), ["conv_id"], ["turn"], "role", "text", "turn")
    return found.select("conv_id", F.col("paragraph").cast("long").alias("paragraph"), "role", "start_seconds", "end_seconds", "sentences", "text")


ISLANDS = """islands AS (
  SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS paragraph FROM (
    SELECT *, CASE WHEN lag(turn) OVER w IS NULL OR lag(role) OVER w IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS new
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)))"""


def sentence_ids(spark, sf_dir):
    rows = _talk(spark, sf_dir).withColumn("second", F.floor(F.col("turn") / 2))
    base = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("second").cast("string"))
    return sequence.suffixed_ids(rows, ["conv_id", "second"], ["turn"], base).select("conv_id", "turn", "id")


def sliding_windows(spark, sf_dir):
    found = sequence.sliding_windows(_talk(spark, sf_dir), ["conv_id"], ["turn"], 4, 2)
    return found.groupBy("conv_id", "window_index").agg(F.count("*").alias("members"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn")).withColumn("window_index", F.col("window_index").cast("long"))


def short_tail_windows(spark, sf_dir):
    found = sequence.sliding_windows(_talk(spark, sf_dir), ["conv_id"], ["turn"], 6, 3, short_ok=True)
    return found.groupBy("conv_id", "window_index").agg(F.count("*").alias("members"), F.min("turn").alias("first_turn")).withColumn("window_index", F.col("window_index").cast("long"))


def window_speakers(spark, sf_dir):
    rows = _talk(spark, sf_dir).withColumn("uid", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    found = sequence.window_properties(sequence.sliding_windows(rows, ["conv_id"], ["turn"], 4, 2), ["conv_id"], "text", "role", "turn", "uid")
    return found.select("conv_id", F.col("window_index").cast("long").alias("window_index"), F.array_join("speakers", ",").alias("speakers"), F.array_join("ids", ",").alias("ids"), F.length("text").cast("long").alias("chars"), F.col("earliest_seconds").alias("earliest"))


WINDOWS = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
members AS (
  SELECT * FROM (SELECT *, unnest(range(0, n + 1)) AS window_index FROM numbered)
  WHERE window_index * 2 + 4 <= n AND position >= window_index * 2 AND position < window_index * 2 + 4)"""


def speaker_blocks(spark, sf_dir):
    marked = sequence.islands(_talk(spark, sf_dir), ["conv_id"], ["turn"], "role", "block")
    blocks = marked.groupBy("conv_id", "role", "block").agg(F.min("turn").alias("start"), F.max("turn").alias("end"))
    found = sequence.block_summary(blocks, ["conv_id", "role"], "start", "end", "block")
    return found.select("conv_id", "role", "blocks", "total_seconds", "longest_seconds", F.array_join(F.transform("samples", lambda x: x.cast("long").cast("string")), ",").alias("samples"))


def last_n_context(spark, sf_dir):
    return sequence.last_n(_talk(spark, sf_dir), ["conv_id"], "turn", 5).select("conv_id", "turn", "role")


def moving_average(spark, sf_dir):
    daily = retrieval.daily_mentions(table(spark, sf_dir, "events"), F.to_date("ts"), "user_id")
    return sequence.moving_average(daily, [], "day", "mentions").select(F.col("day").cast("string").alias("day"), "mentions", F.round("moving_avg", 6).alias("moving_avg"))


def timestamps(spark, sf_dir):
    of_day = F.expr("hour(ts) * 3600 + minute(ts) * 60 + second(ts)")
    rows = table(spark, sf_dir, "events").select("event_id", of_day.cast("long").alias("seconds")).withColumn("stamp", ft.to_timestamp_text(F.col("seconds")))
    return rows.withColumn("parsed", ft.to_seconds(F.col("stamp")).cast("long"))


def repaired_timestamps(spark, sf_dir):
    """Every fifty events are a sequence of stamps, each damaged in one of seven ways; the sequences of even number have a duration."""
    s, kind = F.col("pos") % 50 * 41, F.col("pos") % 7
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    minute, second = two(s / 60), two(s % 60)
    raw = F.when(kind == 0, F.concat(minute, F.lit(":"), second, F.lit(":000"))).when(kind == 1, F.concat(minute, F.lit(":"), second, F.lit(":00"))).when(kind == 2, F.concat(minute, F.lit(":"), second)).when(kind == 3, "0:03:19")
    raw = raw.when(kind == 4, F.concat(F.lit("0:"), two(60 + s / 60), F.lit(":"), second)).when(kind == 5, "unread").otherwise(F.concat(F.lit("00:"), minute, F.lit(":"), second))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos")).withColumn("video", F.floor(F.col("pos") / 50)).withColumn("raw", raw)
    rows = rows.withColumn("duration", F.when(F.col("video") % 2 == 0, F.lit(9000).cast("long")))
    found = sequence.repair_timestamps(rows, ["video"], "pos", "raw", "duration")
    return found.select("video", "pos", F.coalesce("seconds", F.lit(-1)).alias("seconds"), "reason")


def segment_timeline(spark, sf_dir):
    """Segments of ten minutes that overlap by one, for videos as long as events' values in seconds."""
    rows = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("value") * 30).alias("d"))
    return sequence.timeline(rows, "event_id", F.col("d"), 600, 60)


def shifted_segments(spark, sf_dir):
    """Conversations as segments that begin at a minute each, some with times of their own; then what the band before keeps."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") % 4 * 60).alias("start"), (F.col("turn") * 5 + F.when(F.col("conv_id") % 2 == 0, F.col("conv_id") % 4 * 60).otherwise(0)).alias("seconds"))
    moved = sequence.shift_segments(rows, ["conv_id"], "seconds", "start")
    band = F.when(F.col("start") > 0, F.col("start"))
    return sequence.outside_band(moved, "seconds", band, band + 8).select("conv_id", "turn", "seconds")


QUERIES = {
    "paragraphs_islands": paragraphs_islands,
    "sentence_ids_suffix": sentence_ids,
    "sliding_windows": sliding_windows,
    "short_tail_windows": short_tail_windows,
    "window_speakers_first_seen": window_speakers,
    "speaker_blocks_summary": speaker_blocks,
    "last_n_context": last_n_context,
    "moving_avg7": moving_average,
    "ts_format_parse": timestamps,
    "timestamp_repair": repaired_timestamps,
    "segment_timeline": segment_timeline,
    "segment_shift_dedupe": shifted_segments,
}

SQL = {
    "paragraphs_islands": f"""WITH {ISLANDS}
SELECT conv_id, CAST(paragraph AS BIGINT) AS paragraph, role, min(turn) AS start_seconds, max(turn) AS end_seconds, count(*) AS sentences, string_agg(text, ' ' ORDER BY turn) AS text
FROM islands WHERE role IS NOT NULL GROUP BY conv_id, paragraph, role""",
    "sentence_ids_suffix": """SELECT conv_id, turn, conv_id || ':' || turn // 2 || CASE WHEN r = 1 THEN '' ELSE '_' || r END AS id
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY turn) AS r FROM conversations)""",
    "sliding_windows": f"WITH {WINDOWS} SELECT conv_id, window_index, count(*) AS members, min(turn) AS first_turn, max(turn) AS last_turn FROM members GROUP BY ALL",
    "short_tail_windows": """WITH numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, window_index, count(*) AS members, min(turn) AS first_turn FROM (SELECT *, unnest(range(0, n + 1)) AS window_index FROM numbered)
WHERE (window_index * 3 + 6 <= n AND position >= window_index * 3 AND position < window_index * 3 + 6) OR (n < 6 AND window_index = 0) GROUP BY ALL""",
    "window_speakers_first_seen": f"""WITH {WINDOWS},
seen AS (SELECT conv_id, window_index, role, min(turn) AS t FROM members WHERE role IS NOT NULL GROUP BY ALL),
speakers AS (SELECT conv_id, window_index, string_agg(role, ',' ORDER BY t) AS speakers FROM seen GROUP BY ALL)
SELECT conv_id, window_index, any_value(speakers) AS speakers, string_agg(conv_id || '-' || turn, ',' ORDER BY turn) AS ids,
  CAST(length(string_agg(text, chr(10) ORDER BY turn)) AS BIGINT) AS chars, min(turn) AS earliest
FROM members JOIN speakers USING (conv_id, window_index) GROUP BY conv_id, window_index""",
    "speaker_blocks_summary": f"""WITH {ISLANDS},
blocks AS (SELECT conv_id, role, paragraph, min(turn) AS s, max(turn) AS e FROM islands GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY e - s DESC, paragraph DESC) AS r FROM blocks)
SELECT conv_id, role, count(*) AS blocks, CAST(sum(e - s) AS BIGINT) AS total_seconds, max(e - s) AS longest_seconds,
  max(CASE WHEN r = 1 THEN s || ',' || s + (e - s) // 2 || ',' || e END) AS samples FROM ranked GROUP BY conv_id, role""",
    "last_n_context": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 5",
    "moving_avg7": """SELECT CAST(day AS VARCHAR) AS day, mentions, round(avg(mentions) OVER (ORDER BY day ROWS 6 PRECEDING), 6) AS moving_avg
FROM (SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS mentions FROM events GROUP BY 1)""",
    "ts_format_parse": """SELECT event_id, s AS seconds, format('{:02d}:{:02d}:{:02d}', s // 3600, s % 3600 // 60, s % 60) AS stamp, s AS parsed
FROM (SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS s FROM events)""",
    "timestamp_repair": """WITH RECURSIVE rows AS (SELECT event_id // 50 AS video, event_id AS pos, event_id % 50 AS i, event_id % 7 AS kind, event_id % 50 * 41 // 60 AS m, event_id % 50 * 41 % 60 AS s FROM events),
parts AS (SELECT video, pos, i, CASE kind WHEN 0 THEN m WHEN 1 THEN m WHEN 2 THEN m WHEN 5 THEN NULL ELSE 0 END AS a, CASE kind WHEN 3 THEN 3 WHEN 4 THEN 60 + m WHEN 5 THEN NULL WHEN 6 THEN m ELSE s END AS b,
    CASE kind WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 3 THEN 19 WHEN 4 THEN s WHEN 6 THEN s END AS c, kind FROM rows),
plain AS (SELECT video, pos, i, kind, CASE WHEN c IS NOT NULL AND b <= 59 AND c <= 59 AND (video % 2 > 0 OR a * 3600 + b * 60 + c <= 9000) THEN a * 3600 + b * 60 + c END AS h,
    CASE WHEN kind = 2 THEN a * 60 + b WHEN c IS NULL THEN NULL WHEN b <= 59 AND (kind = 0 OR a >= 24) THEN a * 60 + b WHEN b > 59 AND a = 0 THEN b * 60 + c END AS o,
    CASE WHEN kind = 2 THEN 'mmss' WHEN kind = 0 THEN 'mmss_millis' WHEN b > 59 THEN 'mmss_zero_hours' ELSE 'mmss_hours' END AS why FROM parts),
read AS (SELECT *, count(coalesce(h, o)) OVER (PARTITION BY video ORDER BY pos) AS n FROM plain),
fold AS (SELECT video, i, pos, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS seconds, CAST('' AS VARCHAR) AS reason FROM read WHERE false
  UNION ALL SELECT DISTINCT video, -1, -1, NULL::BIGINT, NULL::BIGINT, '' FROM read
  UNION ALL SELECT r.video, r.i, r.pos, coalesce(x.s, f.last), x.s, CASE WHEN x.s IS NULL THEN 'invalid' ELSE (CASE WHEN x.s = r.h AND NOT (f.last IS NULL AND r.o IS NOT NULL AND r.why IN ('mmss_millis', 'mmss_hours')) THEN 'hms' ELSE r.why END) || CASE WHEN x.s < f.last AND r.why <> 'mmss' THEN '_non_monotonic' ELSE '' END END
    FROM fold f JOIN read r ON r.video = f.video AND r.i = f.i + 1, LATERAL (SELECT CASE WHEN f.last IS NULL THEN CASE WHEN r.o IS NOT NULL AND r.why IN ('mmss_millis', 'mmss_hours') THEN r.o ELSE coalesce(r.h, r.o) END
      WHEN r.h >= f.last AND r.o >= f.last THEN least(r.h, r.o) WHEN r.h >= f.last THEN r.h WHEN r.o >= f.last THEN r.o ELSE greatest(r.h, r.o) END AS s) x)
SELECT video, pos, coalesce(seconds, -1) AS seconds, reason FROM fold WHERE i >= 0""",
    "segment_timeline": """SELECT event_id, segment, segment * 540 AS start, least(segment * 540 + 600, d) AS "end" FROM (
  SELECT event_id, d, unnest(range(0, CAST(greatest(ceil((d - 600) / 540), 0) AS BIGINT) + 1)) AS segment FROM (SELECT event_id, CAST(floor(value * 30) AS BIGINT) AS d FROM events) WHERE d > 0)""",
    "segment_shift_dedupe": """WITH r AS (SELECT conv_id, turn, conv_id % 4 * 60 AS start, turn * 5 + CASE WHEN conv_id % 2 = 0 THEN conv_id % 4 * 60 ELSE 0 END AS seconds FROM conversations),
m AS (SELECT conv_id, turn, start, CASE WHEN min(seconds) OVER (PARTITION BY conv_id) < start - 2 THEN seconds + start ELSE seconds END AS seconds FROM r)
SELECT conv_id, turn, seconds FROM m WHERE start = 0 OR seconds < start - 2 OR seconds > start + 10""",
}
