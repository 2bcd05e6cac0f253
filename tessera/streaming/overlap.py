"""Captions and segments that overlap in time, both as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlapping_streams(cues: DataFrame, segments: DataFrame, key: str, buffer: int, longest_cue: int, longest_segment: int, late: str, how: str = "inner") -> DataFrame:
    """Cues with the segments of their ``key`` that they meet, widened by ``buffer`` seconds on both sides.

    Both have ``key``, ``start`` and ``end`` (timestamps), and other columns, which
    must differ in name; the segments' times are named seg_start and seg_end.  Rows
    that arrive more than ``late`` behind their stream are ignored.  As no cue or
    segment is longer than the lengths given (in seconds; longer ones may be missed), state
    is dropped once nothing that could meet it can arrive.  With ``how`` of
    ``left_outer`` a cue that meets none is given too, when that is certain.
    """
    own = cues.withWatermark("start", late)
    other = segments.withColumnsRenamed({"start": "seg_start", "end": "seg_end", key: "_key"}).withWatermark("seg_start", late)
    seconds = lambda n: F.expr(f"INTERVAL {int(n)} SECONDS")
    meets = (F.col("start") <= F.col("seg_end") + seconds(buffer)) & (F.col("end") >= F.col("seg_start") - seconds(buffer))
    bounds = (F.col("start") >= F.col("seg_start") - seconds(longest_cue + buffer)) & (F.col("start") <= F.col("seg_start") + seconds(longest_segment + buffer))
    return own.join(other, (F.col(key) == F.col("_key")) & bounds & meets, how).drop("_key")
