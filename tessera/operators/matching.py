"""Joins beyond plain equality: intervals, nearest dates, k-th occurrences, cascades, arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import score
from tessera.functions import text as ft
from tessera.functions import vocabulary as v
from tessera.operators.sequence import top_per_group


def apply_overrides(rows: DataFrame, overrides: DataFrame, by: str, seconds: str, value: str) -> DataFrame:
    """``rows`` with ``value`` replaced inside the intervals of ``overrides``.

    Overrides have ``by``, start, end, new_value and old_value (null: any).  The
    interval that begins last wins.  Intervals are looked up once for each
    distinct (by, seconds, value); ``by`` keeps that an equality join.
    """
    asked = rows.select(by, seconds, value).where(F.col(by).isNotNull() & F.col(seconds).isNotNull()).distinct().alias("r")
    inside = (F.col(f"r.{by}") == F.col(f"o.{by}")) & F.col(f"r.{seconds}").between(F.col("o.start"), F.col("o.end")) & (F.col("o.old_value").isNull() | (F.col("o.old_value") == F.col(f"r.{value}")))
    best = asked.join(overrides.alias("o"), inside).groupBy(f"r.{by}", f"r.{seconds}", f"r.{value}").agg(F.max_by("o.new_value", F.struct("o.start", "o.new_value")).alias("_new")).toDF("_b", "_s", "_v", "_new")
    joined = rows.join(best, (F.col(by) == F.col("_b")) & (F.col(seconds) == F.col("_s")) & F.col(value).eqNullSafe(F.col("_v")), "left")
    return joined.withColumn(value, F.coalesce("_new", value)).select(rows.columns)


def match_papers(videos: DataFrame, papers: DataFrame, days: int = 7, candidates: int = 25, most: int = 5) -> DataFrame:
    """The best ``most`` order papers of each video: (video, paper, day_delta, points, rank, confidence, status).

    Videos have video, title and uploaded; papers paper, sitting and session.  A
    video's date is its upload's, else that in its title.  Its candidates are the
    ``candidates`` papers nearest to it within ``days`` (then by paper), for a
    video without a date the first of all; those get points for upload date,
    title date and a chamber that title and session both name, 100 at most.

    Only date, title date and chambers of a video count, so papers are matched
    with the distinct ones of those, and of one day's papers only the first
    ``candidates`` are looked at: no join grows with the square of the tables.
    """
    named = lambda c: F.filter(F.array(*map(F.lit, v.CHAMBERS)), lambda w: F.contains(F.lower(F.coalesce(c, F.lit(""))), w))
    dated = videos.withColumn("_title", ft.title_date(F.col("title"))).withColumn("_day", F.coalesce("uploaded", "_title")).withColumn("_rooms", F.array_join(named(F.col("title")), ","))
    profiles = dated.select("_day", "_title", "_rooms").distinct()
    daily = top_per_group(papers.select("paper", "sitting", named(F.col("session")).alias("_room")), ["sitting"], [F.col("paper")], candidates)
    around = profiles.where("_day is not null").withColumn("sitting", F.explode(F.sequence(F.date_sub("_day", days), F.date_add("_day", days))))
    dateless = F.broadcast(papers.select("paper", "sitting", named(F.col("session")).alias("_room")).orderBy("paper").limit(candidates))
    found = around.join(daily, "sitting").unionByName(profiles.where("_day is null").join(dateless))
    found = found.withColumn("day_delta", F.abs(F.datediff("_day", "sitting")))
    key = ["_day", "_title", "_rooms"]
    found = top_per_group(found, key, [F.col("day_delta"), F.col("paper")], candidates)
    points = score.date_score(F.col("day_delta")) + score.title_score(F.datediff("_title", "sitting"), F.arrays_overlap(F.split("_rooms", ","), "_room"))
    found = found.withColumn("points", F.least(F.lit(100), points))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("points"), "day_delta", "paper"))).where(F.col("rank") <= most)
    ranked = ranked.withColumn("confidence", score.match_confidence(F.col("points"))).withColumn("status", score.match_status(F.col("confidence")))
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"m.{c}")) for c in key]
    return dated.select("video", *key).alias("v").join(ranked.alias("m"), same).select("v.video", "m.paper", "m.day_delta", "m.points", "m.rank", "m.confidence", "m.status")


def decisions(videos: DataFrame, ranked: DataFrame) -> DataFrame:
    """(video, paper, points, confidence, status, candidates) for every video from ``match_papers``; without a candidate a low one to review."""
    order = F.array_sort(F.collect_list(F.struct("rank", "paper", "points")))
    best = ranked.groupBy("video").agg(F.min_by(F.struct("paper", "points", "confidence", "status"), "rank").alias("b"), F.transform(order, lambda x: F.struct(x["paper"].alias("paper"), x["points"].alias("points"))).alias("candidates"))
    out = videos.select("video").join(best, "video", "left")
    return out.select("video", "b.paper", F.coalesce("b.points", F.lit(0)).alias("points"), F.coalesce("b.confidence", F.lit("low")).alias("confidence"), F.coalesce("b.status", F.lit("needs_review")).alias("status"), F.coalesce("candidates", F.array().cast(best.schema["candidates"].dataType)).alias("candidates"))


def overlapping(cues: DataFrame, segments: DataFrame, by: str, buffer: float = 0.0) -> DataFrame:
    """(segment, cue) pairs of one ``by`` whose intervals overlap, segments widened by ``buffer`` on both sides."""
    c, s = cues.alias("c"), segments.alias("s")
    return c.join(s, (F.col(f"c.{by}") == F.col(f"s.{by}")) & (F.col("c.start") <= F.col("s.end") + buffer) & (F.col("c.end") >= F.col("s.start") - buffer))


def kth_occurrence(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """The k-th left row of each key joined with its k-th right row; ``occurrence`` is k."""
    number = lambda rows, order: rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return number(left, left_order).join(number(right, right_order), [*keys, "occurrence"])


def resolve_in_tiers(rows: DataFrame, tiers: Sequence[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """``rows`` with ``resolved`` and ``tier`` from the first lookup that knows the row's key.

    A tier is (lookup, key column of rows, key column of lookup, value column); a
    lookup key with more than one value resolves nothing.
    """
    out, found, level = rows, [], F.lit(None).cast("int")
    for i, (lookup, own, key, value) in enumerate(tiers):
        sole = lookup.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_k{i}")).agg(F.min(value).alias(f"_v{i}"), F.count_distinct(value).alias("_c")).where("_c = 1").drop("_c")
        out = out.join(sole, F.col(own) == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_v{i}"))
    for i in reversed(range(len(tiers))):
        level = F.when(F.col(f"_v{i}").isNotNull(), F.lit(i)).otherwise(level)
    return out.withColumn("resolved", F.coalesce(*found)).withColumn("tier", level).select(*rows.columns, "resolved", "tier")


def remap_array(rows: DataFrame, key: str, array: str, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """``rows`` (unique by key) with array elements replaced by ``mapping``, in their order; unknown ones stay."""
    items = rows.select(key, F.posexplode(array).alias("pos", "item"))
    mapped = items.join(mapping.select(F.col(old).alias("item"), F.col(new).alias("_new")), "item", "left")
    packed = mapped.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("_new", "item").alias("v")))).alias("_a"))
    packed = packed.select(key, F.transform("_a", lambda x: x["v"]).alias("_a"))
    return rows.join(packed, key, "left").withColumn(array, F.coalesce("_a", array)).drop("_a")


def in_any(rows: DataFrame, keys: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of which one of ``columns`` is among ``keys``: a union of semi joins, each row once."""
    known, out, seen = keys.select(F.col(key).alias("_k")).distinct(), None, F.lit(False)
    for c in columns:
        hit = rows.join(known.withColumn("_hit", F.lit(True)), F.col(c) == F.col("_k"), "left").select(*rows.columns, F.coalesce("_hit", F.lit(False)).alias(f"_hit_{c}")) if out is None else out.join(known.withColumn("_hit", F.lit(True)), F.col(c) == F.col("_k"), "left").select(*out.columns, F.coalesce("_hit", F.lit(False)).alias(f"_hit_{c}"))
        out, seen = hit, seen | F.col(f"_hit_{c}")
    return out.where(seen).select(rows.columns)


def date_between(column: Column, start, end) -> Column:
    """A conjunction of the bounds that are given."""
    out = F.lit(True)
    if start is not None:
        out = out & (column >= F.lit(start))
    if end is not None:
        out = out & (column <= F.lit(end))
    return out
