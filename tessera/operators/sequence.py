"""Operators on ordered rows of a sequence: islands, windows, ranks, repairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as ft
from tessera.plans.workspace import Workspace


def islands(rows: DataFrame, by: Sequence[str], order: Sequence[str], key: str, name: str = "island") -> DataFrame:
    """``rows`` with the 0-based number of the run of equal ``key`` values that each is in; null is a value of its own."""
    ordered = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.row_number().over(ordered) == 1, 0).otherwise((~F.col(key).eqNullSafe(F.lag(key).over(ordered))).cast("int"))
    return rows.withColumn("_new", new).withColumn(name, F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def paragraphs(rows: DataFrame, by: Sequence[str], order: Sequence[str], speaker: str, text: str, seconds: str) -> DataFrame:
    """One row for each run of one speaker: text joined by blanks, first and last seconds, number of sentences; runs without a speaker are left out."""
    marked = islands(rows, by, order, speaker, "paragraph").where(F.col(speaker).isNotNull())
    part = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    grouped = marked.groupBy(*by, "paragraph", speaker).agg(part.alias("_parts"), F.min(seconds).alias("start_seconds"), F.max(seconds).alias("end_seconds"), F.count("*").alias("sentences"))
    return grouped.withColumn("text", F.array_join(F.transform("_parts", lambda p: p["_text"]), " ")).drop("_parts")


def sliding_windows(rows: DataFrame, by: Sequence[str], order: Sequence[str], size: int, stride: int, short_ok: bool = False) -> DataFrame:
    """Every row once for each count window that it is in, with ``window_index`` and ``position``.

    Only full windows of ``size`` rows, begun every ``stride`` rows, count; with
    ``short_ok`` a sequence of fewer rows is one window.
    """
    at = Window.partitionBy(*by).orderBy(*order)
    whole = Window.partitionBy(*by)
    indexed = rows.withColumn("position", F.row_number().over(at) - 1).withColumn("_n", F.count("*").over(whole))
    first = F.greatest(F.ceil((F.col("position") - size + 1) / stride), F.lit(0)).cast("int")
    last = F.floor(F.col("position") / stride).cast("int")
    full = indexed.withColumn("_lo", first).withColumn("_hi", last).where("_lo <= _hi")
    full = full.withColumn("window_index", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi").where(F.col("window_index") * stride + size <= F.col("_n"))
    if short_ok:
        full = full.unionByName(indexed.where(F.col("_n") < size).withColumn("window_index", F.lit(0)))
    return full.drop("_n")


def window_properties(members: DataFrame, by: Sequence[str], text: str, speaker: str, seconds: str, identity: str) -> DataFrame:
    """One row for each window: text lines in order, ids, speakers in first-seen order, earliest seconds."""
    part = F.array_sort(F.collect_list(F.struct("position", F.col(text).alias("t"), F.col(speaker).alias("s"), F.col(identity).alias("i"))))
    grouped = members.groupBy(*by, "window_index").agg(part.alias("_p"), F.min(seconds).alias("earliest_seconds"))
    pick = lambda f: F.transform("_p", lambda p: p[f])
    speakers = F.filter(F.array_distinct(pick("s")), lambda s: s.isNotNull())
    return grouped.select(*by, "window_index", F.array_join(pick("t"), "\n").alias("text"), pick("i").alias("ids"), speakers.alias("speakers"), "earliest_seconds")


def moving_average(rows: DataFrame, by: Sequence[str], order: str, value: str, size: int = 7, name: str = "moving_avg") -> DataFrame:
    """Mean over the row and the ``size - 1`` rows before it; fewer at the head."""
    return rows.withColumn(name, F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(1 - size, 0)))


def suffixed_ids(rows: DataFrame, by: Sequence[str], order: Sequence[str], base: Column, name: str = "id") -> DataFrame:
    """``base`` for its first occurrence, and base_2, base_3 ... for the next."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn(name, F.when(n == 1, base).otherwise(F.concat(base, F.lit("_"), n.cast("string"))))


def last_n(rows: DataFrame, by: Sequence[str], order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each sequence."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")


def top_per_group(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group in an order that should have no ties."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def after_first(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """``rows`` without the first ``n`` in ascending order (then by the other columns), sorted; an offset that isn't one task's work.

    Only the first rows' keys are put in one place; the others are compared with the last of these.
    """
    others = [c for c in rows.columns if c not in order]
    keyed = rows.withColumn("_k", F.struct(*order))
    first = keyed.select("_k").orderBy("_k").limit(n).groupBy("_k").agg(F.count("*").alias("_n"))
    last = F.broadcast(first.agg(F.max(F.struct("_k", "_n")).alias("_l")).select(F.col("_l._k").alias("_last"), F.col("_l._n").alias("_cut")))
    reached = keyed.join(last, F.col("_k") >= F.col("_last"))
    place = F.row_number().over(Window.partitionBy("_k").orderBy(*others)) if others else F.row_number().over(Window.partitionBy("_k").orderBy("_k"))
    equal = reached.where("_k = _last").withColumn("_p", place).where("_p > _cut")
    return reached.where("_k > _last").select(rows.columns).union(equal.select(rows.columns)).orderBy(*order)


def block_summary(blocks: DataFrame, by: Sequence[str], start: str, end: str, number: str) -> DataFrame:
    """For each speaker: number of blocks, total and longest length, and three sample points of the longest (the later of equals)."""
    length = F.col(end) - F.col(start)
    longest = F.max(F.struct(length.alias("length"), F.col(number).alias("number"), F.col(start).alias("start"), F.col(end).alias("end"))).alias("_l")
    found = blocks.groupBy(*by).agg(F.count("*").alias("blocks"), F.sum(length).alias("total_seconds"), longest)
    middle = F.col("_l.start") + F.floor((F.col("_l.end") - F.col("_l.start")) / 2)
    return found.select(*by, "blocks", "total_seconds", F.col("_l.length").alias("longest_seconds"), F.array("_l.start", middle, "_l.end").alias("samples"))


def repair_timestamps(rows: DataFrame, by: Sequence[str], order: str, raw: str, duration: str | None = None) -> DataFrame:
    """``rows`` with ``seconds`` and ``reason``: damaged timestamps read so that they fall as little as possible within a sequence.

    Of a timestamp's readings the nearest one not before the row before counts;
    if all are before it, the nearest, with ``_non_monotonic`` added to its reason.
    The first readable row takes its likeliest reading.  A row without a reading
    has null seconds, reason ``invalid``, and doesn't count as a row before.
    Only a row with two readings depends on what was chosen before it, so a
    sequence is cut after every row with one, and only the parts are folded.
    """
    at = Window.partitionBy(*by).orderBy(order)
    upto = at.rowsBetween(Window.unboundedPreceding, 0)
    read = rows.withColumn("_r", ft.timestamp_readings(F.col(raw), F.col(duration) if duration else None))
    readable = F.size("_r") > 0
    read = read.withColumn("_n", F.sum(readable.cast("int")).over(upto))
    read = read.withColumn("_r", F.when(readable & (F.col("_n") == 1), F.array(ft.first_reading(F.col("_r")))).otherwise(F.col("_r")))
    read = read.withColumn("_part", F.sum((F.size("_r") == 1).cast("int")).over(upto))
    packed = read.groupBy(*by, "_part").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*rows.columns).alias("row"), F.col("_r").alias("r")))).alias("a"))

    def step(chosen, x):
        """The place of the reading among the row's, after those of the rows before it."""
        last = F.element_at(chosen, -1)
        nearest = F.array_min(F.transform(F.filter(x["r"], lambda c: c["seconds"] >= last), lambda c: c["seconds"]))
        seconds = F.coalesce(nearest, F.array_max(F.transform(x["r"], lambda c: c["seconds"])))
        return F.concat(chosen, F.array(F.coalesce(F.when(F.size(x["r"]) == 1, x["r"][0]["seconds"]).when(F.size(x["r"]) > 1, seconds), last)))

    folded = packed.withColumn("s", F.slice(F.aggregate("a", F.array(F.lit(None).cast("long")), step), F.lit(2), F.size("a")))
    each = folded.select(F.explode(F.arrays_zip("a", "s")).alias("x")).select("x.a.row.*", F.when(F.size("x.a.r") > 0, F.col("x.s")).alias("seconds"), F.col("x.a.r").alias("_r"))
    before = F.last("seconds", ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, -1))
    reason = F.filter("_r", lambda c: c["seconds"] == F.col("seconds"))[0]["reason"]
    falls = (before > F.col("seconds")) & (reason != "mmss")
    return each.withColumn("reason", F.when(F.col("seconds").isNull(), "invalid").when(falls, F.concat(reason, F.lit("_non_monotonic"))).otherwise(reason)).drop("_r")


def time_ranges(sentences: DataFrame, by: Sequence[str], seconds: str, stamp: str) -> DataFrame:
    """(by, start_seconds, end_seconds, start_timestamp, end_timestamp) of groups: least and largest seconds, and apart from them the least and largest stamps as texts."""
    return sentences.groupBy(*by).agg(F.min(seconds).alias("start_seconds"), F.max(seconds).alias("end_seconds"), F.min(stamp).alias("start_timestamp"), F.max(stamp).alias("end_timestamp"))


def running_number(rows: DataFrame, order: Sequence[str], name: str, workspace: Workspace | None = None, each: int = 500_000) -> DataFrame:
    """``rows`` with their 1-based place in one order over all of them.

    Ranges of the order are numbered apart, about ``each`` rows in one, and
    shifted by the number of rows before them, so no task holds the table.
    """
    workspace = workspace or Workspace(rows.sparkSession, "numbers")
    parts = max(1, -(-rows.count() // each))
    dealt = workspace.save(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    # as many rows as ranges
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = dealt.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return numbered.join(sizes.select("_range", before.alias("_before")), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def timeline(sequences: DataFrame, key: str, duration: Column, length: int, overlap: int) -> DataFrame:
    """(key, segment, start, end) in seconds: segments of ``length`` begun ``length - overlap`` after one another, the last cut off at the duration.

    A segment that reaches the end is the last one; no duration, no segment.
    """
    if not 0 <= overlap < length:
        raise ValueError("the overlap must be shorter than a segment")
    stride = length - overlap
    last = F.greatest(F.ceil((duration - length) / stride), F.lit(0)).cast("long")
    rows = sequences.where(duration > 0).select(key, duration.cast("long").alias("_d"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("segment"))
    start = F.col("segment") * stride
    return rows.select(key, "segment", start.alias("start"), F.least(start + length, F.col("_d")).alias("end"))


def shift_segments(rows: DataFrame, by: Sequence[str], seconds: str, start: str, tolerance: int = 2) -> DataFrame:
    """``rows`` with times that a segment gives from its own beginning moved to its start: all of a segment, if its first is more than ``tolerance`` before the start."""
    least = F.min(seconds).over(Window.partitionBy(*by))
    return rows.withColumn(seconds, F.when(least < F.col(start) - tolerance, F.col(seconds) + F.col(start)).otherwise(F.col(seconds)))


def outside_band(rows: DataFrame, seconds: str, low: Column, high: Column, tolerance: int = 2) -> DataFrame:
    """Rows before or after a band of time widened by ``tolerance``; all where the band is null (a first segment has none)."""
    within = F.col(seconds).between(low - tolerance, high + tolerance)
    return rows.where(~F.coalesce(within, F.lit(False)))
