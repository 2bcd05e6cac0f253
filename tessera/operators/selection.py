"""Exact percentiles of groups of any size, by narrowing intervals to the ranks that are asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.workspace import Workspace

#: Parts of about equal count that a pass cuts an interval into, and values that are few enough to be put in order.
PARTS, FEW = 256, 2048
#: Open ranks that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _at_ranks(rows: DataFrame, by: list[str], ranks: DataFrame, workspace: Workspace) -> DataFrame:
    """(by, rank, value) for ranks (by, rank, from 0, with the group's low, high and left): the value that has so many before it.

    A pass sketches the values of each open interval, takes the sketch's quantiles
    on both sides of the rank, and counts exactly what lies before, at, between and
    after them.  It goes on where the rank is, usually between, with the least and
    the largest value there, and ends where these are equal, or few values are
    left, which are then ordered.  As quantiles are values themselves, each pass
    leaves one out or ends at it, even if there are only two.  So passes grow with
    the logarithm of the count, however values are spread, and a poor sketch costs
    a pass but not the result.
    """
    group = [F.col(f"g.{c}").eqNullSafe(F.col(f"v.{c}")) for c in by]
    within = F.col("v._value").between(F.col("g.low"), F.col("g.high"))

    def with_values(open_: DataFrame) -> DataFrame:
        sent = F.broadcast(open_) if open_.count() <= BROADCAST_ROWS else open_
        condition = within
        for g in group:
            condition = condition & g
        return rows.alias("v").join(sent.alias("g"), condition).select("g.*", "v._value")

    state, done = workspace.save(ranks.withColumn("below", F.lit(0).cast("long"))), []
    key = [*by, "rank"]
    while True:
        done.append(state.where("low = high").select(*key, F.col("low").alias("value")))
        done.append(state.where(f"low < high and left <= {FEW}"))
        open_ = state.where(f"low < high and left > {FEW}")
        if not open_.limit(1).count():
            break
        own = [*key, "low", "high", "left", "below"]
        quantiles = F.percentile_approx("_value", [i / PARTS for i in range(PARTS + 1)], 8 * PARTS)
        at = F.floor((F.col("rank") - F.col("below")) * PARTS / F.col("left")).cast("int")
        sketched = with_values(open_).groupBy(*own).agg(quantiles.alias("q"))
        edges = sketched.select(*own, F.get("q", F.greatest(at - 1, F.lit(0))).alias("from"), F.get("q", F.least(at + 2, F.lit(PARTS))).alias("to"))
        part = F.when(F.col("_value") < F.col("from"), 0).when(F.col("_value") == F.col("from"), 1).when(F.col("_value") < F.col("to"), 2).when(F.col("_value") == F.col("to"), 3).otherwise(4)
        bins = with_values(workspace.save(edges)).groupBy(*key, "below", part.alias("bin"))
        bins = bins.agg(F.count("*").alias("left"), F.min("_value").alias("low"), F.max("_value").alias("high"))
        before = F.coalesce(F.sum("left").over(Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = bins.withColumn("below", F.col("below") + before).where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("left")))
        state = workspace.save(bins.select(*key, "low", "high", "left", "below"))
    small = done[1::2]
    few = small[0]
    for d in small[1:]:
        few = few.unionByName(d)
    place = F.row_number().over(Window.partitionBy(*key).orderBy("_value")) - 1 + F.col("below")
    found = with_values(workspace.save(few)).withColumn("_place", place).where("_place = rank").select(*key, F.col("_value").alias("value"))
    for d in done[::2]:
        found = found.unionByName(d)
    return found


def percentiles(rows: DataFrame, by: Sequence[str], value: Column, points: dict[str, float], workspace: Workspace | None = None) -> DataFrame:
    """``by`` and a column for each of ``points`` (name to a share from 0 to 1): exact percentiles, interpolated between neighbours.

    Nulls, NaN and endless values don't count; a group without others has nulls.
    ``rows`` is read several times.
    """
    workspace, by = workspace or Workspace(rows.sparkSession, "percentiles"), list(by)
    finite = rows.select(*by, value.cast("double").alias("_value"))
    good = ~F.isnan("_value") & (F.abs("_value") != float("inf"))
    finite = workspace.save(finite.withColumn("_value", F.when(good, F.col("_value"))))
    groups = workspace.save(finite.groupBy(*by).agg(F.min("_value").alias("low"), F.max("_value").alias("high"), F.count("_value").alias("left")))
    spots = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("left") - 1)).alias("spot")) for name, p in points.items()])
    asked = groups.where("left > 0").select(*by, "low", "high", "left", F.explode(spots).alias("s")).select(*by, "low", "high", "left", "s.*")
    asked = asked.withColumns({"first": F.floor("spot").cast("long"), "second": F.ceil("spot").cast("long")})
    ranks = asked.select(*by, "low", "high", "left", F.explode(F.array("first", "second")).alias("rank")).distinct()
    values = workspace.save(_at_ranks(finite.where("_value is not null"), by, ranks, workspace))

    def value_at(frame: DataFrame, rank: str) -> DataFrame:
        other = values.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("rank").alias("_rank"), F.col("value").alias(f"{rank}_value"))
        condition = F.col(rank) == F.col("_rank")
        for c in by:
            condition = condition & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return frame.join(other, condition).drop("_rank", *[f"_{c}" for c in by])

    both = value_at(value_at(asked, "first"), "second")
    exact = F.col("first_value") + (F.col("second_value") - F.col("first_value")) * (F.col("spot") - F.col("first"))
    wide = both.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, exact)).alias(name) for name in points])
    condition = F.lit(True)
    for c in by:
        condition = condition & F.col(f"g.{c}").eqNullSafe(F.col(f"w.{c}"))
    return groups.alias("g").join(wide.alias("w"), condition, "left").select(*[f"g.{c}" for c in by], *[f"w.{name}" for name in points])
