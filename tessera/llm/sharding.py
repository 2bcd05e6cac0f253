"""Shards of even row counts by balanced label propagation.

Documents with equal texts are linked.  Every document starts in the shard its
id hashes to.  In each round linked documents ask to move to the shard that holds
most of their neighbours, among shards with room; a shard takes as many as its
quota has room for.  When nothing moves that way, a round looks at all shards,
and two shards exchange as many documents as ask both ways; rounds end when
nothing moves this way either.  Documents without links then fill every shard up to its exact
share, so counts differ by one at most.

Linked documents of one group in one shard are interchangeable, so a round
works on *cells*: (group, shard, number of documents), at most one for each
shard and group.  Running sums over a shard or a large group are taken over
small hashed buckets first and within each bucket then, so that no task sees a
whole shard or group.
"""

from __future__ import annotations

import math
import warnings
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.workspace import Workspace

#: Rows that a running sum takes in one go, about; small tables are dealt into more buckets than that needs.
RUN, LEAST_RUN, LEAST_BUCKETS = 20_000, 200, 64
#: Members of a group that are given their places in one go.
PLACED = 2000
#: Rounds of propagation, at most.
ROUNDS = 16


def running_sum(rows: DataFrame, by: list[str], value: str, order: list[str], name: str, count: int | None = None) -> DataFrame:
    """``rows`` with, as ``name``, the sum of ``value`` over the rows of the same ``by`` before it.

    The order is by a hash of ``order``, then by ``order``; rows equal in it are
    taken in any order.  ``count`` is the number of rows, if known.
    """
    count = rows.count() if count is None else count
    buckets = max(1, math.ceil(count / RUN), min(LEAST_BUCKETS, math.ceil(count / LEAST_RUN)))
    keyed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    within = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy(*by, "_bucket").agg(F.sum(value).alias("_sum"))
    sums = sums.select(*by, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    own = keyed.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return own.join(sums, [*by, "_bucket"]).withColumn(name, F.col(name) + F.col("_before")).drop("_bucket", "_before")


def _pick(values: list[int], index):
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), index + 1)


def _flows(wanted: list[list[int]], rooms: list[int]) -> list[list[int]]:
    """How many documents may go from each shard to each other: exchanges both ways, and what the rooms take besides."""
    shards = range(len(rooms))
    flows = [[min(wanted[a][b], wanted[b][a]) for b in shards] for a in shards]
    for b in shards:
        left = rooms[b]
        for a in sorted(shards, key=lambda a: flows[a][b] - wanted[a][b]):
            more = min(left, wanted[a][b] - flows[a][b])
            flows[a][b] += more
            left -= more
    return flows


def _round(cells: DataFrame, rooms: list[int], open_only: bool, workspace: Workspace) -> DataFrame:
    """The cells after one round, with the number of documents that moved into each as ``moved``."""
    shards = len(rooms)
    # a group's cells are as many as shards, at most
    targets = cells.where(_pick(rooms, F.col("shard")) > 0) if open_only else cells
    # of cells of one size the hash decides, not the shard's number, so that no shard is everyone's choice
    tie = F.xxhash64("group", "shard")
    best = targets.groupBy("group").agg(F.max(F.struct("n", tie.alias("tie"), "shard")).alias("best"))
    aimed = cells.join(best, "group").withColumn("to", F.col("best.shard")).withColumn("gain", F.col("best.n") - F.col("n"))
    # a cell in a full shard also joins a smaller one, if all of it can go: that mends every edge between the two
    full = F.lit(open_only) & (_pick(rooms, F.col("shard")) <= 0)
    goes = (F.col("to") != F.col("shard")) & ((F.col("gain") > 0) | full | ((F.col("gain") == 0) & (F.col("best.tie") > tie)))
    moves = workspace.save(aimed.where(goes).select("group", "shard", "n", "to", "gain", F.floor(F.log2(F.greatest(F.col("gain"), F.lit(0)) + 1)).alias("worth")))
    wanted = [[0] * shards for _ in rooms]
    for r in moves.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect():
        wanted[r["shard"]][r["to"]] = r["n"]
    flow = _pick([n for row in _flows(wanted, rooms) for n in row], F.col("shard") * shards + F.col("to"))
    # the most worthwhile moves first: whole classes of gain, then a running sum within the class
    classes = moves.groupBy("shard", "to", "worth").agg(F.sum("n").alias("_n"))
    ahead = Window.partitionBy("shard", "to").orderBy(F.desc("worth")).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("shard", "to", "worth", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    asked = running_sum(moves, ["shard", "to", "worth"], "n", ["group"], "asked").join(classes, ["shard", "to", "worth"])
    taken = F.greatest(F.lit(0), F.least(F.col("n"), flow - F.col("asked") - F.col("_ahead")))
    taken = F.when((F.col("gain") >= 0) | (taken == F.col("n")), taken).otherwise(0)
    moved = asked.withColumn("taken", taken).where("taken > 0").select("group", "shard", "to", "taken")
    none = F.lit(0).cast("long").alias("moved")
    every = cells.select("group", "shard", "n", none)
    every = every.unionByName(moved.select("group", "shard", (-F.col("taken")).alias("n"), none))
    every = every.unionByName(moved.select("group", F.col("to").alias("shard"), F.col("taken").alias("n"), F.col("taken").alias("moved")))
    return every.groupBy("group", "shard").agg(F.sum("n").alias("n"), F.sum("moved").alias("moved")).where("n > 0")


def shard(docs: DataFrame, shards: int = 24, text: str = "text", workspace: Workspace | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every document.

    size is the text's UTF-8 bytes plus 8.  Counts of shards differ by one at
    most, and slots are gapless from 0 in each.  Null texts have no bytes, CRC 0
    and no links; empty texts are equal to each other; repeated rows are
    documents of their own, and null ids are allowed.  Other columns are left out.
    Very long texts count with all their bytes.  Shards in which a group has
    equally many are told apart by a hash.  Propagation takes at most ``rounds``
    rounds, and a warning tells if moves were left then; sizes and slots are as
    promised all the same.
    """
    workspace = workspace or Workspace(docs.sparkSession, "shards")
    body = F.col(text)
    rows = workspace.save(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(body), F.lit(0)) + 8).cast("long").alias("size"),
            F.coalesce(F.crc32(body.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.md5(body.cast("binary")).alias("group"),
        )
    )
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    groups = rows.where("group is not null").groupBy("group").agg(F.count("*").alias("members")).where("members > 1")
    tied = rows.join(groups, "group", "left")
    tied = workspace.save(tied)
    linked, single = tied.where("members is not null"), tied.where("members is null")

    begun = linked.withColumn("shard", F.pmod(F.xxhash64("doc_id", "size"), F.lit(shards)).cast("int"))
    cells = workspace.save(_within(begun.groupBy("group", "shard").agg(F.count("*").alias("n")), quota, workspace))
    exchange = False
    for _ in range(rounds):
        rooms = [q - h for q, h in zip(quota, _held(cells, shards), strict=True)]
        after = workspace.save(_round(cells, rooms, not exchange, workspace))
        moved = after.agg(F.sum("moved")).first()[0] or 0
        cells = after.select("group", "shard", "n")
        if not moved and exchange:
            break
        exchange = not moved
    else:
        warnings.warn(f"label propagation ended after {rounds} rounds with moves left", stacklevel=2)
    held = _held(cells, shards)

    placed = running_sum(cells, ["shard"], "n", ["group"], "slot_from")
    order = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("rank_from", F.coalesce(F.sum("n").over(order), F.lit(0)))
    # a large group's cells are there once for every PLACED members, so that no task has to place all of them
    by_group = placed.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("rank_from", "n", "shard", "slot_from"))).alias("cells"), F.sum("n").alias("_m"))
    by_group = by_group.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_m") / PLACED) - 1))).drop("_m")
    ranked = running_sum(linked.withColumn("one", F.lit(1)), ["group"], "one", ["doc_id", "size"], "rank")
    ranked = ranked.withColumn("_salt", F.pmod(F.col("rank"), F.ceil(F.col("members") / PLACED)))
    found = F.filter("cells", lambda c: (c["rank_from"] <= F.col("rank")) & (F.col("rank") < c["rank_from"] + c["n"]))[0]
    grouped = ranked.join(by_group, ["group", "_salt"]).withColumn("cell", found)
    grouped = grouped.select("doc_id", "size", "text_crc32", F.col("cell.shard").cast("int").alias("shard"), (F.col("cell.slot_from") + F.col("rank") - F.col("cell.rank_from")).alias("slot"))

    spare = [q - h for q, h in zip(quota, held, strict=True)]
    upto = list(accumulate(spare))
    ordered = running_sum(single.withColumn("one", F.lit(1)).withColumn("all", F.lit(0)), ["all"], "one", ["doc_id", "size", "text_crc32"], "rank")
    into = F.size(F.filter(F.array(*[F.lit(u).cast("long") for u in upto]), lambda u: u <= F.col("rank")))
    singles = ordered.withColumn("shard", into.cast("int"))
    start = [u - s for u, s in zip(upto, spare, strict=True)]
    slot = F.col("rank") - _pick(start, F.col("shard")) + _pick(held, F.col("shard"))
    return grouped.unionByName(singles.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot")))


def _held(cells: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _within(cells: DataFrame, quota: list[int], workspace: Workspace) -> DataFrame:
    """Cells of the hashed start, with what exceeds a quota moved to shards that have room."""
    shards, cells = len(quota), workspace.save(cells)
    held = _held(cells, shards)
    over = [max(0, h - q) for h, q in zip(held, quota, strict=True)]
    if not any(over):
        return cells
    room = list(accumulate(max(0, q - h) for h, q in zip(held, quota, strict=True)))
    base = [sum(over[:s]) for s in range(shards)]
    run = running_sum(cells, ["shard"], "n", ["group"], "before")
    # the first `over` documents of a shard leave it; they fill the rooms in order
    leaving = F.greatest(F.lit(0), F.least(F.col("n"), _pick(over, F.col("shard")) - F.col("before")))
    run = run.withColumn("leaving", leaving).withColumn("low", _pick(base, F.col("shard")) + F.col("before"))
    stay = run.select("group", "shard", (F.col("n") - F.col("leaving")).alias("n"))
    ends = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(r).cast("long").alias("b"), F.lit(room[s - 1] if s else 0).cast("long").alias("a")) for s, r in enumerate(room)])
    into = run.where("leaving > 0").withColumn("e", F.explode(ends))
    part = F.least(F.col("low") + F.col("leaving"), F.col("e.b")) - F.greatest("low", "e.a")
    into = into.select("group", F.col("e.s").alias("shard"), part.alias("n")).where("n > 0")
    return stay.unionByName(into).groupBy("group", "shard").agg(F.sum("n").alias("n")).where("n > 0")
