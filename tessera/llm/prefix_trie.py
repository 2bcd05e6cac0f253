"""Statistics of a conversations' prefix trie, by smallest-member ownership.

A node is a sequence of first turns; its owner is the smallest of the conversations
that begin with it.  If a conversation owns a node it owns all of its path below,
so it owns a suffix of its path, and every node has one owner.  Therefore sums over
the nodes of a subtree are sums over the subtree's conversations: each adds the
tokens of its own path from that depth on, less those of the nodes that it owns, and
one flag if it owns a leaf.  So one grouping by prefix gives all of them, and the
tree is never walked.

Turns are numbered and prefixes are hashed by windows over (conversation, range of
the table), which are shifted by what the ranges before hold; a conversation of any
length is spread over as many tasks as it has ranges.  Owners come from a partial
minimum, not from a window over the prefix, which would put the root's conversations
into one task.

A prefix is identified by its depth and two 64-bit sums (exclusive or) of hashes of
its turns with their places: two given prefixes are taken for one with a chance of
about 2^-128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.workspace import Workspace

#: Every conversation begins with turns of the one whose id is the next lower multiple of this, fewer than MOST of them.
FAMILY, MOST = 100, 6
#: Ids that are joined into one text before they reach their node's task.
CHUNK = 4096
_NODE = ["depth", "px", "py"]
_XOR = lambda a, b: a.bitwiseXOR(b)
_PLUS = lambda a, b: a + b


def running(rows: DataFrame, key: str, order: list, sums: dict[str, tuple[Callable[[Column], Column], Callable, Column]]) -> DataFrame:
    """``rows`` with running aggregates within ``key``: name to (aggregate, how two of them add up, what is aggregated); the aggregate also joins those of ranges (so a count is a sum of ones).

    ``rows`` have been dealt into ranges of (key, order), named ``_range``.  Within a
    range a window does the work.  At most one key goes on from a range into the
    next, so there are no more shifts than ranges, and they are broadcast.
    """
    local = Window.partitionBy(key, "_range").orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.select("*", *[agg(what).over(upto).alias(name) for name, (agg, _, what) in sums.items()])
    totals = rows.groupBy(key, "_range").agg(*[agg(what).alias(f"_{name}") for name, (agg, _, what) in sums.items()])
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(key, "_range", F.count("*").over(earlier).alias("_earlier"), *[agg(F.col(f"_{name}")).over(earlier).alias(f"_{name}") for name, (agg, _, _) in sums.items()]).where("_earlier > 0").drop("_earlier")
    joined = found.join(F.broadcast(shifts), [key, "_range"], "left")
    none = F.lit(0).cast("long")
    return joined.withColumns({name: plus(F.coalesce(name, none), F.coalesce(f"_{name}", none)) for name, (_, plus, _) in sums.items()}).drop(*[f"_{name}" for name in sums])


def _numbered(conversations: DataFrame, workspace: Workspace) -> DataFrame:
    """(conv_id, _range, pos, size, x, y): turns with their places, code points and hashes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    narrow = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.char_length(text).cast("long").alias("size"), F.xxhash64(F.lit(1), role, text).alias("x"), F.xxhash64(F.lit(2), role, text).alias("y")
    )
    order = [F.asc_nulls_first("turn"), "role", "x", "y"]
    narrow = workspace.save(narrow)
    dealt = workspace.save(narrow.repartitionByRange("conv_id", *order).withColumn("_range", F.spark_partition_id()))
    return workspace.save(running(dealt, "conv_id", order, {"pos": (F.sum, _PLUS, F.lit(1))}).drop("turn", "role"))


def _mark(name: str, depth: Column, turn: Column) -> Column:
    """A turn's hash at its place."""
    return F.xxhash64(F.lit(name), depth, turn)


def _occurrences(conversations: DataFrame, workspace: Workspace) -> DataFrame:
    """(conv_id, length, depth, px, py, size, rest): each rebuilt conversation's nodes with the root; ``rest`` counts the code points of its path from there on."""
    turns = _numbered(conversations, workspace)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST).alias("h")
    own = F.when(F.col("pos") > h, F.col("size")).otherwise(0)
    counted = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(own).alias("tokens"))
    first = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < MOST)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "size", "x", "y"))).alias("head"))
    counted = counted.select("*", h, (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")).join(first, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,size:bigint,x:bigint,y:bigint>>")), F.lit(1), F.col("h").cast("int"))
    known = counted.select("conv_id", "n", "h", "tokens", F.transform(head, lambda t: F.struct(t["size"].alias("size"), _mark("x", t["pos"], t["x"]).alias("x"), _mark("y", t["pos"], t["y"]).alias("y"))).alias("head"))
    zero = F.lit(0).cast("long")

    def so_far(name: str, plus: Callable) -> Column:
        """A sum over the first turns that come from the other conversation, upto each of them."""
        return F.transform("head", lambda _, i: F.aggregate(F.slice("head", F.lit(1), i + 1), zero, lambda a, t: plus(a, t[name])))

    known = known.select(
        "conv_id", "h", F.size("head").cast("long").alias("kept"), (F.size("head") + F.greatest(F.col("n") - F.col("h"), zero)).alias("length"), "tokens",
        F.arrays_zip(F.col("head.size").alias("size"), so_far("size", _PLUS).alias("upto"), so_far("x", _XOR).alias("px"), so_far("y", _XOR).alias("py")).alias("head"),
    )
    last = lambda name: F.coalesce(F.try_element_at(F.col(f"head.{name}"), F.lit(-1)), zero)
    known = workspace.save(known.select("conv_id", "h", "kept", "length", "head", last("upto").alias("given"), last("px").alias("hx"), last("py").alias("hy"), (F.col("tokens") + last("upto")).alias("all")))
    depth = F.col("pos") - F.col("h") + F.col("kept")
    tail = turns.join(known.drop("head"), "conv_id").where("pos > h").select("conv_id", "_range", "length", "all", "given", "hx", "hy", "size", depth.alias("depth"), _mark("x", depth, F.col("x")).alias("mx"), _mark("y", depth, F.col("y")).alias("my"))
    tail = running(workspace.save(tail), "conv_id", ["depth"], {"px": (F.bit_xor, _XOR, F.col("mx")), "py": (F.bit_xor, _XOR, F.col("my")), "past": (F.sum, _PLUS, F.col("size"))})
    columns = ["conv_id", "length", "depth", "px", "py", "size", "rest"]
    own = tail.select("conv_id", "length", "depth", _XOR(F.col("px"), F.col("hx")).alias("px"), _XOR(F.col("py"), F.col("hy")).alias("py"), "size", (F.col("all") - F.col("given") - F.col("past") + F.col("size")).alias("rest"))
    taken = known.select("conv_id", "length", "all", F.posexplode("head").alias("at", "t"))
    taken = taken.select("conv_id", "length", (F.col("at") + 1).cast("long").alias("depth"), "t.px", "t.py", "t.size", (F.col("all") - F.col("t.upto") + F.col("t.size")).alias("rest"))
    root = known.select("conv_id", "length", zero.alias("depth"), zero.alias("px"), zero.alias("py"), zero.alias("size"), F.col("all").alias("rest"))
    return workspace.save(own.select(columns).unionByName(taken).unionByName(root))


def _joined_ids(batches):
    """Of rows in order of node and id: each node's ids, at most CHUNK joined by commas, with the first of them."""
    for batch in batches:
        node = np.stack([batch.column(i).to_numpy() for i in range(3)])
        ids = batch.column(3).to_numpy()
        starts = np.flatnonzero(np.append(True, (node[:, 1:] != node[:, :-1]).any(axis=0))) if len(ids) else np.zeros(0, int)
        cuts = np.array([c for a, b in zip(starts, np.append(starts[1:], len(ids)), strict=True) for c in range(a, b, CHUNK)], int)
        joined = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, np.append(cuts[1:], len(ids)), strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.array(node[i][cuts]) for i in range(3)), pa.array(ids[cuts]), pa.array(joined, pa.string())], [*_NODE, "first", "ids"])


def _digests(batches):
    """Of rows in order of node and first id: each node's SHA-256 of all its ids, however many rows they come in."""
    at, digest, out = None, None, []

    def table():
        return pa.RecordBatch.from_arrays([*(pa.array([r[0][i] for r in out], pa.int64()) for i in range(3)), pa.array([r[1] for r in out], pa.string())], [*_NODE, "ends_sha256"])

    for batch in batches:
        for *node, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if node != at:
                if at is not None:
                    out.append((at, digest.hexdigest()))
                at, digest = node, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if out:
            yield table()
            out.clear()
    if at is not None:
        out.append((at, digest.hexdigest()))
        yield table()


def ends_of(occurrences: DataFrame, workspace: Workspace) -> DataFrame:
    """(depth, px, py, ends_sha256) of the nodes at which conversations end.

    Ids are joined to texts where the order by node and id has put them; a node's
    task gets a few thousandths of the rows and hashes them one after another.
    """
    ends = workspace.save(occurrences.where("depth = length").select(*_NODE, "conv_id"))
    dealt = ends.repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id")
    parts = dealt.mapInArrow(_joined_ids, "depth long, px long, py long, first long, ids string")
    return parts.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(_digests, "depth long, px long, py long, ends_sha256 string")


def trie(conversations: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """A row per node of the rebuilt conversations' trie: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation c is its family's first turns (those of c - c % FAMILY, with SQL's remainder, as many as
    crc32(c) % MOST, or all if it has fewer, or none if it isn't there), then its own
    turns after as many of its own.  Turns go by ``turn``, null first; equal ones by
    role, then by a hash of the text; a row that is repeated is a turn again.  Null roles and texts are empty;
    rows without conv_id belong to no conversation.  A conversation may be left
    without turns: it is a member of the root alone, and ends there.  An empty table
    has no nodes, not even a root.  Texts have any length; other columns are ignored.
    """
    workspace = workspace or Workspace(conversations.sparkSession, "trie")
    seen = _occurrences(conversations.select("conv_id", "turn", "role", "text"), workspace)
    nodes = seen.groupBy(*_NODE).agg(F.min("conv_id").alias("owner"), F.max("length").alias("deepest"), F.max("size").alias("size"))
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("since"), F.sum("size").alias("owned"), F.max((F.col("deepest") == F.col("depth")).cast("long")).alias("leaf"))
    marked = workspace.save(seen.join(workspace.save(owned), "conv_id", "left"))
    child = (F.col("since") <= F.col("depth") + 1) & (F.col("depth") < F.col("length"))
    summed = marked.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.coalesce(child.cast("long"), F.lit(0))).alias("n_children"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        F.sum(F.greatest(F.col("rest") - F.coalesce("owned", F.lit(0)), F.lit(0))).alias("saved_tokens"),
    )
    summed = workspace.save(summed)
    # a node whose parent has another owner: where its owner's suffix begins
    above = marked.where("depth = since - 1").select(*_NODE, F.col("conv_id").alias("_c"))
    above = workspace.save(above.join(summed.select(*_NODE, F.col("conv_id").alias("_parent")), _NODE).select("_c", (F.col("depth") + 1).alias("_d"), "_parent"))
    found = summed.join(above, (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("_d")), "left")
    found = found.join(ends_of(seen, workspace), _NODE, "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("_parent", "conv_id"))
    return found.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
