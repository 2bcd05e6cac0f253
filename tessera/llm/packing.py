"""Hierarchical multi-length packing of token sequences.

Documents are encoded once and cut into pieces: whole long windows and one
remainder.  Remainders are routed to the tier of the smallest context size that
holds them.  Long-tier remainders open long windows, whose gaps are filled with
the best fitting pieces of shorter tiers; what is left of a shorter tier is
paired into exactly full windows of its own size; the rest fills further long
windows, longest first, and the emptiest of these are cut up to close the gaps
of the others.  All of this is planned on the driver from the number of
pieces of each length only: at most ``sizes[-1]`` numbers, however many pieces.
Pieces find their places by their rank among pieces of their length.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bpe
from tessera.llm.textarrays import plain, slices
from tessera.plans.workspace import Workspace

#: Context sizes of the tiers, ascending; powers of two.
SIZES = (128, 256, 512, 1024)
END_ID = 0
#: Tokens of one optimiser step, about.
STEP_TOKENS = 1 << 19
#: Pieces ranked in one go, about.
RANKED = 50_000


class Item(NamedTuple):
    """Equal parts of ``count`` pieces: those of one length whose ranks begin at ``rank``, from ``start`` on."""

    length: int
    count: int
    piece: int
    rank: int
    start: int

    def first(self, count: int) -> Item:
        return self._replace(count=count)

    def after(self, count: int) -> Item:
        return self._replace(count=self.count - count, rank=self.rank + count)


@dataclass
class Plan:
    """Kinds of window: how many there are, their size, and what lies in them one after the other."""

    kinds: list[tuple[int, int, tuple[Item, ...]]] = field(default_factory=list)

    def sequences(self) -> int:
        return sum(count for count, _, _ in self.kinds)

    def tokens(self) -> int:
        return sum(count * sum(i.length for i in items) for count, _, items in self.kinds)


class _Windows:
    """Open windows of the longest size, by the gap that they have."""

    def __init__(self, size: int) -> None:
        self.size, self.gaps = size, []
        self.by_gap: dict[int, list[tuple[int, tuple[Item, ...]]]] = {}

    def add(self, count: int, items: tuple[Item, ...]) -> None:
        gap = self.size - sum(i.length for i in items)
        if gap not in self.by_gap:
            bisect.insort(self.gaps, gap)
            self.by_gap[gap] = []
        self.by_gap[gap].append((count, items))

    def take(self, gap: int) -> tuple[int, tuple[Item, ...]]:
        kind = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            del self.by_gap[gap]
            self.gaps.remove(gap)
        return kind

    def put(self, item: Item, gap: int) -> Item:
        """Fill windows of one gap with (the beginnings of) as many parts as there are windows; returns what is left of the item's parts that had none."""
        count, items = self.take(gap)
        used = min(count, item.count)
        if count > used:
            self.add(count - used, tuple(i.after(used) for i in items))
        part = min(gap, item.length)
        self.add(used, (*(i.first(used) for i in items), item.first(used)._replace(length=part)))
        return item.after(used)

    def fit(self, item: Item, may_open: bool) -> Item:
        while item.count:
            at = bisect.bisect_left(self.gaps, item.length)
            if at < len(self.gaps):
                item = self.put(item, self.gaps[at])
            elif may_open:
                self.add(item.count, (item,))
                item = item.first(0)
            else:
                break
        return item

    def pour(self, item: Item) -> None:
        """Put all parts into gaps, cutting them where no gap is long enough; there must be room."""
        todo = [item]
        while todo:
            item = self.fit(todo.pop(), may_open=False)
            if item.count:
                gap = self.gaps[-1]
                rest = self.put(item, gap)
                if rest.count:
                    todo.append(rest)
                used = item.count - rest.count
                todo.append(item.first(used)._replace(length=item.length - gap, start=item.start + gap))

    def close(self) -> None:
        """Empty the windows with the largest gaps into the gaps of the others, as long as those have room."""
        while self.gaps and self.gaps[-1]:
            gap = self.gaps[-1]
            count, items = self.take(gap)
            room = sum(g * sum(c for c, _ in kinds) for g, kinds in self.by_gap.items())
            # windows of this kind that stay take part in the room
            go = min(count, (room + gap * count) // self.size)
            if count > go:
                self.add(count - go, tuple(i.after(go) for i in items))
            if not go:
                break
            for item in items:
                self.pour(item.first(go))


def plan_windows(histogram: dict[int, int], sizes: tuple[int, ...] = SIZES) -> Plan:
    """Windows for so many pieces of each length; see the module."""
    left = {n: Item(n, c, n, 0, 0) for n, c in sorted(histogram.items()) if c}
    plan, windows = Plan(), _Windows(sizes[-1])
    for n in [n for n in left if n > sizes[-2]]:
        windows.add(left[n].count, (left.pop(n),))
    for n in sorted(left, reverse=True):
        left[n] = windows.fit(left[n], may_open=False)
    for size in reversed(sizes[:-1]):
        for n in range(size // 2, -1, -1):
            a, b = left.get(size - n), left.get(n) if n else None
            if size - n <= size // 2 and size > sizes[0] or not a or (n and not b):
                continue
            used = min(a.count, b.count) if n and b is not a else a.count // 2 if n else a.count
            if used and b is a:
                plan.kinds.append((used, size, (a.first(used), a.after(used).first(used))))
                left[n] = a.after(2 * used)
            elif used:
                plan.kinds.append((used, size, (a.first(used), *([b.first(used)] if n else []))))
                left[size - n] = a.after(used)
                if n:
                    left[n] = b.after(used)
    for n in sorted(left, reverse=True):
        windows.fit(left[n], may_open=True)
    windows.close()
    for gap in windows.gaps:
        plan.kinds += [(count, sizes[-1], items) for count, items in windows.by_gap[gap]]
    return plan


def _narrow(path: str) -> str:
    """The smallest type that holds the vocabulary's ids."""
    return "<u2" if len(bpe.encoder(path).bytes_of) <= 1 << 16 else "<u4"


def pieces(docs: DataFrame, text: str, path: str, size: int = SIZES[-1]) -> DataFrame:
    """The pieces of each text's ids and END_ID, cut every ``size``; a null text has END_ID alone.

    ``ids`` are the little-endian ids of pieces shorter than ``size``, which may be cut further.
    """
    at, kept = docs.columns.index(text), [c for c in docs.columns if c != text]
    added = T.StructType.fromDDL("start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    schema = T.StructType([*(docs.schema[c] for c in kept), *added])

    def cut(batches) -> Iterator[pa.RecordBatch]:
        code = bpe.encoder(path)
        narrow = _narrow(path)
        for batch in batches:
            texts = plain(batch.column(at))
            for a, b in slices(texts):
                ids, bounds = code.encode(texts.slice(a, b - a).to_pylist())
                rows, short = [], []
                for i in range(b - a):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], END_ID).astype("<u4")
                    for s in range(0, len(own), size):
                        part = own[s : s + size].tobytes()
                        rows.append((i, s, len(part) // 4, zlib.crc32(part), len(own)))
                        short.append(own[s:].astype(narrow).tobytes() if len(part) < 4 * size else None)
                columns = [*(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), pa.array(short, pa.binary())]
                carried = batch.slice(a, b - a).select(kept).take(columns[0])
                yield pa.RecordBatch.from_arrays([*carried.columns, *columns[1:]], schema.names)

    return docs.mapInArrow(cut, schema)


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with the gapless rank of each among rows of its length, from counts of small buckets."""
    buckets = max(1, math.ceil(rows.count() / RANKED))
    keyed = rows.withColumn("_bucket", F.pmod(F.xxhash64("ids_crc32", "start", "doc_tokens", "doc_id"), F.lit(buckets)))
    counts = keyed.groupBy("length", "_bucket").count()
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")
    return keyed.withColumn("_row", F.row_number().over(own) - 1).join(offsets, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_row")).drop("_bucket", "_row", "_before")


def _places(plan: Plan, sizes: tuple[int, ...]) -> dict[int, list[tuple[int, ...]]]:
    """For each piece length, its runs of places: ranks from and to, part's start and length, first sequence, offset, window size, and first number in the tier."""
    runs: dict[int, list[tuple[int, ...]]] = {}
    in_tier = dict.fromkeys(sizes, 0)
    sequence = 0
    for count, size, items in plan.kinds:
        offset = 0
        for i in items:
            runs.setdefault(i.piece, []).append((i.rank, i.rank + count, i.start, i.length, sequence, offset, size, in_tier[size]))
            offset += i.length
        sequence += count
        in_tier[size] += count
    return {n: sorted(x) for n, x in runs.items()}


def pack(docs: DataFrame, text: str = "text", path: str | None = None, sizes: tuple[int, ...] = SIZES, step_tokens: int = STEP_TOKENS, workspace: Workspace | None = None) -> DataFrame:
    """One row for each piece of each document: where it is cut from and where it is put.

    Adds to doc_id: start, length, ids_crc32, doc_tokens, sequence_id, offset,
    ``window`` (the sequence's size) and ``step_group`` (sequences of each tier
    are dealt over the groups in turn, so all groups have the same mix).  A
    sequence shorter than its window is padded to it; only windows of the
    largest size are.  Repeated rows are separate documents; null ids are
    allowed; an empty table has no pieces.  Other columns are left out.
    """
    workspace = workspace or Workspace(docs.sparkSession, "packing")
    cut = workspace.save(pieces(docs.select("doc_id", F.col(text).alias("text")), "text", path or bpe.default_path(), sizes[-1]), "zstd")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    plan = plan_windows(histogram, sizes)
    places = {n: np.array(x, np.int64) for n, x in _places(plan, sizes).items()}
    path = path or bpe.default_path()
    groups = max(1, plan.tokens() // step_tokens)
    ranked = _ranked(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "_rank")
    schema = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_group long".format(cut.schema["doc_id"].dataType.simpleString())

    def place(batches):
        narrow = _narrow(path)
        for batch in batches:
            length, rank, start = (batch.column(c).to_numpy() for c in ("length", "_rank", "start"))
            rows, found = [], []
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                order = own[np.argsort(rank[own], kind="stable")]
                runs = places[int(n)]
                low, high = np.searchsorted(rank[order], runs[:, 0]), np.searchsorted(rank[order], runs[:, 1])
                for run, a, b in zip(runs, low, high, strict=True):
                    rows.append(order[a:b])
                    found.append(np.tile(run, (b - a, 1)))
            rows, found = np.concatenate(rows), np.concatenate(found)
            beyond = rank[rows] - found[:, 0]
            picked = batch.take(pa.array(rows))
            crc = picked.column("ids_crc32").to_numpy().copy()
            for i in np.flatnonzero(found[:, 3] < length[rows]):
                ids = np.frombuffer(picked.column("ids")[i].as_py(), narrow)[found[i, 2] : found[i, 2] + found[i, 3]]
                crc[i] = zlib.crc32(ids.astype("<u4").tobytes())
            columns = [start[rows] + found[:, 2], found[:, 3], crc, picked.column("doc_tokens").to_numpy(), found[:, 4] + beyond, found[:, 5], found[:, 6], (found[:, 7] + beyond) % groups]
            yield pa.RecordBatch.from_arrays([picked.column("doc_id"), *(pa.array(c) for c in columns)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"])

    return ranked.mapInArrow(place, schema)
