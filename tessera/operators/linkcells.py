"""A graph's links in cells, and the product of scores with them.

Nodes have numbers, and lie in blocks and smaller chunks by these; a chunk is a row
with its nodes' numbers in order, and so is whatever is known of them.  A cell has
the links from one block to another, as places in the two blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many links lie in one cell; beyond, there are so many blocks at least, and more where cells would have more links than CELL.
ONE_CELL, BLOCKS, CELL = 2**16, 4, 2**24
#: Nodes in a chunk, links in a row of a cell, and links that are dealt to cells at once.
CHUNK, ROW, DEALT = 2**16, 2**18, 2**20


def number(node: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), node)


def numbered(nodes: DataFrame, seed: int, chunks: int) -> DataFrame:
    """(chunk, numbers, names) of different ``nodes`` (node), by number."""
    rows = nodes.select(F.struct(number(F.col("node"), seed).alias("number"), "node").alias("e")).select(F.pmod("e.number", F.lit(chunks)).cast("int").alias("chunk"), "e")
    own = rows.groupBy("chunk").agg(F.sort_array(F.collect_list("e")).alias("e"))
    return own.select("chunk", F.col("e.number").alias("numbers"), F.col("e.node").alias("names"))


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    """The values of lists, one after the other."""
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(parts) if len(parts) != 1 else parts[0]


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind.to_pandas_dtype()), *arrays]), kind))


def _parts(block: int, blocks: int, sizes: dict[int, int]) -> list[tuple[int, int, int]]:
    """(chunk, first place, end) of a block's chunks, in order."""
    out, at = [], 0
    for chunk in sorted(c for c in sizes if c % blocks == block):
        out.append((chunk, at, at + sizes[chunk]))
        at += sizes[chunk]
    return out


def _rows(found: list[tuple[int, np.ndarray]], name: str, kind: pa.DataType) -> pa.Table:
    return pa.table({"chunk": pa.array([c for c, _ in found], pa.int32()), name: _lists([x for _, x in found], kind)})


def _split(values: np.ndarray, parts: list[tuple[int, int, int]]) -> list[tuple[int, np.ndarray]]:
    return [(chunk, values[a:b]) for chunk, a, b in parts]


def cells(links: DataFrame, index: DataFrame, seed: int, blocks: int) -> DataFrame:
    """(cell, sources, targets) of ``links`` (a, b), each once; a cell's links are in several rows, sorted by target."""

    def deal(batches):
        def packed(held):
            i, j = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
            cell = (i % blocks * blocks + j % blocks).astype(np.int32)
            order = np.argsort(cell, kind="stable")
            of, first = np.unique(cell[order], return_index=True)
            each = lambda x: np.split(x[order], first[1:])
            return pa.RecordBatch.from_arrays([pa.array(of), _lists(each(i), pa.int64()), _lists(each(j), pa.int64())], ["cell", "i", "j"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= DEALT:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    def place(numbers, wanted):
        order = np.argsort(numbers)
        return order[np.searchsorted(numbers, wanted, sorter=order)]

    def build(left, right):
        if not left.num_rows:
            return pa.table({"cell": pa.array([], pa.int32()), "sources": _lists([], pa.int32()), "targets": _lists([], pa.int32())})
        cell = left["cell"][0].as_py()
        right = right.sort_by("chunk")
        one, other = (_flat(right.filter(pc.equal(right["side"], side))["numbers"]) for side in (0, 1))
        key = place(other, _flat(left["j"])) * len(one)
        key += place(one, _flat(left["i"]))
        key = np.unique(key)
        cut = [key[at : at + ROW] for at in range(0, len(key), ROW)]
        return pa.table({"cell": pa.array([cell] * len(cut), pa.int32()), "sources": _lists([(k % len(one)).astype(np.int32) for k in cut], pa.int32()), "targets": _lists([(k // len(one)).astype(np.int32) for k in cut], pa.int32())})

    dealt = links.select(number(F.col("a"), seed).alias("i"), number(F.col("b"), seed).alias("j")).mapInArrow(deal, "cell int, i array<bigint>, j array<bigint>")
    every, block = F.sequence(F.lit(0), F.lit(blocks - 1)), F.col("chunk") % blocks
    side = lambda k, cell: index.select(F.explode(F.transform(every, cell)).alias("cell"), F.lit(k).alias("side"), "chunk", "numbers")
    ends = side(0, lambda x: block * blocks + x).union(side(1, lambda x: x * blocks + block))
    return dealt.repartition(4 * blocks * blocks, "cell").groupBy("cell").cogroup(ends.groupBy("cell")).applyInArrow(build, "cell int, sources array<int>, targets array<int>")


def start(cells: DataFrame, index: DataFrame, sizes: dict[int, int], blocks: int, score: float) -> DataFrame:
    """(chunk, score, fan, loose, change): the same score for all, how many links leave each node, and the total score of those that none leaves."""

    def count(table):
        parts = _parts(table["cell"][0].as_py() // blocks, blocks, sizes)
        return _rows(_split(np.bincount(_flat(table["sources"]), minlength=parts[-1][2]).astype(np.int32), parts), "fan", pa.int32())

    def add(left, right):
        fan = np.zeros(left["n"][0].as_py(), np.int32)
        for x in right["fan"]:
            fan += x.values.to_numpy()
        return _state(left["chunk"][0].as_py(), np.full(len(fan), score), fan, 0.0)

    fans = cells.groupBy("cell").applyInArrow(count, "chunk int, fan array<int>")
    return index.select("chunk", F.size("numbers").alias("n")).groupBy("chunk").cogroup(fans.groupBy("chunk")).applyInArrow(add, STATE)


STATE = "chunk int, score array<double>, fan array<int>, loose double, change double"


def _state(chunk: int, score: np.ndarray, fan: np.ndarray, change: float) -> pa.Table:
    loose = float(score[fan == 0].sum())
    return pa.table({"chunk": pa.array([chunk], pa.int32()), "score": _lists([score], pa.float64()), "fan": _lists([fan], pa.int32()), "loose": [loose], "change": [change]})


def step(cells: DataFrame, state: DataFrame, sizes: dict[int, int], blocks: int, base: float, damping: float) -> DataFrame:
    """``state`` after a round: ``base`` and, times ``damping``, what each node gets of the scores that are shared out along links."""

    def product(left, right):
        if not left.num_rows:
            return _rows([], "got", pa.float64())
        share = _flat(right.sort_by("chunk")["share"])
        parts = _parts(left["cell"][0].as_py() % blocks, blocks, sizes)
        got = np.bincount(_flat(left["targets"]), weights=share[_flat(left["sources"])], minlength=parts[-1][2])
        return _rows(_split(got, parts), "got", pa.float64())

    def add(left, right):
        before = left["score"][0].values.to_numpy()
        got = np.zeros(len(before))
        for x in right["got"]:
            got += x.values.to_numpy()
        score = base + damping * got
        return _state(left["chunk"][0].as_py(), score, left["fan"][0].values.to_numpy(), float(np.abs(score - before).sum()))

    shares = state.select("chunk", F.zip_with("score", "fan", lambda s, f: F.when(f > 0, s / f).otherwise(0.0)).alias("share"))
    row = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: F.col("chunk") % blocks * blocks + x)
    dealt = shares.select(F.explode(row).alias("cell"), "chunk", "share")
    sums = cells.groupBy("cell").cogroup(dealt.groupBy("cell")).applyInArrow(product, "chunk int, got array<double>")
    return state.select("chunk", "score", "fan").groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(add, STATE)
