"""Vector search over cells: k-means on all rows, rows kept by cell, searches that probe a few cells or are exact.

Vectors are taken on the unit sphere, where cosine distance is half the squared
distance.  No row of a cell is nearer to a query than the distance to the cell's
centre less the cell's radius; so once a query has ``k`` rows from its nearest
cells, a cell whose bound lies beyond the k-th of them can't hold a nearer one.

Queries and rows meet in groups of a part of a cell's rows and a part of the
queries that visit it, both dealt by hash; a group is one matrix product.  Neither
is ever on the driver; only the cells' centres are, and there are at most ``MOST``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.workspace import Workspace

#: Cells at most, rounds of k-means, rows and queries of a group.
MOST, ROUNDS, ROWS, QUERIES = 4096, 8, 4096, 1024
#: Rounding that a bound must be beyond.
SLACK = 1e-9


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _squares(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of unit vectors to centres."""
    return np.maximum(1 + (centres**2).sum(axis=1) - 2 * vectors @ centres.T, 0)


def usable(rows: DataFrame, vector: str, size: int) -> DataFrame:
    """Rows whose vector has a length, ``size`` elements, and no null or endless one."""
    v = F.col(vector)
    good = (F.size(v) == size) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.coalesce(good, F.lit(False)))


def centres(rows: DataFrame, key: str, vector: str, size: int, cells: int, workspace: Workspace) -> np.ndarray:
    """k-means of all rows, from those of the smallest hash."""
    first = rows.select(F.xxhash64(key).alias("h"), vector).orderBy("h", vector).limit(cells).toArrow()
    found = _unit(_matrix(first.column(1).combine_chunks(), size)) if len(first) else np.zeros((0, size))
    for _ in range(ROUNDS if len(found) > 1 else 0):
        sent = rows.sparkSession.sparkContext.broadcast(found)

        def sums(batches: Iterator[pa.RecordBatch]):
            known = sent.value
            total, count = np.zeros(known.shape), np.zeros(len(known), np.int64)
            for batch in batches:
                own = _unit(_matrix(batch.column(0), size))
                cell = _squares(own, known).argmin(axis=1)
                np.add.at(total, cell, own)
                count += np.bincount(cell, minlength=len(known))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.float64()))], ["cell", "n", "total"])

        def added(batches: Iterator[pa.RecordBatch]):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for cell, n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    total[cell] = total.get(cell, 0) + np.append(t.values.to_numpy(), n)
            mean = [t[:-1] / t[-1] for t in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(mean, pa.list_(pa.float64()))], ["cell", "centre"])

        parts = rows.select(vector).mapInArrow(sums, "cell long, n long, total array<double>").repartition("cell")
        moved = parts.mapInArrow(added, "cell long, centre array<double>").toArrow()
        before, found = found, found.copy()
        if len(moved):
            found[moved.column(0).to_numpy()] = _matrix(moved.column(1).combine_chunks(), size)
        if np.abs(found - before).max() < 1e-3:
            break
    return found


class CellIndex:
    """Vectors in a folder by cell; ``build`` makes one."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.cells = spark.read.parquet(f"{folder}/cells").orderBy("cell").toArrow()
        self.rows = spark.read.parquet(f"{folder}/rows")
        self.key = self.rows.schema["key"].dataType.simpleString()
        self.centres = np.array(self.cells.column("centre").to_pylist(), np.float64)

    def nearest(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query, key, distance, rank): the ``k`` nearest rows by cosine distance to each query vector (columns query, vector), ties by key.

        Exact without ``probes``; with them only that many nearest cells are
        searched.  Queries that are null, have another number of elements or no
        length find nothing.
        """
        kind = queries.schema["query"].dataType.simpleString()
        empty = f"query {kind}, key {self.key}, distance double, rank int"
        if not len(self.centres):
            return self.spark.createDataFrame([], empty)
        size = self.centres.shape[1]
        workspace = Workspace(self.spark, "cells")
        asked = workspace.save(usable(queries.select("query", "vector"), "vector", size))
        first = workspace.save(self._visits(asked, "vector", kind, probes or 1, k if probes is None else 0))
        found = workspace.save(self._met(asked, first, k, kind))
        if probes is None and len(self.centres) > 1:
            last = _best(found, k).groupBy("query").agg(F.when(F.count("*") == k, F.sqrt(2 * F.greatest(F.max("distance"), F.lit(0.0)))).alias("reach"))
            bounded = asked.join(last, "query", "left").withColumn("reach", F.coalesce("reach", F.lit(3.0)))
            more = workspace.save(self._visits(bounded, "vector", kind, 0, 0, reach="reach").join(first, ["query", "cell"], "left_anti"))
            found = found.unionByName(self._met(asked, more, k, kind))
        return _best(found, k)

    def _visits(self, queries: DataFrame, vector: str, kind: str, probes: int, least: int, reach: str | None = None) -> DataFrame:
        """(query, cell): the ``probes`` nearest cells of each query and as many more as have ``least`` rows, or all whose bound lies within ``reach``."""
        sent = self.spark.sparkContext.broadcast((self.centres, *[self.cells.column(c).to_numpy() for c in ("cell", "radius", "n")]))

        def visits(batches):
            known, name, radius, count = sent.value
            for batch in batches:
                away = np.sqrt(_squares(_unit(_matrix(batch.column(1), known.shape[1])), known))
                if reach is None:
                    order = np.argsort(away, axis=1, kind="stable")
                    before = np.cumsum(count[order], axis=1) - count[order]
                    chosen = (np.arange(len(known)) < probes) | (before < least)
                    q, place = np.nonzero(chosen)
                    cell = order[q, place]
                else:
                    q, cell = np.nonzero((away - radius <= batch.column(2).to_numpy()[:, None] + SLACK) & (count > 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(q)), pa.array(name[cell])], ["query", "cell"])

        return queries.select("query", vector, *([reach] if reach else [])).mapInArrow(visits, f"query {kind}, cell long")

    def _met(self, queries: DataFrame, visits: DataFrame, k: int, kind: str) -> DataFrame:
        """(query, key, distance): of each group of rows and queries, the ``k`` nearest rows of each query."""
        size = self.centres.shape[1]
        wanted = visits.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
        parts = self.spark.createDataFrame(pa.table({"cell": self.cells.column("cell"), "parts": pa.array(-(-self.cells.column("n").to_numpy() // ROWS)).cast(pa.int32())}))
        # as many rows as cells
        plan = F.broadcast(wanted.join(F.broadcast(parts), "cell"))
        spread = lambda c, n, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = queries.join(visits, "query").join(plan, "cell").withColumn("block", spread("query", "blocks", 1)).where("parts > 0").withColumn("part", every("parts"))
        right = self.rows.join(plan, "cell").withColumn("part", spread("key", "parts", 2)).withColumn("block", every("blocks"))

        def near(a: pa.Table, b: pa.Table) -> pa.Table:
            if not len(a) or not len(b):
                return pa.table({"query": a.column("query").slice(0, 0), "key": b.column("key").slice(0, 0), "distance": pa.array([], pa.float64())})
            b = b.take(pc.sort_indices(b.column("key")))
            wanted, own = (_matrix(t.column("vector").combine_chunks(), size) for t in (a, b))
            apart = 1 - (wanted @ own.T) / np.linalg.norm(wanted, axis=1)[:, None] / np.linalg.norm(own, axis=1)
            best = np.argsort(apart, axis=1, kind="stable")[:, :k]
            q = np.repeat(np.arange(len(a)), best.shape[1])
            return pa.table({"query": a.column("query").take(pa.array(q)), "key": b.column("key").take(pa.array(best.ravel())), "distance": pa.array(np.take_along_axis(apart, best, 1).ravel())})

        names = ["cell", "part", "block"]
        groups = left.select(*names, "query", "vector").groupBy(*names).cogroup(right.select(*names, "key", "vector").groupBy(*names))
        return groups.applyInArrow(near, f"query {kind}, key {self.key}, distance double")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def build(rows: DataFrame, key: str, vector: str, folder: str, cells: int | None = None, workspace: Workspace | None = None) -> CellIndex:
    """Index the vectors of ``rows`` (unique by ``key``) into a new folder: those of the most frequent number of elements, without nulls and with a length.

    By default there are as many cells as the root of the number of rows, ``MOST`` at most.
    """
    spark, workspace = rows.sparkSession, workspace or Workspace(rows.sparkSession, "cells")
    counted = rows.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = counted["size"] if counted else 1
    clean = workspace.save(usable(rows.select(F.col(key).alias("key"), F.col(vector).alias("vector")), "vector", size))
    n = clean.count()
    known = centres(clean, "key", "vector", size, min(MOST, cells or max(1, round(n**0.5))), workspace)
    sent = spark.sparkContext.broadcast(known)

    def placed(batches):
        for batch in batches:
            squares = _squares(_unit(_matrix(batch.column(1), size)), sent.value)
            cell = squares.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(np.sqrt(squares[np.arange(len(cell)), cell]))], ["key", "vector", "cell", "away"])

    key_type, vector_type = (clean.schema[c].dataType.simpleString() for c in ("key", "vector"))
    found = clean.mapInArrow(placed, f"key {key_type}, vector {vector_type}, cell long, away double")
    found.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(8))).write.mode("errorifexists").parquet(f"{folder}/rows")
    own = spark.read.schema(found.schema).parquet(f"{folder}/rows").groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    middle = spark.createDataFrame(pa.table({"cell": pa.array(np.arange(len(known))), "centre": pa.array(list(known), pa.list_(pa.float64()))}))
    own.join(middle, "cell").write.parquet(f"{folder}/cells")
    workspace.drop(clean)
    return CellIndex(spark, folder)


def nearest_of_each(rows: DataFrame, queries: DataFrame, key: str, embedding: str, k: int, cells: int | None = 1) -> DataFrame:
    """(query, key, distance, rank): the ``k`` rows nearest to each query vector (columns query, vector), ties by key; exact.

    For a single search all parts of the rows meet all parts of the queries, which
    saves the k-means; with more ``cells`` (None: by the number of rows) an index is
    made first, which pays off where the vectors form groups.
    """
    workspace = Workspace(rows.sparkSession, "nearest")
    return build(rows, key, embedding, f"{workspace.root}/index", cells, workspace).nearest(queries, k).withColumnRenamed("key", key)
