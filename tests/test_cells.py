"""Vector search over cells against comparing all."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators import cells


def clustered(n, size, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, size))
    return middles[rng.integers(0, 12, n)] + rng.normal(size=(n, size)) * 0.6


def expected(keys, vectors, queries, k):
    apart = 1 - (queries @ vectors.T) / np.linalg.norm(queries, axis=1)[:, None] / np.linalg.norm(vectors, axis=1)
    return [[keys[i] for i in sorted(range(len(keys)), key=lambda i: (row[i], keys[i]))[:k]] for row in apart]


def frame(spark, keys, vectors, names="vec_id long, embedding array<double>"):
    return spark.createDataFrame([(int(k), None if v is None else [float(x) for x in v]) for k, v in zip(keys, vectors, strict=True)], names)


def got(found, key="vec_id"):
    out = {}
    for r in found.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append(r[key])
    return out


@pytest.mark.parametrize(("small", "number"), [(False, None), (True, None), (True, 1)])
def test_exact(spark, monkeypatch, small, number):
    """Also where groups of rows and queries are small, so that all are dealt out."""
    if small:
        monkeypatch.setattr(cells, "ROWS", 7)
        monkeypatch.setattr(cells, "QUERIES", 3)
    vectors = clustered(400, 6)
    vectors[100:180] = vectors[100]
    keys = np.arange(400) * 3
    rows = frame(spark, [*keys, 5000, 5001, 5002], [*vectors, None, [0.0] * 6, [1.0, 2.0]])
    asked = frame(spark, [*keys[::20], 7000, 7001], [*vectors[::20], None, [0.0] * 6], "query long, vector array<double>")
    found = cells.nearest_of_each(rows, asked, "vec_id", "embedding", 9, number)
    assert got(found) == dict(zip(keys[::20].tolist(), expected(keys.tolist(), vectors, vectors[::20], 9), strict=True))


def test_more_wanted_than_there_are(spark):
    vectors = clustered(20, 3)
    rows = frame(spark, range(20), vectors)
    asked = frame(spark, [1, 2], vectors[:2], "query long, vector array<double>")
    assert got(cells.nearest_of_each(rows, asked, "vec_id", "embedding", 50, None)) == dict(zip([1, 2], expected(list(range(20)), vectors, vectors[:2], 50), strict=True))


def test_empty(spark):
    rows, asked = frame(spark, [1], [[1.0, 2.0]]), frame(spark, [1], [[1.0, 1.0]], "query long, vector array<double>")
    assert cells.nearest_of_each(rows.where("false"), asked, "vec_id", "embedding", 3).collect() == []
    assert cells.nearest_of_each(rows, asked.where("false"), "vec_id", "embedding", 3).collect() == []


def test_recall_of_probes_and_cells_left_out(spark, tmp_path):
    table = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = np.stack(table["embedding"]).astype(float)
    keys = table["vec_id"].to_numpy()
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = cells.build(rows, "vec_id", "embedding", str(tmp_path / "index"))
    asked = rows.where("vec_id % 20 = 0").selectExpr("vec_id AS query", "embedding AS vector")
    few = np.flatnonzero(keys % 20 == 0)
    want = dict(zip(keys[few].tolist(), expected(keys.tolist(), vectors, vectors[few], 10), strict=True))
    # these vectors point almost anywhere, so most cells hold some of the nearest
    probed = got(index.nearest(asked, 10, probes=len(index.centres) * 2 // 3), "key")
    recall = np.mean([len(set(want[q]) & set(probed[q])) / 10 for q in want])
    assert recall >= 0.9, recall
    assert got(cells.CellIndex(spark, index.folder).nearest(asked, 10), "key") == want


def test_recall_of_few_probes(spark, tmp_path):
    """Vectors in groups, as of texts: a tenth of the cells is enough."""
    vectors = clustered(3000, 32, seed=3)
    index = cells.build(frame(spark, range(3000), vectors), "vec_id", "embedding", str(tmp_path / "index"))
    asked = frame(spark, range(0, 3000, 20), vectors[::20], "query long, vector array<double>")
    want = dict(zip(range(0, 3000, 20), expected(list(range(3000)), vectors, vectors[::20], 10), strict=True))
    probed = got(index.nearest(asked, 10, probes=len(index.centres) // 10 + 1), "key")
    assert np.mean([len(set(want[q]) & set(probed[q])) / 10 for q in want]) >= 0.9


def test_bounds_leave_cells_out(spark, tmp_path):
    """Well parted groups: an exact search visits its own cells only."""
    vectors = np.repeat(np.eye(8), 50, axis=0) + np.random.default_rng(2).normal(size=(400, 8)) * 0.01
    index = cells.build(frame(spark, range(400), vectors), "vec_id", "embedding", str(tmp_path / "index"), cells=40)
    asked = frame(spark, range(0, 400, 20), vectors[::20], "query long, vector array<double>").withColumnRenamed("embedding", "vector")
    from pyspark.sql import functions as F

    visits = index._visits(asked.withColumn("reach", F.lit(0.1)), "vector", "bigint", 0, 0, reach="reach")
    assert 0 < visits.count() < 20 * len(index.centres) / 3
    assert got(index.nearest(asked, 5), "key") == dict(zip(range(0, 400, 20), expected(list(range(400)), vectors, vectors[::20], 5), strict=True))
