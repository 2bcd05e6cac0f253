"""Exact percentiles against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import selection


@pytest.mark.parametrize("few", [2048, 60])
def test_against_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    rng = np.random.default_rng(1)
    groups = {
        "even": rng.normal(size=700).tolist(), "tied": rng.integers(0, 3, 500).tolist(), "same": [7.5] * 300, "one": [1.0], "two": [1.0, 2.0], None: rng.normal(size=50).tolist(),
        "wide": [*(10.0 ** rng.uniform(-300, 300, 200)).tolist(), -1.7e308, 1.7e308], "skewed": [*([0.0] * 400), 1e-9, 2e-9, *rng.exponential(size=100).tolist()],
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("even", None), ("even", float("nan")), ("even", float("inf")), ("none", None)]
    points = {"p0": 0.0, "p05": 0.05, "p50": 0.5, "p100": 1.0}
    got = {r.g: r for r in selection.percentiles(spark.createDataFrame(rows, "g string, x double").repartition(5), ["g"], F.col("x"), points).collect()}
    assert got.keys() == {*groups, "none"} and all(got["none"][p] is None for p in points)
    for g, xs in groups.items():
        for name, p in points.items():
            assert got[g][name] == pytest.approx(np.percentile(xs, p * 100), rel=1e-12), (g, name)


def test_no_groups_and_empty(spark, monkeypatch):
    monkeypatch.setattr(selection, "BROADCAST_ROWS", 0)
    rows = spark.range(10_001).select(F.col("id").cast("double").alias("x"))
    assert selection.percentiles(rows, [], F.col("x"), {"m": 0.5, "q": 0.25}).collect() == [(5000.0, 2500.0)]
    empty = spark.createDataFrame([], "g string, x double")
    assert selection.percentiles(empty, ["g"], F.col("x"), {"m": 0.5}).collect() == []


def test_few_values_with_the_rank_beside_a_step(spark, monkeypatch):
    """The quantiles on both sides of a rank may be the ends of its interval."""
    from tessera.plans.workspace import Workspace

    save, saves = Workspace.save, []

    def counted(self, df, *args, **more):
        saves.append(1)
        assert len(saves) < 40, "passes without an end"
        return save(self, df, *args, **more)

    monkeypatch.setattr(Workspace, "save", counted)
    rows = spark.range(6000).selectExpr("'a' AS g", "CASE WHEN id % 2 = 0 THEN 1.0D ELSE 3.0D END AS v")
    found = selection.percentiles(rows, ["g"], F.col("v"), {"p50": 0.5, "p95": 0.95}).collect()
    assert [(r.g, r.p50, r.p95) for r in found] == [("a", 2.0, 3.0)]
