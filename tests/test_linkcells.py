"""Scores over links in cells, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, linkcells
from tessera.plans.workspace import Workspace
from tessera.queries import graphs


def plain(links, nodes, rounds, damping=0.85):
    out = {x: sorted({b for a, b in links if a == x}) for x in nodes}
    score = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        loose = sum(s for x, s in score.items() if not out[x])
        after = dict.fromkeys(nodes, (1 - damping + damping * loose) / len(nodes))
        for x, to in out.items():
            for b in to:
                after[b] += damping * score[x] / len(to)
        score = after
    return score


def test_several_blocks_and_equal_numbers(spark, monkeypatch):
    """Many cells, chunks and rows, a hub, parallel links and self-links; two nodes with one number get others."""
    for name, value in {"ONE_CELL": 0, "BLOCKS": 3, "CHUNK": 4, "ROW": 8, "DEALT": 16}.items():
        monkeypatch.setattr(linkcells, name, value)
    seeds, number = [], linkcells.number
    monkeypatch.setattr(linkcells, "number", lambda node, seed: (seeds.append(seed), F.when(node.isin("n1", "n2"), F.lit(-7)).otherwise(number(node, seed)) if seed == 0 else number(node, seed))[1])
    rng = random.Random(5)
    links = [(f"n{rng.randrange(30)}", f"n{rng.randrange(40)}") for _ in range(150)] + [(f"n{i}", "n3") for i in range(30)] + [("n1", "n2"), ("n2", "n1"), ("n5", "n5")]
    edges = spark.createDataFrame([*links, ("n1", None), (None, "n1")], "source_id string, target_id string")
    found = graph.pagerank(edges, spark.createDataFrame([("alone",), (None,)], "id string"), rounds=4, tolerance=0.0)
    got = {r.node: r.score for r in found.collect()}
    assert got == pytest.approx(plain(links, sorted({x for e in links for x in e} | {"alone"}), 4), abs=1e-12)
    assert set(seeds) == {0, 1}


def test_links_are_not_dealt_in_rounds(spark):
    """A round's shuffles have scores below them, never links."""
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "a")], "a string, b string")
    index = linkcells.numbered(spark.createDataFrame([("a",), ("b",), ("c",)], "node string"), 0, 1)
    with Workspace(spark, "cells").bucketed(linkcells.cells(links, index, 0, 1), "cell", 4) as cells:
        state = spark.createDataFrame([(0, [0.2, 0.3, 0.5], [1, 2, 0])], "chunk int, score array<double>, fan array<int>")
        plan = linkcells.step(cells, state, {0: 3}, 1, 0.1, 0.85)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-|*"))
    at = next(i for i, line in enumerate(plan) if "FileScan parquet" in line)
    above, upto = [], depth(plan[at])
    for line in reversed(plan[:at]):
        if depth(line) < upto:
            above.append(line)
            upto = depth(line)
    kinds = ["cogroup" if "FlatMapCoGroups" in x else "exchange" for x in above if "FlatMapCoGroups" in x or "Exchange" in x]
    assert "Bucketed: true" in plan[at] and kinds[0] == "cogroup"


def test_lines_meet_their_orders_once(spark, monkeypatch):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        asked.add(1)
        return value

    rows = [("c1", "R", "p1"), ("c1", "A", "p2"), ("c2", "R", "p2")]
    monkeypatch.setattr(graphs, "edges", lambda spark, sf_dir: spark.createDataFrame(rows, "source_id string, predicate string, target_id string").withColumn("predicate", counted("predicate")))
    got = {r.node: r.score for r in graphs.pagerank(spark, "").collect()}
    assert asked.value == len(rows)
    links = [("c1", "p1"), ("c1", "p2"), ("c2", "p2"), ("p1", "c1"), ("p2", "c2")]
    assert got == pytest.approx(plain(links, ["c1", "c2", "p1", "p2", "alone"], 20), abs=1e-9)
