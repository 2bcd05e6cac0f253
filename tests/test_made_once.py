"""Inputs that were made, read or carried more often than a result needs."""

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import canonical, components, graph
from tessera.queries import graphs
from tessera.sources import chunks


def counting(spark, kind):
    """(accumulator, function that hands on its value and counts)."""
    asked = spark.sparkContext.accumulator(0)

    @F.udf(kind)
    def counted(value):
        asked.add(1)
        return value

    return asked, counted


def test_edges_are_verified_once(spark):
    asked, counted = counting(spark, "string")
    rows = [("a", "AMENDS", "b", "v"), ("a", "AMENDS", "b", "v"), ("a", "AMENDS", "b", None), ("a", "AMENDS", "b", None), ("a", "OTHER", "b", "v"), ("a", "OTHER", "b", "v"), ("a", "AMENDS", "x", "v"), ("a", None, "a", "v")]
    edges = spark.createDataFrame(rows, "source_id string, predicate string, target_id string, youtube_video_id string").withColumn("predicate", counted("predicate"))
    nodes = spark.createDataFrame([("a", "skos:Concept"), ("b", "skos:Concept")], "id string, type string")
    got = {r["check"]: r["violations"] for r in graph.verification(nodes, edges).collect()}
    assert got == {"predicate": 2, "missing_endpoint": 1, "self_loop": 1, "duplicate": 3}
    assert asked.value == len(rows)


def test_payloads_are_parsed_once(spark):
    asked, counted = counting(spark, "string")
    text = '{"nodes_new": [{"temp_id": "n1", "type": "skos:Concept", "label": "%s", "aliases": []}], "edges": [{"source_ref": "known", "predicate": "PROPOSES", "target_ref": "n1", "utterance_ids": ["u"], "confidence": 1.0}]}'
    answers = spark.createDataFrame([(str(i), 0, text % ("One", "one")[i % 2]) for i in range(6)], "video_id string, window_index int, answer string").withColumn("answer", counted("answer"))
    sentences = spark.createDataFrame([("u", 7)], "id string, seconds_since_start int")
    found = canonical.canonicalize(canonical.parse_payloads(answers, "video_id", "answer"), sentences, spark.createDataFrame([("known",)], "id string"))
    assert [r.label for r in found["nodes"].collect()] == ["One"]
    assert found["edges"].where("earliest_seconds = 7").count() == 6
    assert asked.value == 6


def test_links_are_made_once(spark, monkeypatch):
    asked, counted = counting(spark, "long")
    rows = [("R", 1, 10), ("R", 2, 10), ("R", 2, 10), ("C", 30, 31)]
    monkeypatch.setattr(graphs, "links", lambda spark, sf_dir: spark.createDataFrame(rows, "step string, a long, b long").withColumn("a", counted("a")))
    got = {(r.old_id, r.canonical_id, r.cluster) for r in graphs.canonical_pick(spark, "").collect()}
    assert got == {(1, 10, 1), (2, 10, 1), (10, 10, 1), (30, 30, 30), (31, 30, 30)}
    assert asked.value == len(rows)


def test_the_large_star_gets_fewer_edges(spark, monkeypatch):
    """The first large star of a dense graph comes after a small one."""
    given, large_star = [], components._large_star

    def seen(edges):
        given.append(edges.count())
        return large_star(edges)

    monkeypatch.setattr(components, "_large_star", seen)
    edges = spark.createDataFrame([(a, 100 + b) for a in range(20) for b in range(20)] + [(500, 500)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges, "a", "b").collect()}
    assert got == {n: 0 for n in [*range(20), *range(100, 120)]} | {500: 500}
    assert max(given) <= 41


def test_ranks_carry_what_they_need(spark, monkeypatch):
    given, rank_edges = [], graph.rank_edges
    monkeypatch.setattr(graphs.graph, "rank_edges", lambda edges, ranks: given.extend(edges.columns) or rank_edges(edges, ranks))
    found = graphs.edge_weight_rank(spark, "/root/testdata/sf0.001")
    assert found.columns == ["id", "edge_weight", "edge_rank_score"]
    assert set(given) == {"id", "source_id", "predicate", "target_id", "youtube_video_id", "support_count", "confidence"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window") == 0


def test_chunks_are_handed_on_in_pieces(spark, monkeypatch):
    caught = []
    docs = spark.createDataFrame([], "id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: caught.append(run))
    chunks.chunked(docs, "id", ["text"])
    texts = [None, "", *["word " * (i % 900) for i in range(2000)], "long " * 400_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])
    pieces = list(caught[0](iter([batch])))
    assert [tuple(r.values()) for p in pieces for r in p.to_pylist()] == [(i, n, *c) for i, t in enumerate(texts) for n, c in enumerate(chunks.cut(t or ""))]
    longest = max(sum(len(c[-1]) for c in chunks.cut(t or "")) for t in texts)
    assert all(sum(len(t.as_py()) for t in p.column("text")) <= chunks.HELD + longest and len(set(p.column("id").to_pylist())) <= chunks.TEXTS for p in pieces)
