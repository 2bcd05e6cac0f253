import json

from tessera.operators import canonical, cleanup, sequence
from tessera.sources import writers

PAYLOAD = {"nodes_new": [{"temp_id": "n1", "type": "skos:Concept", "label": "Water  Supply", "aliases": ["water"]}], "edges": [
    {"source_ref": "speaker_1", "predicate": "PROPOSES", "target_ref": "n1", "evidence": "x", "utterance_ids": ["v:10", "v:5"], "confidence": 0.8},
    {"source_ref": "speaker_1", "predicate": "EATS", "target_ref": "n1", "evidence": "x", "utterance_ids": ["v:5"], "confidence": 0.8},
    {"source_ref": "speaker_1", "predicate": "PROPOSES", "target_ref": "n9", "evidence": "x", "utterance_ids": [], "confidence": 1.8}]}


def payloads(spark):
    rows = [("v", 0, "```json\n" + json.dumps(PAYLOAD) + "\n```"), ("v", 1, "no json")]
    return canonical.parse_payloads(spark.createDataFrame(rows, "video_id string, window_index int, answer string"), "video_id", "answer")


def test_canonicalize(spark):
    sentences = spark.createDataFrame([("v:5", 5), ("v:10", 10)], "id string, seconds_since_start int")
    found = canonical.canonicalize(payloads(spark), sentences, spark.createDataFrame([("speaker_1",)], "id string"))
    edge = found["edges"].collect()
    assert len(edge) == 1 and (edge[0].earliest_seconds, edge[0].earliest_timestamp_str, edge[0].source_id) == (5, "00:00:05", "speaker_1")
    node = found["nodes"].first()
    assert edge[0].target_id == node.id and node.id.startswith("kg_") and len(node.id) == 15
    assert {r.alias_norm for r in found["aliases"].collect()} == {"water supply", "water"}


def test_issues(spark):
    got = {(r.window_index, r.issue) for r in canonical.payload_issues(payloads(spark)).collect()}
    assert got == {(0, "predicate"), (0, "confidence"), (0, "no_utterances"), (0, "unknown_reference"), (1, "no_payload")}


def test_seeding_and_export(spark, tmp_path):
    nodes, aliases = canonical.seed_graph(spark.createDataFrame([("1", "Hon. Ann Lee")], "id string, name string"), spark.createDataFrame([("Roads",), ("",)], "title string"), spark.createDataFrame([("Water Act", "B1")], "title string, bill_number string"))
    assert nodes.count() == 3 and {r.alias_norm for r in aliases.collect()} == {"hon. ann lee", "ann lee", "roads", "water act", "b1"}
    writers.to_csv(nodes, str(tmp_path / "n"), ["id", "aliases", "missing"], single=True)
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "n"))
    assert back.columns == ["id", "aliases", "missing"] and back.where("aliases = '[\"Roads\"]'").count() == 1


def test_windows_of_short_sequences(spark):
    rows = spark.createDataFrame([("a", i) for i in range(3)] + [("b", 0)], "v string, i int")
    assert sequence.sliding_windows(rows, ["v"], ["i"], 3, 2).select("v").distinct().count() == 1
    assert sequence.sliding_windows(rows, ["v"], ["i"], 3, 2, short_ok=True).select("v").distinct().count() == 2
    assert cleanup.clean_graph is not None
