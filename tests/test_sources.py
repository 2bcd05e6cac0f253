import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import fuzzy
from tessera.functions import text as ft
from tessera.operators import cleanup, graph, sequence
from tessera.sources import chunks, readers


def transcript(lines):
    return {"video_metadata": {"title": "A sitting", "upload_date": "20260105", "duration": "0:10:00"}, "speakers": [{"speaker_id": "s_1", "voice_id": 1, "name": "A", "position": "", "role_in_video": "member"}], "transcripts": [{"start": s, "text": t, "voice_id": 1, "speaker_id": p} for s, t, p in lines], "legislation": []}


LINES = [("00:00:05", "First.", "a"), ("00:00:10", "Second.", "a"), ("00:00:10", "Third.", "b"), ("00:01:00", "Fourth.", "b")]


def test_transcripts_to_paragraphs(spark, tmp_path):
    (tmp_path / "transcription_output_video123.json").write_text(json.dumps(transcript(LINES)))
    rows = readers.transcripts(spark, str(tmp_path))
    assert {r.video_id for r in rows.collect()} == {"video123"} and str(rows.first().video_date) == "2026-01-05"
    found = sequence.paragraphs(rows, ["video_id"], ["position"], "speaker_id", "text", "seconds").orderBy("paragraph").collect()
    assert [(r.text, r.start_seconds, r.end_seconds, r.sentences) for r in found] == [("First. Second.", 5, 10, 2), ("Third. Fourth.", 10, 60, 2)]
    assert readers.transcript_speakers(spark, str(tmp_path)).count() == 1


def test_captions(spark):
    text = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:03.500 align:start\n<c>Hello</c> there\nfriend\n\n01:02.250 --> 01:04.000\nAgain\n\nNOTE no cue\n"
    cues = readers.caption_cues(spark.createDataFrame([("v", text)], "k string, t string"), "k", "t")
    assert [(r.start, r.end, r.text) for r in cues.orderBy("start").collect()] == [(1.0, 3.5, "Hello there friend"), (62.25, 64.0, "Again")]
    assert readers.caption_text(cues, "k", 10).first().text == "Hello there friend"


def test_order_papers_tables_and_flags(spark, tmp_path):
    text = "THE SENATE\nFirst Session 2026\nNo. 12\nTuesday, the 3rd day of March, 2026\n# Bills\n1. A Bill to amend\n2) Another\nQUESTIONS\n- Why?"
    docs = spark.createDataFrame([("p", text)], "k string, t string")
    fact = readers.order_paper_facts(docs, "k", "t").first()
    assert (str(fact.sitting_date), fact.number, fact.chamber) == ("2026-03-03", 12, "senate")
    assert [(r.sequence, r.heading, r.item) for r in readers.order_paper_items(docs, "k", "t").orderBy("sequence").collect()] == [(1, "Bills", "A Bill to amend"), (2, "Bills", "Another"), (3, "QUESTIONS", "Why?")]
    page = spark.createDataFrame([("x", "<table><tr><th>T</th></tr><tr><td>3 March</td><td><a href='/a.pdf'>No. <b>1</b></a></td></tr></table>")], "k string, h string")
    row = readers.table_links(page, "k", "h").first()
    assert (row.cells, row.title, row.url) == (["3 March", "No. 1"], "No. 1", "/a.pdf")
    (tmp_path / "f.csv").write_text('video_id,speaker_id,speaker_name,voice_id,sample_timestamps\nv,s,N,1,"00:01, 00:02"\n,s,N,1,00:01\nv,s,N,1,\n')
    assert [r.samples for r in readers.flags(spark, str(tmp_path / "f.csv")).collect()] == [["00:01", "00:02"]]
    (tmp_path / "o.json").write_text(json.dumps([{"video_id": "v", "start": "00:00:01", "end": "00:00:09", "new_speaker_id": "x"}, {"video_id": "v", "start": "00:01:00", "end": "00:00:09", "new_speaker_id": "x"}, {"start": "1"}]))
    good, bad = readers.overrides(spark, str(tmp_path / "o.json"))
    assert good.count() == 1 and {r.reason for r in bad.collect()} == {"start after end", "missing field"}


def test_chunks(spark):
    text = "A sentence of words. " * 200
    found = chunks.cut(text)
    assert found[0][0] == 0 and found[-1][1] == len(text.strip()) and all(len(c) <= chunks.SIZE for _, _, c in found)
    assert all(text[a:b] == c for a, b, c in found) and all(b[0] < a[1] for a, b in zip(found, found[1:], strict=False))
    docs = spark.createDataFrame([("b1", None, text), ("b2", " ", ""), ("b3", "Short.", "x")], "id string, body string, title string")
    rows = chunks.chunked(docs, "id", ["body", "title"]).collect()
    assert {r.id for r in rows} == {"b1", "b3"} and sum(r.id == "b1" for r in rows) == len(found)


def test_text_functions(spark):
    row = spark.range(1).select(
        ft.strip_honorifics(F.lit("The Most Honourable Mia Mottley, Q.C.")).alias("a"), ft.surname(F.lit("Dr. José Pérez")).alias("b"), ft.initials(F.lit("John Smith")).alias("c"), ft.legislation_key(F.lit("Road Traffic Act 2019")).alias("d"),
        ft.role_kind(F.lit("Member for St. John")).alias("e"), ft.role_kind(F.lit("Minister of Health")).alias("f"), ft.to_seconds(F.lit("1:02:03")).alias("g"), ft.to_timestamp_text(F.lit(3723)).alias("h"),
        ft.role_labels(F.lit("a, b,, ")).alias("m"), ft.citation_parts(F.lit("bill:L_X_1:7")).alias("i"), ft.timed_url(F.lit("http://x/w?v=1"), F.lit(5)).alias("j"), ft.fenced_json(F.lit('```json\n{"a": {"b": 1}}\n```')).alias("k"), ft.citations_in(F.lit("So [v:1] and [v:2] and [v:1].")).alias("l"),
    ).first()
    assert row[:8] == ("Mia Mottley", "Pérez", "", "road traffic act", "constituency", "executive", 3723, "01:02:03")
    assert (row.i.kind, row.i.bill, row.i.chunk) == ("bill", "L_X_1", 7)
    assert row.m == ["a", "b"] and row[10:] == ("http://x/w?v=1&t=5s", '{"a": {"b": 1}}', ["v:1", "v:2"])


def test_fuzzy():
    assert fuzzy.ratio("John Smith", "Johnny Smith") == pytest.approx(200 * 10 / 22) and fuzzy.ratio("", "") == 100
    assert fuzzy.token_set_ratio("a b", "b a c") == 100 and fuzzy.ratio(None, "x") == 0


def test_clean_up(spark):
    nodes = spark.createDataFrame([("n1", "schema:Person", "John Smith", ["js"], [1.0, 0.0]), ("n2", "foaf:Person", "Johnny Smith", ["js"], [1.0, 0.0]), ("n3", "skos:Concept", "Water", [], [0.0, 1.0]), ("n4", "other:Type", "Gone", [], None)], "id string, type string, label string, aliases array<string>, embedding array<double>")
    edges = spark.createDataFrame(
        [("e1", "n1", "PROPOSES", "n3", "v", 300, 0.9, ["u1"]), ("e2", "n2", "PROPOSES", "n3", "v", 400, 0.5, ["u2"]), ("e3", "n1", "AGREE_WITH", "n3", "v", 1, 0.5, ["u3"]), ("e4", "n1", "PROPOSES", "n2", "v", 1, 0.5, []), ("e5", "n1", "PROPOSES", "n4", "v", 1, 0.5, [])],
        "id string, source_id string, predicate string, target_id string, youtube_video_id string, earliest_seconds int, confidence double, utterance_ids array<string>",
    )
    found = cleanup.clean_graph(nodes, edges, pair_least=0.6)
    kept = found["edges"].collect()
    assert len(kept) == 1 and (kept[0].support_count, kept[0].earliest_seconds, kept[0].confidence, kept[0].utterance_ids, kept[0].edge_rank_score) == (2, 300, 0.9, ["u1", "u2"], 1.0)
    assert {(r.id, r.reason) for r in found["dropped"].collect()} == {("e3", "discourse"), ("e4", "self_loop"), ("e5", "missing_endpoint")}
    assert found["violations"].count() == 0 and found["merge_map"].count() == 2
    assert sum(r.pagerank_score for r in found["nodes"].collect()) == pytest.approx(1)


def test_pagerank_cases(spark):
    ids = spark.createDataFrame([("x",)], "id string")
    none = spark.createDataFrame([], "source_id string, target_id string")
    assert graph.pagerank(none, ids).first().score == pytest.approx(1)
    assert graph.pagerank(none, ids.limit(0)).count() == 0
    cycle = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "a")], "source_id string, target_id string")
    assert [r.score for r in graph.pagerank(cycle, ids.limit(0)).collect()] == pytest.approx([1 / 3] * 3)
