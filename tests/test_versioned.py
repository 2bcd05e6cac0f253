"""Versioned tables: touched buckets, repeated and failed changes, other writers, ingestion of files."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import upsert
from tessera.streaming import ingest
from tessera.streaming.versioned import Conflict, VersionedTable


def frame(spark, rows, schema="id long, t string"):
    return spark.createDataFrame(rows, schema)


def content(table, version=None):
    return {r.id: r.t for r in table.read(version).collect()}


@pytest.fixture
def table(spark, tmp_path):
    made = VersionedTable.create(spark, str(tmp_path / "t"), "id long, t string", ["id"], buckets=8)
    made.merge(frame(spark, [(i, f"a{i}") for i in range(100)]))
    return made


def test_only_touched_buckets_are_rewritten(spark, table):
    before = table._manifest(1)["buckets"]
    assert len(before) == 8
    touched = table.merge(frame(spark, [(3, "new"), (1000, "more")]))
    after = table._manifest(2)["buckets"]
    assert 1 <= len(touched) <= 2
    assert {b for b in before if before[b] != after[b]} == {str(b) for b in touched}
    assert content(table) == {i: f"a{i}" for i in range(100)} | {3: "new", 1000: "more"}
    assert content(table, 1) == {i: f"a{i}" for i in range(100)}


def test_repeated_change_counts_once(spark, table):
    assert table.merge(frame(spark, [(1, "b")]), source="s", number=7)
    table.merge(frame(spark, [(1, "c")]), source="s", number=8)
    assert table.merge(frame(spark, [(1, "b")]), source="s", number=7) == []
    assert content(table)[1] == "c" and table.version() == 3


def test_killed_between_write_and_commit(spark, table, monkeypatch):
    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            table.merge(frame(spark, [(1, "half")]), source="s", number=1)
    again = VersionedTable(spark, table.folder)
    assert content(again)[1] == "a1" and again.version() == 1
    again.merge(frame(spark, [(1, "whole")]), source="s", number=1)
    assert content(again)[1] == "whole"
    assert again.vacuum() >= 1
    assert content(again) == {i: f"a{i}" for i in range(100)} | {1: "whole"}


def test_two_writers(spark, table):
    other = VersionedTable(spark, table.folder)

    def meanwhile(old, new):
        other.merge(frame(spark, [(5, "other")]))
        return upsert.upsert(old, new, ["id"])

    with pytest.raises(Conflict):
        table.change(frame(spark, [(6, "mine")]), meanwhile)
    assert content(table)[5] == "other" and content(table)[6] == "a6"


def test_delete_and_empty(spark, table):
    table.delete(frame(spark, [(i, None) for i in range(99)]).union(frame(spark, [(500, None)])))
    assert content(table) == {99: "a99"}
    version = table.version()
    assert table.merge(frame(spark, [])) == [] and table.version() == version
    table.delete(frame(spark, [(99, None)]))
    assert content(table) == {} and len(table.read().columns) == 2
    table.merge(frame(spark, [(99, "back")]))
    assert content(table) == {99: "back"}


def test_columns_and_rows_that_stay(spark, table):
    table.merge(frame(spark, [(1, None), (2, "x")]), columns={"t": "coalesce"}, keep_when=F.col("t") == "a2")
    assert content(table)[1] == "a1" and content(table)[2] == "a2"


def test_derived_columns_follow_changes(spark, tmp_path):
    words = lambda rows: upsert.with_search_words(rows, F.col("t"))
    made = VersionedTable.create(spark, str(tmp_path / "d"), "id long, t string", ["id"], 4, words)
    made.merge(frame(spark, [(i, f"Word{i} and x") for i in range(20)]))
    made.merge(frame(spark, [(3, "Other words"), (30, None)]))
    made.delete(frame(spark, [(5, None)]))
    got = {r.id: r.words for r in made.read().collect()}
    assert got == {r.id: r.words for r in words(made.read().drop("words")).collect()}
    assert got[3] == ["other", "words"] and got[30] == [] and 5 not in got


def transcript(lines):
    return {"video_metadata": {"title": "A sitting", "upload_date": "20260105", "duration": "0:10:00"}, "speakers": [], "transcripts": [{"start": s, "text": t, "voice_id": 1, "speaker_id": p} for s, t, p in lines], "legislation": []}


LINES = [("00:00:05", "First.", "a"), ("00:00:10", "Second.", "a"), ("00:00:10", "Third.", "b"), ("00:01:00", "Fourth.", "b")]


def test_ingestion_of_new_files_only(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "v1.json").write_text(json.dumps(transcript(LINES)))
    source, state = str(folder), str(tmp_path / "state")
    table = ingest.sentence_table(spark, str(tmp_path / "table"), buckets=16)
    ingest.ingest_new(spark, source, table, state)
    assert {r.id for r in table.read().collect()} == {"v1:5", "v1:10", "v1:10_2", "v1:60"}
    (folder / "v2.json").write_text(json.dumps(transcript(LINES[:1])))
    before = table._manifest(table.version())["buckets"]
    # the batch is written but the stream fails before it is marked as done, so it comes again
    whole = VersionedTable.merge

    def then_killed(self, *args, **kwargs):
        whole(self, *args, **kwargs)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "merge", then_killed)
        with pytest.raises(Exception, match="lost"):
            ingest.ingest_new(spark, source, table, state)
    version = table.version()
    ingest.ingest_new(spark, source, table, state)
    ingest.ingest_new(spark, source, table, state)
    after = table._manifest(table.version())["buckets"]
    assert table.version() == version and table.read().count() == 5
    assert sum(after.get(b) != before.get(b) for b in after) == 1
    assert {r.id: r.words for r in table.read().collect()}["v2:5"] == ["first"]
