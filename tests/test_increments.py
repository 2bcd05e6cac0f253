"""Components by increments, JSON rows, and overlaps of streams."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import components, jsonrows
from tessera.streaming.overlap import overlapping_streams


def labels_of(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in parent}


def test_components_by_increments(spark, tmp_path):
    """After each batch of links the labels are those of a whole run, and only joined components' rows have changed."""
    rng, links, known, last = random.Random(1), [], spark.createDataFrame([], "node long, component long"), {}
    for number, size in enumerate([60, 5, 1, 0, 40, 3]):
        new = [(rng.randrange(150), rng.randrange(150)) for _ in range(size)]
        links += new
        changed = components.add_links(known, spark.createDataFrame([*new, (1, None)], "a long, b long"), "a", "b").collect()
        want = labels_of(links)
        touched = {r.node: r.component for r in changed}
        assert len(touched) == len(changed) and touched == {n: c for n, c in want.items() if last.get(n) != c}
        last = {**last, **touched}
        assert last == want
        path = str(tmp_path / str(number))
        spark.createDataFrame(list(want.items()), "node long, component long").write.parquet(path)
        known = spark.read.parquet(path)


def test_json_rows(spark):
    texts = ['{"s": [{"a": 1, "b": null}, {"b": "x"}, 5, null]}', '{"s": []}', '{"s": {"a": 1}}', '{"t": 1}', "no json", None, '[{"a": 2}]']
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    found = jsonrows.exploded(rows, "j", "$.s").select("id", "place", jsonrows.value_at(F.col("item"), "$.a", "int").alias("a"), jsonrows.has_key(F.col("item"), "b").alias("b"))
    assert sorted(found.collect()) == [(0, 0, 1, True), (0, 1, None, True), (0, 2, None, False), (0, 3, None, False)]
    kept = jsonrows.exploded(rows, "j", "$.s", keep=True)
    assert sorted(r.id for r in kept.where("place is null").collect()) == [1, 2, 3, 4, 5, 6]
    assert [r.id for r in jsonrows.exploded(rows, "j").collect()] == [6]


BEGIN = datetime.datetime(2026, 1, 5, 10)
CUE, SEGMENT = "video string, start timestamp, end timestamp, said string", "video string, start timestamp, end timestamp, segment long"


def at(seconds):
    return BEGIN + datetime.timedelta(seconds=seconds)


@pytest.mark.parametrize("how", ["inner", "left_outer"])
def test_overlapping_streams_equal_the_batch(spark, tmp_path, how):
    cues = [("v", 0, 4, "a"), ("v", 58, 61, "both"), ("v", 61, 63, "after"), ("v", 200, 203, "none"), ("w", 5, 6, "other video"), ("v", 119, 121, "early"), ("v", 63, 64, "buffer")]
    segments = [("v", 0, 60, 1), ("v", 120, 180, 2), ("w", 100, 160, 3)]
    # cues may come before or after their segments; a row that is far behind its stream is ignored
    pieces = [(cues[:2], []), ([cues[5]], segments[:1]), (cues[2:5], segments[1:]), ([("v", 5000, 5001, "end"), cues[6]], [("v", 5000, 5060, 9)]), ([("v", 10, 11, "too late")], []), ([("v", 9000, 9001, "end 2")], [("v", 9000, 9060, 10)]), ([("v", 9001, 9002, "end 3")], [("v", 9001, 9061, 11)])]
    left, right, out, state = (str(tmp_path / x) for x in ("cues", "segments", "out", "state"))
    make = lambda rows, schema: spark.createDataFrame([(v, at(s), at(e), x) for v, s, e, x in rows], schema)
    for own, other in pieces:
        make(own, CUE).write.mode("append").parquet(left)
        make(other, SEGMENT).write.mode("append").parquet(right)
        stream = overlapping_streams(spark.readStream.schema(CUE).parquet(left), spark.readStream.schema(SEGMENT).parquet(right), "video", 3, 10, 60, "10 minutes", how)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    batch = overlapping_streams(make(cues, CUE), make(segments, SEGMENT), "video", 3, 10, 60, "10 minutes", how)
    pairs = lambda rows: sorted((r.said, r.segment or 0) for r in rows if r.said[:3] != "end")
    got = pairs(spark.read.parquet(out).collect())
    assert got == pairs(batch.collect())
    assert ("both", 1) in got and ("early", 2) in got and ("buffer", 1) in got and (("none", 0) in got) == (how == "left_outer")
