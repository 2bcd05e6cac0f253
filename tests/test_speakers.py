"""Speakers carried from segment to segment: literal cases, batch, stream, and the registered query."""

import random

import pandas as pd
import pytest

from tessera.functions.fuzzy import ratio
from tessera.operators import speakers

SCHEMA = "video_id string, segment long, place long, voice long, name string, position string, role_in_video string"


@pytest.mark.parametrize(
    ("known", "name", "speaker", "new"),
    [
        ({}, "John Smith", "s_john_smith_1", True),
        ({"s_john_smith_1": "John Smith"}, "Jon Smith", "s_john_smith_1", False),
        ({"s_john_smith_1": "John Smith"}, "JOHN SMITH", "s_john_smith_1", False),
        ({"s_a_1": "abcde"}, "abcdx", "s_abcdx_1", True),  # exactly 80
        ({"x": "mary jones", "y": "mary jonas"}, "mary jonxs", "x", False),  # equally alike: known longer
        ({"s_jo_1": "someone else"}, "Jo", "s_jo_2", True),
        ({"s_jo_1": ""}, "Jo", "s_jo_1", True),  # a speaker without a name takes no number
        ({}, "Seán O'Neill-Smith", "s_sen_oneillsmith_1", True),
        ({}, None, "s__1", True),
        ({"s__1": ""}, "", "s__1", True),
    ],
)
def test_cases(known, name, speaker, new):
    found = speakers.Known(known)
    assert found.resolve(name) == (speaker, new)
    assert found.names[speaker] == (name or "")


def test_a_match_takes_the_new_name():
    """So a chain of small changes leads away from the first name."""
    known = speakers.Known()
    ids = [known.resolve(n)[0] for n in ("abcdefghij", "abcdefghiX", "abcdefghYX", "abcdefgZYX", "abcdefghij")]
    assert ids[:4] == ["s_abcdefghij_1"] * 4
    assert ratio("abcdefghij", "abcdefgzyx") < 80 and ids[4] == "s_abcdefghij_2"


def corpus(seed=1):
    rng = random.Random(seed)
    names = ["Mia Mottley", "Mia Motley", "M. Mottley", "Owen Arthur", "Owen S. Arthur", "Dale Marshall", "Dale Marshal", "Jo", "", None]
    rows = [(f"v{v}", s, p, p * 10, rng.choice(names), "MP", "member") for v in range(4) for s in range(6) for p in range(rng.choice([0, 1, 4]))]
    return rng.sample(rows, len(rows)) + [(None, 0, 0, 1, "Nobody", None, None)]


def expected(rows):
    known, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        names = known.setdefault(r[0], {})
        name, best, most = r[4] or "", None, 0
        for i, n in names.items():
            if n and ratio(name.lower(), n.lower()) > most:
                best, most = i, ratio(name.lower(), n.lower())
        if most <= 80:
            base = "s_" + "".join(c for c in name.lower().replace(" ", "_") if c.isascii() and (c.isalnum() or c == "_"))
            best = next(f"{base}_{i}" for i in range(1, 99) if not names.get(f"{base}_{i}"))
        names[best] = name
        out[r[:3]] = (best, most <= 80)
    return out


def found(rows):
    return {(r.video_id, r.segment, r.place): (r.speaker_id, r.is_new) for r in rows}


def test_batch(spark):
    rows = corpus()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert found(speakers.map_segments(spark.createDataFrame(rows, SCHEMA)).collect()) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert speakers.map_segments(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stream_in_pieces_equals_batch(spark, tmp_path):
    rows = [r for r in corpus(3) if r[0]]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for piece in ([0, 1], [2], [3, 4, 5]):
        spark.createDataFrame([r for r in rows if r[1] in piece], SCHEMA).write.mode("append").parquet(source)
        query = speakers.map_segment_stream(spark.readStream.schema(SCHEMA).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    assert found(spark.read.parquet(out).collect()) == expected(rows)


def test_query(spark):
    from tessera.queries import speech

    folder = "/root/testdata/sf0.001"
    part = pd.read_parquet(f"{folder}/part.parquet")
    rows = [(r.p_type, r.p_size, r.p_partkey, r.p_partkey, r.p_name, r.p_brand, "part") for r in part.itertuples()]
    got = speech.QUERIES["segment_speakers"](spark, folder).collect()
    assert len(got) == len(rows) and found(got) == expected(rows)
