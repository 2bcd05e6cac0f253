import random
import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm import queries, sharding
from tests.llm.tools import write_documents


def held_together(rows, texts):
    """Share of linked pairs in one shard."""
    by = defaultdict(list)
    for r in rows:
        by[texts[r.doc_id]].append(r.shard)
    pairs = sum(len(v) * (len(v) - 1) for k, v in by.items() if k is not None)
    return sum(c * (c - 1) for k, v in by.items() if k is not None for c in Counter(v).values()) / max(1, pairs)


def check(rows, texts, shards):
    counts = Counter(r.shard for r in rows)
    assert len(rows) == len(texts)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1 and set(counts) <= set(range(shards))
    for s, c in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(c))
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 40)
    rng = random.Random(1)
    texts = [f"text {i}" for i in range(200)] + [f"copy é {rng.randrange(40)}" for _ in range(150)] + [None, None, "", ""]
    rows = queries.op1_sharding(spark, write_documents(spark, tmp_path, list(enumerate(texts)))).collect()
    check(rows, texts, 24)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    assert held_together(rows, texts) > 0.95


def test_group_larger_than_a_shard(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 16)
    texts = ["hot"] * 170 + [f"pair {i // 2}" for i in range(100)] + [f"own {i}" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard(docs, 8).collect()
    check(rows, texts, 8)
    assert held_together([r for r in rows if r.doc_id >= 170], texts) > 0.9


def test_against_the_best_possible(spark, monkeypatch):
    """Groups that fit into shards whole can all stay whole; that is the most that any placement keeps together."""
    monkeypatch.setattr(sharding, "PLACED", 3)
    monkeypatch.setattr(sharding, "LEAST_RUN", 5)
    texts = [f"g{i // 5}" for i in range(100)] + [f"own {i}" for i in range(60)]
    rows = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 8).collect()
    check(rows, texts, 8)
    assert held_together(rows, texts) == 1


def test_few_rounds_are_told(spark):
    texts = [f"t{i % 9}" for i in range(90)]
    with pytest.warns(UserWarning, match="moves left"):
        rows = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, rounds=1).collect()
    check(rows, texts, 4)


def test_very_long_text(spark):
    texts = ["é word " * 100_000, "x"]
    check(sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2).collect(), texts, 2)


def test_all_linked_and_tight(spark):
    texts = [f"t{i % 3}" for i in range(31)]
    rows = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4).collect()
    check(rows, texts, 4)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, size string, shard string")
    assert sharding.shard(empty).count() == 0
    rows = sharding.shard(spark.createDataFrame([(None, None, "a", "b"), (1, "x", "a", "b"), (1, "x", "a", "b")], empty.schema), 2).collect()
    assert len(rows) == 3 and {(r.shard, r.slot) for r in rows} in ({(0, 0), (0, 1), (1, 0)},)
