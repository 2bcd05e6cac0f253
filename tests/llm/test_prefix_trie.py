import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import prefix_trie, queries
from tessera.plans.workspace import Workspace

SCHEMA = "conv_id long, turn long, role string, text string, depth int, _range string, conv string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 9, "x", None) for r in rows], SCHEMA)


def expected(rows):
    """The nodes by walking the tree; rows of equal turn must be alike."""
    turns = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        turns.setdefault(conv, []).append((role or "", text or ""))
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + turns[c][h:])
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = set()
    for node, convs in members.items():
        subtree = [v for v in members if v[: len(node)] == node]
        parents = {v[:-1] for v in members if v}
        ends = ",".join(str(c) for c in sorted(c for c in convs if built[c] == node))
        saved = sum((len(members[v]) - 1) * len(v[-1][1]) for v in subtree if v)
        children = sum(len(v) == len(node) + 1 for v in subtree)
        out.add((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children, sum(v not in parents for v in subtree), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(frame):
    rows = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed, n):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(n), n * 2 // 3):
        for t in range(rng.choice([1, 1, 2, 3, 7, 12])):
            rows.append((c, t, rng.choice(["user", "user", None]), rng.choice(["a", "bb", "", None, "größe", "😀x"])))
    return rng.sample(rows, len(rows))


@pytest.mark.parametrize("seed", range(2))
def test_against_walk(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = corpus(seed, 230) + [(7, None, "user", "first"), (None, 1, "user", "nobody's"), (-5, 0, "user", "below zero"), (1000, None, None, None)]
    assert found(prefix_trie.trie(table(spark, rows))) == expected(rows)


def test_long_conversation_and_copies(spark):
    """One conversation over several ranges, and one shared by most ids."""
    rows = [(1, t, "user", f"t{t % 7}") for t in range(900)]
    rows += [(c, t, "user", "same") for c in range(100, 400) for t in range(2)]
    rows += [(1, 900, "user", "again")] * 2
    assert found(prefix_trie.trie(table(spark, rows))) == expected(rows)


def test_turnless(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 3)
    rows = [(c, 0, "user", "gone")]
    (root,) = prefix_trie.trie(table(spark, rows)).collect()
    assert (root.conv_id, root.depth, root.parent_conv_id, root.n_convs, root.n_children, root.n_leaves, root.saved_tokens) == (c, 0, None, 1, 0, 1, 0)
    assert root.ends_sha256 == hashlib.sha256(str(c).encode()).hexdigest()
    assert found(prefix_trie.trie(table(spark, rows))) == expected(rows)


def test_empty(spark):
    assert prefix_trie.trie(table(spark, [])).collect() == []
    assert prefix_trie.trie(table(spark, [(None, 0, "user", "x")])).collect() == []


def test_running_over_ranges(spark):
    rows = spark.range(200).select((F.col("id") > 20).cast("long").alias("key"), "id").repartitionByRange(7, "key", "id").withColumn("_range", F.spark_partition_id())
    rows = Workspace(spark, "test").save(rows)
    got = prefix_trie.running(rows, "key", ["id"], {"n": (F.sum, lambda a, b: a + b, F.lit(1)), "s": (F.sum, lambda a, b: a + b, F.col("id"))}).collect()
    for r in got:
        mine = [i for i in range(200) if (i > 20) == bool(r.key) and i <= r.id]
        assert (r.n, r.s) == (len(mine), sum(mine))


def test_query(spark, tmp_path):
    rows = corpus(5, 120)
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(queries.op13_prefix_trie(spark, str(tmp_path))) == expected(rows)
