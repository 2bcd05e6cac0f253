import math
import random
import re
from collections import Counter

import pytest

from tessera.llm import queries, threshold_search
from tests.llm.tools import write_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items, k=10):
    """Rows by scoring every document for every text."""
    bags = [(doc, Counter(terms(text))) for doc, text in docs if terms(text)]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for name, text in items:
        scores = []
        for doc, bag in bags:
            m = 25 + 75 * sum(bag.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms(text) if bag[t])
            if s > 0:
                scores.append((-s, doc is None, doc))
        out += [(name, i + 1, doc, -s) for i, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def found(frame):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in frame.collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [*"the of and".split(), *[f"w{i}" for i in range(40)], "Straße", "ÉTÉ", "naïve", "日本語", "x_y", "a-b"]
    text = lambda size: rng.choice([" ", "\n", ", "]).join(rng.choice(vocabulary[: rng.choice([5, 49])]) for _ in range(size))
    docs = [(i, text(rng.choice([1, 3, 20, 80]))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "!?- _"), (None, docs[0][1]), docs[1], docs[1], (n + 3, "the " * 5000 + "w1")]
    items = [(i, text(rng.choice([1, 6, 30]))) for i in range(12)] + [(20, None), (21, "absent words"), (22, "the the w1 w1 w1"), (23, ""), (20, "w3 W3"), (None, "w4")]
    return rng.sample(docs, len(docs)), items


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, row int, item string"), spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, score int")


@pytest.mark.parametrize(("depth", "block"), [(2, 1 << 17), (64, 40)])
def test_against_all_scores(spark, monkeypatch, depth, block):
    monkeypatch.setattr(threshold_search, "DEPTH", depth)
    monkeypatch.setattr(threshold_search, "BLOCK", block)
    monkeypatch.setattr(threshold_search, "CELLS", 500)
    monkeypatch.setattr(threshold_search, "PARTS", 40)
    docs, items = corpus(depth, 150)
    d, t = frames(spark, docs, items)
    assert found(threshold_search.search(d, t)) == expected(docs, items)


def test_joined_lookups(spark, monkeypatch):
    monkeypatch.setattr(threshold_search, "BROADCAST_ROWS", 0)
    docs, items = corpus(9, 60)
    d, t = frames(spark, docs, items[:4])
    assert found(threshold_search.search(d, t, k=3)) == expected(docs, items[:4], 3)


def test_ties_and_copies(spark):
    """A third and more of the documents are one text, so the k-th score is tied far beyond k."""
    docs = [(i, "same words here") for i in range(90)] + [(i, f"other w{i} words") for i in range(90, 140)]
    items = [(1, "same words"), (2, "words")]
    d, t = frames(spark, docs, items)
    assert found(threshold_search.search(d, t)) == expected(docs, items)


def test_stops_early(spark, monkeypatch):
    """Where some documents have all of a rare term, the lists of the others aren't read to their ends."""
    monkeypatch.setattr(threshold_search, "DEPTH", 4)
    read, whole = [], threshold_search.scored
    monkeypatch.setattr(threshold_search, "scored", lambda found, *rest: read.append(found.count()) or whole(found, *rest))
    docs = [(i, "common " * (1 + i % 3) + f"filler{i}") for i in range(3000)] + [(i, "rare rare rare common") for i in range(3000, 3012)]
    d, t = frames(spark, docs, [(1, "rare common")])
    assert found(threshold_search.search(d, t)) == expected(docs, [(1, "rare common")])
    assert sum(read) < 1500


def test_empty(spark):
    d, t = frames(spark, [(1, "a b")], [(1, "a"), (2, "b")])
    assert threshold_search.search(d.where("false"), t).collect() == []
    assert threshold_search.search(d, t.where("false")).collect() == []
    assert threshold_search.search(spark.createDataFrame([(1, None)], "doc_id long, text string"), t).collect() == []
    assert threshold_search.search(d, t).columns == ["item_id", "rank", "doc_id", "score"]


def test_query(spark, tmp_path):
    docs, items = corpus(3, 80)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert found(queries.op12_threshold_search(spark, write_documents(spark, tmp_path, docs))) == expected(docs, items)
