import random
import re

from tessera.llm import queries, shingle_join
from tests.llm.tools import write_documents


def brute(rows, k, t):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    label = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if a and b and label[i] != label[j] and 100 * len(a & b) >= t * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return {(r[0], len(s), c) for r, s, c in zip(rows, sets, label)}


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for i in range(n):
        if i and rng.random() < 0.6:
            words = (rng.choice(rows)[1] or "a b c").split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words = words[: rng.randrange(1, len(words) + 1)]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 9, 30, 80, 200]))]
            if rng.random() < 0.4:
                words += passage
        text = " ".join(words)
        rows.append((i + 5, text.upper() if rng.random() < 0.1 else text))
    return rows + [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "a"), (1004, "A"), (1005, "word " * 5000)]


def test_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK", 8)
    rows = corpus(1, 220)
    got = queries.op2_shingle_join(spark, write_documents(spark, tmp_path, rows)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, 4, 85)
    assert len(got) == len(rows)


def test_joined_instead_of_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shingle_join, "BROADCAST_ROWS", 0)
    rows = corpus(3, 90)
    got = queries.op2_shingle_join(spark, write_documents(spark, tmp_path, rows)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, 4, 85)


def test_few_frequent_and_other_threshold(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "FREQUENT_FROM", 3)
    monkeypatch.setattr(shingle_join, "LIGHT_MOST", 12)
    rows = corpus(2, 160)
    found = shingle_join.shingle_components(spark.createDataFrame(rows, "doc_id long, text string"), k=5, threshold=80)
    least = {}
    for r in found.collect():
        key = bytes(r.component) if r.component else r.doc_id
        least.setdefault(key, []).append(r.doc_id)
    want = {}
    for doc, _, c in brute(rows, 5, 80):
        want.setdefault(c, []).append(doc)
    assert sorted(map(sorted, least.values())) == sorted(map(sorted, want.values()))


def test_empty_table_repeated_rows_and_clashing_columns(spark):
    schema = "doc_id long, text string, n long, component string, prefix string"
    assert shingle_join.shingle_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f", 3, "x", "y"), (1, "a b c d e f", 3, "x", "y"), (None, None, None, None, None)], schema)
    got = shingle_join.shingle_components(docs).collect()
    assert len(got) == 3 and sorted(r.n_shingles for r in got) == [0, 2, 2]
