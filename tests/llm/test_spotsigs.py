import hashlib
import random
import re
from itertools import islice

import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, spotsigs
from tests.llm.tools import write_documents


def chains(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    out = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANTECEDENTS:
            after = list(islice((words[j] for j in range(i + 1, len(words)) if words[j] not in spotsigs.ANTECEDENTS), spotsigs.CHAIN))
            if len(after) == spotsigs.CHAIN:
                out.add((w, *after))
    return out or {("", *words) if words else text}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "la", "und", *[f"word{i}" for i in range(60)], "Über", "naïve", "日本"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 30, 90]))) + rng.choice(["", ".", "\n"]) for _ in range(n)]
    return texts + ["", None, "!?", "the", "the of and", texts[0], "the word1 word2 " * 3000]


@pytest.mark.parametrize("size", [4, 500])
def test_query(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(spotsigs, "RANGE", size)
    texts = corpus(60)
    rows = [(3 * i - 20, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in queries.op4_spotsigs(spark, write_documents(spark, tmp_path, random.Random(1).sample(rows, len(rows)))).collect()}
    assert len(got) == len(rows)
    for i, (doc, text) in enumerate(rows):
        text, following, r = text or "", rows[(i + 1) % len(rows)][1] or "", got[doc]
        other = edited(text, following)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        assert r.near_edited == pytest.approx(jaccard(chains(text), chains(other)))
        assert r.near_next == pytest.approx(jaccard(chains(text), chains(following)))
        assert len(r.fingerprint) == 8 * len(chains(text)) and len(r.edited_fingerprint) == 8 * len(chains(other))
    assert got[rows[0][0]].fingerprint == got[rows[-2][0]].fingerprint
    want = groups([chains(t or "") for t in texts])
    found = {}
    for (doc, _), w in zip(rows, want, strict=True):
        found.setdefault(got[doc].group, set()).add(w)
    assert all(len(x) == 1 for x in found.values()) and len(found) == len(set(want))


def groups(sets, least=0.8):
    """For each set the number of the first one that near sets connect it with."""
    label = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                if label[i] != label[j] and jaccard(a, sets[j]) >= least:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_adjacent_partitions_hold_all_near_sizes():
    for least in (0.5, 0.8, 0.9):
        bounds = spotsigs._bounds(3000, least)
        part = [sum(b <= n for b in bounds) for n in range(3001)]
        for n in range(1, 3001):
            assert part[min(3000, int(n / least + 1e-9))] - part[n] <= 1


@pytest.mark.parametrize(("often", "block"), [(16, 256), (2, 3)])
def test_groups_of_near_copies_and_a_common_passage(spark, monkeypatch, often, block):
    """Chains of near copies of one text, all sharing signatures with texts that aren't near."""
    monkeypatch.setattr(spotsigs, "OFTEN_FROM", often)
    monkeypatch.setattr(spotsigs, "BLOCK", block)
    rng = random.Random(4)
    passage = " ".join(f"the common{i} passage{i}" for i in range(8))
    base = [f"the word{i} thing{i}" for i in range(40)]
    texts = [passage + " " + " ".join(base)]
    for i in range(30):
        edited_one = rng.choice(texts).split("the ")[1:]
        edited_one[rng.randrange(8, len(edited_one))] = f"new{i} text{i} "
        texts.append("the " + "the ".join(edited_one))
    texts += [passage + " " + " ".join(f"the own{i}x{j} other{i}x{j}" for j in range(rng.randrange(1, 30))) for i in range(40)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.group for r in spotsigs.grouped(spotsigs.fingerprints(docs), docs).collect()}
    want = groups([chains(t) for t in texts])
    assert len({(w, got[i]) for i, w in enumerate(want)}) == len(set(want)) == len(set(got.values()))


def test_native(spark):
    docs = spark.createDataFrame([(1, "the a b")], "doc_id long, text string")
    assert "Python" not in spotsigs.grouped(spotsigs.fingerprints(docs), docs)._jdf.queryExecution().executedPlan().toString()


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, derived string, _range string")
    assert spotsigs.fingerprints(empty).count() == spotsigs.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(None, "the a b", "x", "y"), (None, None, "x", "y"), (1, "the a b", "x", "y"), (1, "the a b", "x", "y")], empty.schema)
    got = spotsigs.fingerprints(rows).collect()
    assert len(got) == 4 and sum(r.near_next == 1 for r in got) >= 2
    one = spotsigs.fingerprints(rows.limit(1)).first()
    assert one.near_next == 1


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(9)
    base = [t for t in corpus(25, 2) if t]
    texts = base + [" ".join(w if rng.random() > 0.02 else "changed" for w in t.split()) for t in base for _ in range(2)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    sets = {frozenset(chains(t)): t for t in texts}
    label = {s: i for i, s in enumerate(sets)}
    for _ in sets:
        for a in sets:
            for b in sets:
                if jaccard(a, b) >= 0.8:
                    label[a] = label[b] = min(label[a], label[b])
    want = {}
    for s, i in label.items():
        want.setdefault(i, set()).add(s)
    prints = {r.f: frozenset(chains(r.text)) for r in docs.select("text", spotsigs.fingerprint(spotsigs.signatures(F.col("text"))).alias("f")).collect()}
    got = {}
    for r in spotsigs.near_duplicates(docs).collect():
        got.setdefault(r.group, set()).add(prints[r.fingerprint])
    assert sorted(map(len, got.values())) == sorted(len(x) for x in want.values() if len(x) > 1)
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values() if len(x) > 1}


def test_pruning(spark):
    row = spark.range(1).select(spotsigs.pruned_jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1)), 0.6).alias("p"), spotsigs.pruned_jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1)), 0.5).alias("q")).first()
    assert (row.p, row.q) == (0.0, 0.5)


def test_sketches_of_long_sets_reject_only_what_is_apart(spark, tmp_path):
    """Sets of 300 to 1,200 signatures on both sides of LONG and of the sketches' lengths, with coefficients around 0.8."""
    rng = random.Random(6)
    drawn = lambda n: {rng.randrange(-(1 << 31), 1 << 31) for _ in range(n)}
    sets = []
    for n in (300, 384, 385, 500, 512, 513, 1024, 1030, 1200):
        base = drawn(n)
        sets += [base, *[set(sorted(base)[k:]) | drawn(k) for k in (n // 12, n // 9, n // 8, n // 2)], set(sorted(base)[n // 6 :]), base | drawn(n // 5)]
    rows = [(i, len(x), sorted(x)) for i, x in enumerate(sets)]
    table = spark.createDataFrame(rows, "set long, n int, signs array<int>")
    sketches = spotsigs._long_sketches(table).collect()
    assert {r.set for r in sketches} == {i for i, n, _ in rows if n > spotsigs.LONG}
    assert all(r.w is None or (len(r.w) * 64 >= r.n and len(r.w) * 32 < r.n) for r in sketches) and any(r.w for r in sketches)
    every = [(i, j) for i in range(len(sets)) for j in range(i)]
    pairs = spark.createDataFrame([(j, i) for i, j in every], "a long, b long")
    alike = lambda least: sorted((j, i) for i, j in every if jaccard(sets[i], sets[j]) >= least - 1e-9)
    for least in (0.8, 0.6):
        got = spotsigs._linked(pairs, table, spotsigs._long_sketches(table), least, spotsigs.Workspace(spark, "t"))
        assert sorted((r.a, r.b) for r in got.collect()) == alike(least)
    assert spotsigs._linked(pairs, table, spotsigs._long_sketches(table).withColumn("w", F.lit(None).cast("array<bigint>")), 0.8, spotsigs.Workspace(spark, "t")).count() == len(alike(0.8))
