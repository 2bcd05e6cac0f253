import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import hmm, queries
from tests.llm.tools import write_documents


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["<end>"]


def small_model(symbols=7, states=3, seed=1):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return hmm.Model(norm(rng.random(states), 0), norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0))


def paths(model, seq, first=True):
    """Probability of each path of states."""
    out = {}
    for path in itertools.product(range(len(model.start)), repeat=len(seq)):
        p = (model.start if first else model.between)[path[0]]
        for t, (k, s) in enumerate(zip(path, seq, strict=True)):
            p *= model.emit[s, k] * (model.step[path[t - 1], k] if t else 1)
        out[path] = p
    return out


def test_forward_is_the_sum_over_paths():
    model, rng = small_model(), np.random.default_rng(2)
    seqs = [rng.integers(0, 7, n) for n in (1, 5, 3, 6, 1)]
    got = hmm.likelihoods(model, np.concatenate(seqs), np.append(0, np.cumsum([len(s) for s in seqs])))
    assert got == pytest.approx([math.log(sum(paths(model, s).values())) for s in seqs])


def test_expected_counts_are_sums_over_paths(monkeypatch):
    monkeypatch.setattr(hmm, "ABREAST", 2)
    model, rng = small_model(), np.random.default_rng(3)
    seqs, first = [rng.integers(0, 7, n) for n in (4, 1, 5)], np.array([True, False, False])
    flat, _ = hmm.expected(model, np.concatenate(seqs), np.append(0, np.cumsum([4, 1, 5])), first)
    got, want = hmm.unpack(flat, 3), hmm.unpack(np.zeros(len(flat)), 3)
    for seq, lead in zip(seqs, first, strict=True):
        found = paths(model, seq, lead)
        whole = sum(found.values())
        for path, p in found.items():
            if lead:
                want.start[path[0]] += p / whole
            for t, (k, s) in enumerate(zip(path, seq, strict=True)):
                want.between[k] += p / whole
                want.emit[s, k] += p / whole
                if t:
                    want.step[path[t - 1], k] += p / whole
    assert np.allclose(got.pack(), want.pack())


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tessera.llm.textarrays.SLICE_BYTES", 400)
    monkeypatch.setattr(hmm, "SYMBOLS", 12)
    monkeypatch.setattr(hmm, "LOOKUP", 20)
    monkeypatch.setattr(hmm, "PASSAGE", 9)
    rng = random.Random(5)
    nouns, verbs = [f"noun{i}" for i in range(25)], [f"verb{i}" for i in range(25)]
    rows = [(i, " ".join(rng.choice((verbs, nouns)[j % 2]).title() for j in range(rng.randrange(1, 60)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "\n"), (503, "Never seen words"), (504, rows[0][1]), (505, "noun1 " * 4000)]
    got = {r.doc_id: r for r in queries.op9_hmm(spark, write_documents(spark, tmp_path, rows)).collect()}
    assert len(got) == len(rows)
    counts = Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2 for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    for doc, text in rows:
        r, tokens = got[doc], words_of(text)
        assert r.held_out == (zlib.crc32(str(doc).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
        assert math.isfinite(r.score) and r.score < 0
    held = [r for r in got.values() if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert got[504].score == pytest.approx(got[0].score)


def test_probabilities_sum_to_one(spark):
    """The next token's probabilities, known words and one unknown a class, are a distribution."""
    docs = spark.createDataFrame([(i, "a b c b a") for i in range(9)], "doc_id long, text string")
    vocabulary = hmm.count_words(docs)
    counts = hmm.gather(vocabulary, 9)
    model = hmm.first_model(counts.unigrams(), 3)
    assert model.emit.sum(0) == pytest.approx(np.ones(3)) and counts.distinct == 4 and counts.tokens == 54


def test_odd_tables(spark):
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], "doc_id long, text string, score string")
    assert hmm.score(empty, F.lit(True)).count() == 0
    nothing = hmm.score(spark.createDataFrame([(None, "some words", "x")], empty.schema), F.lit(None).cast("boolean")).first()
    assert (nothing.n_tokens, nothing.n_known, nothing.train_tokens) == (3, 0, 0) and math.isfinite(nothing.score)
