import random
import re

import numpy as np
import pyarrow as pa

from tessera.llm import quality, queries
from tests.llm.tools import write_documents

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    again = {i + j for at in where.values() if len(at) > 1 for i in at for j in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)]


def texts(seed, n):
    rng = random.Random(seed)
    pick = lambda: rng.choice(["a", "Bé", "c##", "d e", "ß|", "　", "x1", "<y>", "é\n", "z\r"])
    return ["".join(pick() + rng.choice([" ", "\n", "\t", "", " \n"]) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_counts_match_brute_force(monkeypatch):
    monkeypatch.setattr("tessera.llm.textarrays.SLICE_BYTES", 300)
    rows = [*texts(5, 300), "", "\n\n", "a", "a\na\n a\na", "\na\n", None, "a b c a b c", "w " * 3000]
    counts, features = quality.statistics(pa.array(rows, pa.string()).fill_null(""))
    assert counts.tolist() == [brute(t) for t in rows]
    assert np.isfinite(features).all()


def test_falling_features_never_raise_the_score():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 2] < 0.4) ^ (rng.random(3000) < 0.1) ^ (x[:, 5] > 0.9)).astype(float)
    trees = quality.train(x, y)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.8
    for name in quality.FALLING:
        f, grid = quality.FEATURES.index(name), x[:200].copy()
        last = np.full(200, np.inf)
        for v in np.linspace(0, 1, 30):
            grid[:, f] = v
            now = trees.score(grid)
            assert (now <= last + 1e-12).all()
            last = now


def test_query(spark, tmp_path):
    rng = random.Random(2)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(120)) + "."
    bad = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) + "###" for _ in range(120))
    rows = [(i, good() if i % 3 else bad()) for i in range(240)] + [(900, None), (901, ""), (902, "few words"), (903, "again " * 500), (5, "twice")]
    folder = write_documents(spark, tmp_path, rows)
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 120)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = {(r.doc_id, r.n_words): r for r in queries.op7_quality(spark, folder).collect()}
    assert len(got) == len(rows)
    for doc, text in rows:
        n_words, chars, symbols, dup, repeat = brute(text)
        r = got[doc, n_words]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (chars, symbols, dup, repeat)
        assert r.base_failed == (n_words < 50 or 100 * repeat > 50 * n_words)
        assert r.kept == (not r.base_failed and doc % 3 > 0)


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_words string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(docs, labels) is None
    assert quality.apply_rules(docs, None).count() == 0
    one = spark.createDataFrame([(1, "w " * 10 + " ".join(map(str, range(90))), "x")], docs.schema)
    assert quality.apply_rules(one, None).first().kept
