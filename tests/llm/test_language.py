import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm import language, queries
from tests.llm.tools import write_documents

ALPHABETS = {"aa": "abcdeabcab ", "bb": "defghdefde ", "cc": "жзикжз "}


def sample(rng, lang, n):
    return "".join(rng.choice(ALPHABETS[lang]) for _ in range(n))


def grams(text):
    words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    out = Counter()
    for w in words:
        p = f"\x01{w}\x01"
        for n in (1, 2, 3):
            out.update(g for i in range(len(p) - n + 1) if (g := p[i : i + n]).strip("\x01") or g.count("\x01") < len(g))
    out.pop("\x01", None)
    return out


def ranked(counts):
    key = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(reversed(g)))
    return sorted(counts, key=lambda g: (-counts[g], key(g)))[: language.PROFILE_SIZE]


def brute(rows):
    totals = {}
    for doc, text, lang, _ in rows:
        if lang and text and zlib.crc32(str(doc).encode()) % 5:
            totals.setdefault(lang, Counter()).update(grams(text))
    profiles = {x: {g: i for i, g in enumerate(ranked(c))} for x, c in totals.items()}
    out = {}
    for doc, text, _, _ in rows:
        own = ranked(grams(text or ""))
        if not own:
            out[doc] = ("und", 0.0)
            continue
        size = language.PROFILE_SIZE
        apart = {x: sum(abs(p[g] - i) if g in p else size for i, g in enumerate(own)) for x, p in profiles.items()}
        best = min(apart, key=lambda x: (apart[x], x))
        out[doc] = (best, 1 - apart[best] / size / len(own))
    return out


def test_query_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tessera.llm.textarrays.SLICE_BYTES", 500)
    rng = random.Random(4)
    rows = [(i, sample(rng, x, rng.choice([3, 40, 900])).title(), x if i % 7 else None, "src0") for i in range(90) for x in [rng.choice(list(ALPHABETS))]]
    rows += [(200, None, "aa", "s"), (201, "", "aa", "s"), (202, "12 #!", "bb", "s"), (203, "A", None, "s"), (204, "abc " * 4000, "aa", "s")]
    got = queries.op3_language(spark, write_documents(spark, tmp_path, rows)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert (r.lang_pred, r.score) == (want[r.doc_id][0], pytest.approx(want[r.doc_id][1]))


def test_large_alphabet_counts_alike():
    symbols, _ = language._symbols(["".join(chr(0x4E00 + i * 7 % 400) + (" " if i % 5 == 0 else "") for i in range(3000))])
    codes, counts = language._counted(symbols)
    assert int(counts.sum()) == len(language._grams(symbols)) and len(codes) == len(set(codes.tolist()))


def test_nothing_learned_and_empty(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    profiles = language.learn(docs)
    assert language.identify(docs, profiles).first().lang_pred == "und"
    assert language.identify(docs.where("false").withColumn("lang_pred", docs.lang), profiles).count() == 0


def test_stage_drops_unlearned_languages_and_keeps_clean_documents(spark, tmp_path):
    rng = random.Random(9)
    syllables = {"aa": ["an", "the", "ti", "on", "re", "ing", "st"], "bb": ["sch", "ei", "ung", "der", "au", "zu", "ö"]}
    prose = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    sizes = [4, 15, 60, 300]
    clean = [(i, prose(syllables[x], sizes[i // 2 % 4]), x, "s") for i in range(160) for x in [list(syllables)[i % 2]]]
    odd = [prose(["ка", "до", "ми", "сол"], n) for n in sizes] + [prose(["水", "火", "山"], n) for n in sizes] + [prose("bcdfghjklmpqvwxyz", n * 3) for n in sizes] + [prose(["oua", "llo", "ñe", "ciá", "qu"], n) for n in sizes]
    rows = clean + [(1000 + i, t, None, "s") for i, t in enumerate(odd)] + [(2000, None, "aa", "s"), (2001, "12 #!", "aa", "s")]
    folder = write_documents(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.language_id(spark, docs, folder)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == list(range(160))


def test_limits(spark):
    docs = spark.createDataFrame([(f"abcd bcda {'abc ' * (i % 3)}", "aa") for i in range(30)], "text string, lang string")
    profiles = language.with_limits(language.learn(docs), docs)
    assert profiles.known(["abcd bcda", "abc", "", "жж", "xyz xyz", "1"]) == [True, True, False, False, False, False]
    assert language.with_limits(profiles, docs.where("false")).limits.max() == 0
    assert language.learn(docs).known(["жж", "abc"]) == [False, True]
