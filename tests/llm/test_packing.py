import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, packing, queries
from tests.llm.tools import write_documents


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 1024), st.integers(1, 40), max_size=60))
def test_plan_places_every_piece_once(histogram):
    plan, used = packing.plan_windows(dict(histogram)), {}
    for count, size, items in plan.kinds:
        filled = sum(i.length for i in items)
        assert count > 0 and filled <= size and size in packing.SIZES
        assert size == packing.SIZES[-1] or filled == size
        for i in items:
            assert i.count == count
            for rank in range(i.rank, i.rank + count):
                used.setdefault((i.piece, rank), []).append((i.start, i.length))
    assert sorted(used) == [(n, r) for n in sorted(histogram) for r in range(histogram[n])]
    for (n, _), parts in used.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == n
    padding = sum(count * size for count, size, _ in plan.kinds) - plan.tokens()
    assert padding < 1024


def test_plan_pads_little():
    rng = np.random.default_rng(3)
    histogram = dict(zip(*np.unique(rng.integers(1, 1025, 20000), return_counts=True), strict=True))
    plan = packing.plan_windows({int(k): int(v) for k, v in histogram.items()})
    assert plan.tokens() / sum(count * size for count, size, _ in plan.kinds) > 0.9999


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 25)
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(bpe.default_path()), random.Random(6)
    texts = [" ".join(rng.choice(["alpha", "bet", "gamm", "x"]) for _ in range(rng.choice([1, 5, 60, 300, 700, 3000]))) for _ in range(150)]
    texts += [None, "", texts[0], texts[0], "<|endoftext|>", "a " * 20000]
    got = queries.op6_packing(spark, write_documents(spark, tmp_path, list(enumerate(texts)))).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for doc, rows in by_doc.items():
        ids = np.array([*library.encode(texts[doc] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    filled = padded = 0
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and len({(r.window, r.step_group) for r in rows}) == 1
        filled += at
        padded += at if at & (at - 1) == 0 else 1024
    assert filled / padded > 0.99


@pytest.mark.parametrize("rows", [[], [(None, None, 1)], [(1, "a", 2), (1, "a", 2)]])
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack(docs).collect()
    assert len(got) == len(rows) and len({(r.sequence_id, r.offset) for r in got}) == len(rows)
