import pytest

from tessera import registry
from tests import compare

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return compare.database(SMALL)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equal_to_sql(spark, db, name):
    assert compare.difference(spark, db, SMALL, registry.QUERIES[name], registry.SQL[name]) is None


def test_only_iterative_or_python_queries_lack_sql():
    assert set(registry.QUERIES) - set(registry.SQL) == {"fuzzy_label_sim", "chunk_text", "fulltext_stemmed", "segment_speakers"}


def test_chunks_of_all_documents(spark):
    from tessera.sources import chunks

    want = {r.doc_id: chunks.cut(r.text or r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: (r.chunks, r.char_end, r.longest) for r in registry.QUERIES["chunk_text"](spark, SMALL).collect()}
    assert got == {k: (len(c), max(e for _, e, _ in c), max(len(t) for _, _, t in c)) for k, c in want.items() if c}
