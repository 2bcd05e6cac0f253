import random
import re

import corpus_pipeline
from tests.llm.test_shingle_join import brute
from tests.llm.tools import write_documents


def test_stages_keep_and_drop_what_they_should(spark, tmp_path):
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("ta", "ne", "mo", "li", "sur") for b in ("ka", "do", "ven", "tri", "sol", "mar")]
    prose = lambda n=80: " ".join(rng.choice(words) for _ in range(n)) + "."
    clean = [prose() for _ in range(30)]
    near = [" ".join(["changed", *t.split()[1:]]) for t in clean[:5]]
    bad = [" ".join(w + "###" for w in prose().split()) for _ in range(12)]
    texts = clean + near + clean[5:8] + bad + ["123 456", None, "", "too short", clean[9] + " write to jo.do@site.org or 4845168114407329"]
    rows = [(i, t, "en", "src0") for i, t in enumerate(texts)]
    folder = write_documents(spark, tmp_path, rows)
    spark.createDataFrame([(i, int(i < 38), 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")

    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns, name
        after.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    lettered = {i for i, t in enumerate(texts) if t and re.search("[a-z]", t)}
    assert set(seen["language_id"]) == lettered
    good = {i for i in lettered if i < 38 or i == len(texts) - 1}
    assert set(seen["quality_rules"]) == good
    assert set(seen["jaccard_join"]) == {c for _, _, c in brute([(i, texts[i]) for i in sorted(good)], 5, 80)}
    assert set(seen["pii"]) == set(seen["jaccard_join"])
    for i, r in seen["pii"].items():
        assert r.n_chars == len(r.text) and ("@" not in r.text or ("jo.do" not in r.text and "4845168114407329" not in r.text))
        assert "@" in texts[i] or r.text == texts[i]
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == set(seen["pii"])


def test_an_id_stays_before_none(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text), (7, text + " more")], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.jaccard_join(spark, docs, str(tmp_path)).collect()] == [7]


def test_empty_tables_and_nulls_in_every_stage(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    rows = [(None, None, None, None, None), (1, "", None, None, None), (2, text, "en", None, None), (2, text, "en", None, None)]
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, spark.createDataFrame([], schema), str(tmp_path))
        assert empty.count() == 0, name
        got = stage(spark, spark.createDataFrame(rows, schema), str(tmp_path)).collect()
        ids = sorted(str(r.doc_id) for r in got)
        assert ids == {"language_id": ["2", "2"], "quality_rules": ["2", "2"], "jaccard_join": ["1", "2", "None"], "pii": ["1", "2", "2", "None"], "packing": ["1", "2", "2", "None"]}[name]


def test_repeated_rows_and_nulls(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text + " more"), (None, None), (4, "")], "doc_id long, text string")
    got = corpus_pipeline.jaccard_join(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got) == [("1", text), ("4", ""), ("None", "")]
