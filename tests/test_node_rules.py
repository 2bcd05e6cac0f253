"""Folding of labels, keys of nodes, and what makes a candidate pair."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as ft
from tessera.operators import graph


def folded(text):
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", bare.lower().strip())


def test_fold_agrees_with_unicode(spark):
    """Every code point below U+20000, between letters so that nothing is trimmed away."""
    points = [p for p in range(1, 0x20000) if not 0xD800 <= p < 0xE000]
    rows = spark.createDataFrame([(p, f"A{chr(p)}b", chr(p)) for p in points], "p int, t string, c string")
    got = rows.select("p", ft.fold(F.col("t")).alias("f"), F.lower("c").alias("low")).collect()
    wrong = [r for r in got if r.f != folded(f"A{chr(r.p)}b")]
    # only letters whose small form is newer than the Java runtime's or Python's tables
    assert all(r.low != chr(r.p).lower() for r in wrong), wrong[:5]
    assert len(wrong) < 100


@pytest.mark.parametrize("text", ["Škoda ŌTA  Żółć", "ﬁnancial ﬂow ℀ ½", "한국어 각", " x y ", "naïvé", "", "İstanbul", "ＡＢＣ １２"])
def test_fold_texts(spark, text):
    assert spark.range(1).select(ft.fold(F.lit(text))).first()[0] == folded(text)


@pytest.mark.parametrize(
    ("label", "surname", "initials"),
    [("Hon. Mia A. Mottley MP", "Mottley", "A"), ("Mottley, Mia", "Mottley", ""), ("the Most Honourable J.P. Morgan Esq.", "Morgan", "JP"), ("Dr. A B Smith Jr", "Smith", "AB"), ("", "", ""), ("Senator  mC O'Neal", "O'Neal", "M"), ("Plato", "Plato", "")],
)
def test_name_keys(spark, label, surname, initials):
    assert tuple(spark.range(1).select(ft.surname(F.lit(label)), ft.initials(F.lit(label))).first()) == (surname, initials)


def test_legislation_key(spark):
    assert spark.range(1).select(ft.legislation_key(F.lit(" Road  Traffic Act 1981 (Amendment) A2020 2021"))).first()[0] == "road traffic act (amendment) a2020"


def pairs(spark, nodes, **options):
    rows = [(i, t, label, None, vector, near) for i, (t, label, vector, near) in enumerate(nodes)]
    frame = spark.createDataFrame(rows, "id long, type string, label string, aliases array<string>, embedding array<double>, neighbors array<string>")
    same = lambda a, b: F.when(a == b, 100.0).otherwise(50.0)
    return {(r.node_id_1, r.node_id_2): round(r.score, 6) for r in graph.candidate_pairs(frame, same, **options).collect()}


def test_guarded_labels_need_neighbours_on_both_sides(spark):
    kind, v = "skos:Concept", [1.0, 0.0]
    nodes = [(kind, "Government", v, ["x"]), (kind, "government", v, ["y"]), (kind, "Government", v, []), (kind, "Government", v, None)]
    assert pairs(spark, nodes) == {(0, 1): 0.75}
    assert pairs(spark, nodes, shared_neighbour=True) == {}


def test_opposite_vectors_count_against(spark):
    kind = "schema:Place"
    assert pairs(spark, [(kind, "Speightstown", [1.0, 2.0], []), (kind, "Speightstown", [-1.0, -2.0], [])], least=0.1) == {(0, 1): 0.15}
    assert pairs(spark, [(kind, "Speightstown", [1.0, 2.0], []), (kind, "Speightstown", [1.0], [])], least=0.1) == {(0, 1): 0.45}


def test_blocks_by_type(spark):
    nodes = [("foaf:Person", "Hon. Owen Arthur", None, []), ("foaf:Person", "ARTHUR, Owen", None, []), ("foaf:Person", "MP", None, []), ("schema:Legislation", "Water Act 1990", None, []), ("schema:Legislation", "water act", None, []), ("skos:Concept", "water act", None, [])]
    assert set(pairs(spark, nodes, least=0.2)) == {(0, 1), (3, 4)}
