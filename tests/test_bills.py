"""Excerpts of bills, order papers with labels, overrides by name: literal cases."""

import pytest

from tessera.operators import bills, textindex
from tessera.sources import readers

BILLS = [("b1", "HR 1", "Water Act"), ("b2", None, None), ("b3", "HR 3", "Road Act")]
EXCERPTS = [
    (1, "b1", 0, "The water supply shall be metered.", "http://x/1.pdf", 2, [1.0, 0.0]), (2, "b1", 1, "Water rates.", "http://x/1.pdf#page=9", 3, [0.9, 0.1]), (3, "b2", 0, "Water pumps", None, None, [0.8, 0.3]),
    (4, "b3", 5, "Roads and bridges", "http://x/3.pdf", 0, [0.95, 0.05]), (5, "b3", 6, "water beside roads", "http://x/3.pdf", 7, None), (6, "b3", 7, "far from water", "u", 1, [-1.0, 0.2]), (7, "gone", 1, "water", "u", 1, [1.0, 0.0]),
]


@pytest.fixture(scope="module")
def tables(spark):
    known = spark.createDataFrame(BILLS, "id string, bill_number string, title string")
    return spark.createDataFrame(EXCERPTS, "id long, bill_id string, chunk_index int, text string, source_url string, page_number int, embedding array<double>"), known


def test_excerpts(spark, tables, tmp_path):
    got = bills.excerpts_for(*tables, "water", [1.0, 0.0]).orderBy("place").collect()
    assert [(r.citation_id, r.source_url, r.page_number, r.matched_terms) for r in got] == [("bill:b1:0", "http://x/1.pdf#page=2", 2, ["water"]), ("bill:b2:0", "", None, ["water"])]
    assert got[0].score == pytest.approx(0.75) and (got[1].bill_number, got[1].bill_title) == ("", "")
    more = bills.excerpts_for(*tables, "water", [1.0, 0.0], per_bill=2, seeds=spark.createDataFrame([("b2",)], "id string"), least=0.0).orderBy("place").collect()
    assert [r.citation_id for r in more] == ["bill:b1:0", "bill:b1:1", "bill:b2:0", "bill:b3:7"]
    assert more[2].score == pytest.approx(0.75 * 0.8 / (0.64 + 0.09) ** 0.5 + 0.08)
    index = textindex.build(tables[0], "id", "text", str(tmp_path / "i"))
    assert bills.excerpts_for(*tables, "water", [1.0, 0.0], index).orderBy("place").first().score == pytest.approx(0.75 + 0.25 * 0.1)
    # a query without terms asks for none
    assert bills.excerpts_for(*tables, "of it", [1.0, 0.0], most=1).count() == 1
    assert bills.excerpts_for(*tables, " ", [1.0, 0.0]).collect() == []


def test_cited(spark, tables):
    ids = spark.createDataFrame([("bill:b3:6", 3), ("bill:b1:0", 5), ("bill:b3:6", 9), ("bill:b1:x", 1), ("v:b1:0", 1), ("bill:b1:0:1", 1), ("bill:b9:0", 2)], "id string, place int")
    got = bills.excerpts_cited(ids, *tables).orderBy("place").collect()
    assert [(r.citation_id, r.score, r.source_url) for r in got] == [("bill:b3:6", 1.0, "http://x/3.pdf#page=7"), ("bill:b1:0", 1.0, "http://x/1.pdf#page=2")]


def test_search_with_bills(spark, tables):
    nodes = spark.createDataFrame([("b1", "schema:Legislation", "Water Act", ["water bill"], [1.0, 0.0]), ("n2", "skos:Concept", "Water supply", [], [0.9, 0.1])], "id string, type string, label string, aliases array<string>, embedding array<double>")
    aliases = spark.createDataFrame([("water bill", "b1")], "alias_norm string, node_id string")
    edges = spark.createDataFrame([("e1", "b1", "GOVERNS", "n2", 5, 0.9, 0.5, ["s1", "bill:b3:6", "bill:b1:0"])], "id string, source_id string, predicate string, target_id string, earliest_seconds int, confidence double, edge_rank_score double, utterance_ids array<string>")
    sentences = spark.createDataFrame([("s1", "v", 5, "On water.")], "id string, video_id string, seconds_since_start int, text string")
    found = bills.search_with_bills(nodes, aliases, edges, sentences, *tables, "water", [1.0, 0.0])
    assert [r.citation_id for r in found["bill_citations"].orderBy("place").collect()] == ["bill:b1:0", "bill:b2:0", "bill:b3:6"]
    assert found["bill_citations"].orderBy("place").first().score == pytest.approx(0.83)
    assert {r.id for r in found["nodes"].collect()} == {"b1", "n2"} and found["citations"].count() == 1
    few = bills.search_with_bills(nodes, aliases, edges, sentences, *tables, "water", [1.0, 0.0], most_bills=2)
    assert [r.place for r in few["bill_citations"].orderBy("place").collect()] == [1, 2]


PAPER = """**Session:** First Session 2022-2027
**Sitting Number:** 104th
**Date:** Tuesday, 6th January, 2026\r
**Order Paper Number:** No. 12

*   **Not a bill: before the section**
**3. Bills on the Order Paper:**
intro
*   **Water Act (Amendment) Bill, 2025**
    *   Mover: Hon. A. Smith
    *   Action: To move the second reading
    *   Status: Introduced
*   **Road Bill**\x20\x20
    Action:
    Status: Read a first time.

**4. Motions**
*   **Not a bill**
"""


def test_labelled_papers(spark):
    texts = [("p", PAPER), ("d", PAPER.replace("**Date:**", "Date:")), ("m", PAPER.replace("January", "Januar")), ("u", PAPER.replace("6th January, 2026", "soon")), ("n", PAPER.replace("No. 12", "12")), ("e", ""), ("z", None)]
    files = spark.createDataFrame(texts, "k string, t string")
    facts = {r.k: r for r in readers.labelled_papers(files, "k", "t").collect()}
    assert facts["p"][1:] == ("First Session 2022-2027", "104th", "2026-01-06", "12", None)
    assert {k: r.error for k, r in facts.items() if k in "dmune"} == {"d": "no date", "m": "unknown month", "u": "unreadable date", "n": "no number", "e": "no date"}
    items = readers.labelled_bills(files.where("k = 'p'"), "k", "t").orderBy("sequence").collect()
    assert [tuple(r)[1:] for r in items] == [(1, "BILL", "Water Act (Amendment) Bill, 2025", "Hon. A. Smith", "To move the second reading", "Introduced"), (2, "BILL", "Road Bill", None, "Status: Read a first time.", "Read a first time.")]
    assert readers.labelled_bills(files.where("k in ('e', 'z')"), "k", "t").collect() == []


def test_overrides_by_name(spark):
    entries = spark.createDataFrame([(1, " Mia Mottley "), (2, "MIA  móttley"), (3, "Nobody"), (4, None), (5, "Owen Arthur")], "n int, new_speaker_name string")
    names = spark.createDataFrame([("s_b", "Mia Mottley", "mia mottley"), ("s_a", "Mia Mottley", None), ("s_c", None, "owen arthur")], "id string, full_name string, normalized_name string")
    good, open_ = readers.overrides_to_speakers(entries, names)
    assert {r.n: r.new_speaker_id for r in good.collect()} == {1: "s_a", 2: "s_b", 5: "s_c"}
    assert sorted(r.n for r in open_.collect()) == [3, 4] and open_.columns == entries.columns
