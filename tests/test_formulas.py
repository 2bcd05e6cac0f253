"""The literal cases of the rules that results have to follow."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import names, score
from tessera.functions import text as ft
from tessera.functions import vocabulary as v
from tessera.operators import canonical, citing, entities, graph, matching, naming, quality_reports, retrieval, search, sequence, upsert
from tessera.sources import chunks, readers, writers


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_edge_weight(spark):
    got = one(spark, score.edge_weight(F.lit(0.8), F.lit(5), F.lit(v.PRIORS["GOVERNS"])))
    assert got == pytest.approx(0.50 * math.log1p(5) / 10 + 0.35 * 0.8 + 0.15 * v.PRIORS["GOVERNS"])
    assert one(spark, score.edge_rank(F.lit(0.5), F.lit(0.1), F.lit(0.2), F.lit(5))) == pytest.approx(0.5 * 0.15 * math.log1p(5))
    assert one(spark, score.rerank_blend(F.lit(1.0), F.lit(None).cast("double"), F.lit(0.0), F.lit(0.2))) == pytest.approx(0.55 + 0.10 + 0.02)


def test_unknown_predicates_have_the_usual_prior(spark):
    edges = spark.createDataFrame([("e", "a", "NEW", "b", 1, 0.5)], "id string, source_id string, predicate string, target_id string, support_count int, confidence double")
    got = graph.rank_edges(edges, spark.createDataFrame([("a", 0.5), ("b", 0.5)], "node string, score double")).first()
    assert got.edge_weight == pytest.approx(0.5 * math.log1p(1) / 10 + 0.175 + 0.015) and got.edge_rank_score == 1


@pytest.mark.parametrize(
    ("raw", "before", "duration", "seconds", "reason"),
    [
        ("0:3:19", None, None, 199, "hms"), ("46:18:000", None, None, 2778, "mmss_millis"), ("49:08:00", None, None, 2948, "mmss_hours"), ("0:87:47", None, None, 5267, "mmss_zero_hours"),
        ("0:50:06", 2, None, 3006, "hms"), ("12:30", 9000, None, 750, "mmss"), ("0:00:05", 10, None, 5, "hms_non_monotonic"), ("1:10:00", 3000, None, 4200, "hms"),
        ("49:08:00", 2000, 9416, 2948, "mmss_hours"), ("30:00:00", 3000, None, 108000, "hms"), ("5:61:61", None, None, None, "invalid"), ("99:00:00", None, 60, None, "invalid"), ("x", 1, None, None, "invalid"), (None, 1, None, None, "invalid"),
    ],
)
def test_timestamps(spark, raw, before, duration, seconds, reason):
    rows = [("v", 1, raw, duration)] if before is None else [("v", 0, f"{before // 60}:{before % 60}", None), ("v", 1, raw, duration)]
    got = sequence.repair_timestamps(spark.createDataFrame(rows, "v string, i int, raw string, d long"), ["v"], "i", "raw", "d").where("i = 1").first()
    assert (got.seconds, got.reason) == (seconds, reason)


def fold(readings):
    """What a plain loop over one sequence gives."""
    last, out = None, []
    for found in readings:
        if not found:
            out.append((None, "invalid"))
            continue
        if last is None:
            best = next((c for c in found if c[1] in ("mmss_millis", "mmss_hours")), found[0])
        elif found[0][1] == "mmss":
            best = found[0]
        else:
            later = sorted((c for c in found if c[0] >= last), key=lambda c: c[0])
            best = later[0] if later else (max(found)[0], next(c for c in found if c[0] == max(found)[0])[1] + "_non_monotonic")
        last = best[0]
        out.append(best)
    return out


def test_repair_of_whole_sequences_against_a_loop(spark):
    import random

    rng = random.Random(2)
    rows = [(f"v{k}", i, rng.choice([f"{rng.randrange(40)}:{rng.randrange(60)}:000", f"0:{rng.randrange(99)}:{rng.randrange(60)}", f"{rng.randrange(60)}:{rng.randrange(60)}", f"{rng.randrange(60)}:{rng.randrange(60)}:{rng.randrange(60):02d}", "bad"])) for k in range(8) for i in range(40)]
    docs = spark.createDataFrame(rows, "v string, i int, raw string")
    read = {(r.v, r.i): [(x.seconds, x.reason) for x in r.r] for r in docs.select("v", "i", ft.timestamp_readings(F.col("raw")).alias("r")).collect()}
    got = {(r.v, r.i): (r.seconds, r.reason) for r in sequence.repair_timestamps(docs, ["v"], "i", "raw").collect()}
    for k in range(8):
        assert [got[f"v{k}", i] for i in range(40)] == fold([read[f"v{k}", i] for i in range(40)])


def test_durations(spark):
    assert one(spark, ft.duration_seconds(F.lit("2:36:56")), ft.duration_seconds(F.lit("36:12")), ft.duration_seconds(F.lit("x"))) == (9416, 2172, None)


def decide(spark, title, uploaded, sitting, session="House of Assembly Session"):
    videos = spark.createDataFrame([("v", title, uploaded)], "video string, title string, uploaded date")
    papers = spark.createDataFrame([("op_h_20260113_one", sitting, session)], "paper string, sitting date, session string")
    return matching.decisions(videos, matching.match_papers(videos, papers)).first()


def test_order_paper_matching(spark):
    day, title = datetime.date(2026, 1, 13), "The Honourable The House - Tuesday 13th January, 2026 - Part 1"
    got = decide(spark, title, day, day)
    assert (got.paper, got.points, got.confidence, got.status) == ("op_h_20260113_one", 100, "high", "auto_matched")
    assert decide(spark, title, None, day).confidence == "high"
    far = decide(spark, "Committee Feed", datetime.date(2026, 1, 25), datetime.date(2026, 1, 10))
    assert (far.points, far.confidence, far.status, far.candidates) == (0, "low", "needs_review", [])
    assert decide(spark, "Committee Feed", None, day).points == 0
    assert decide(spark, "Senate", day, day, "Senate Session").confidence == "medium"


def test_candidates_against_brute_force(spark):
    import random

    rng, first = random.Random(3), datetime.date(2026, 1, 1)
    videos = [(i, rng.choice(["The House", "Senate - Monday 5th January, 2026", "Feed"]), rng.choice([None, first + datetime.timedelta(rng.randrange(30))])) for i in range(40)]
    papers = [(i, first + datetime.timedelta(rng.randrange(30)), rng.choice(["House", "Senate", None])) for i in range(60)]
    got = {}
    for r in matching.match_papers(spark.createDataFrame(videos, "video int, title string, uploaded date"), spark.createDataFrame(papers, "paper int, sitting date, session string"), candidates=4, most=3).collect():
        got.setdefault(r.video, {})[r["rank"]] = (r.paper, r.points)
    near = lambda d, steps: next((p for n, p in steps if d is not None and d <= n), 0)
    for video, title, uploaded in videos:
        said = datetime.date(2026, 1, 5) if "Monday" in title else None
        base = uploaded or said
        few = sorted((abs((base - s).days) if base else 0, p, s, x) for p, s, x in papers if not base or abs((base - s).days) <= 7)[:4] if base else [(None, p, s, x) for p, s, x in sorted(papers)[:4]]
        marks = []
        for d, p, s, x in few:
            room = any(w in title.lower() and w in (x or "").lower() for w in ("house", "senate"))
            points = near(d, [(0, 55), (1, 35), (3, 20), (7, 8)]) + near(abs((said - s).days) if said else None, [(0, 35), (1, 20), (3, 8)]) + 10 * room
            marks.append((-min(points, 100), -1 if d is None else d, p))
        assert [got.get(video, {})[i + 1] for i in range(len(marks[:3]))] == [(p, -m) for m, _, p in sorted(marks)[:3]]


def test_boosts(spark):
    rows = spark.createDataFrame([("Water supply", ["bus"], 0.1), ("Waterway", [], 0.1), ("Something", None, 0.1)], "label string, aliases array<string>, fused double")
    got = lambda q: [r.score for r in retrieval.boosted(rows, "label", "aliases", ft.query_intent(F.lit(q))).collect()]
    assert got("latest water and bus policy") == pytest.approx([0.1 + 0.2 + 0.05 + 0.03, 0.1 + 0.05 + 0.03 - 0.05, 0.1 + 0.03 - 0.05])
    assert got("hello there") == pytest.approx([0.1] * 3)


def test_terms_and_keywords(spark):
    assert one(spark, ft.query_terms(F.lit("What about the Water-supply, water- and an x2 but BWA over naïve?"), v.QUERY_STOPWORDS)) == ["water-supply", "water", "but", "bwa"]
    text = "The Ministry of Health met Dr. Ann Lee on 3 March 2026 in Kingston about the Road Traffic Act. This Bill and NIC."
    found = entities.entities_in(text)
    assert {(k, t) for k, t, _, _ in found} >= {("organizations", "Ministry of Health"), ("organizations", "NIC"), ("persons", "Dr. Ann Lee"), ("dates", "3 March 2026"), ("locations", "Kingston"), ("related_bills", "the Road Traffic Act")}
    assert all(text[a:b].strip() == t for _, t, a, b in found) and ("related_bills", "This Bill") not in {x[:2] for x in found}
    assert ("topics", "Income tax Act") in {x[:2] for x in entities.entities_in("Income tax Act")}
    rows = entities.keywords(entities.with_entities(spark.createDataFrame([("The Road Act", text), (None, None)], "title string, text string"), "text"), "title").collect()
    assert rows[0].keywords[:4] == ["road", "act", "traffic", "ministry"] and rows[1].keywords == []


def test_names(spark):
    lit = F.lit
    got = one(spark, names.shown(lit(None), lit("s_john_o'neil_2"), lit("x")), names.shown(lit(None), lit("hon mary-ann lee"), lit("x")), names.shown(lit(" A B "), lit("c"), lit("x")), names.shown(lit(None), lit(None).cast("string"), lit("s_1")))
    assert got == ("John O'neil", "The Honourable Mary-ann Lee", "A B", "s_1")
    got = one(spark, names.with_title(lit("Mrs"), lit("ann o'NEIL-smith")), names.with_title(lit("Most Hon."), lit("J. B. lee")), names.with_title(lit("bishop"), lit("MP lee")), names.with_title(None or lit(""), lit("x y")))
    assert got == ("Mrs. Ann O'Neil-Smith", "The Most Honourable J. B. Lee", "Bishop MP Lee", "X Y")
    known = F.array(lit("s_1"), lit("2"))
    assert one(spark, names.reference(lit("s_1"), known), names.reference(lit("speaker_2"), known), names.reference(lit("s_9"), known), names.reference(lit("kg_1"), known)) == ("speaker_s_1", "speaker_2", None, "kg_1")


def test_resolution(spark):
    known = spark.createDataFrame([(1, "Hon. Ann Lee"), (2, "Bob Lee"), (3, "Brenda Stone"), (4, "Carl Stonebridge")], "id int, name string")
    asked = ["hon. ann  lee", "Mr. B. Lee", "Lee", "B Stone", "Stonebridge Carll", "Nobody", "", None, "J. Lee"]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "i int, said string")
    got = {r.i: (r.resolved, r.tier) for r in naming.resolve(rows, known, "said").collect()}
    assert [got[i] for i in range(9)] == [(1, 0), (2, 1), (None, None), (3, 1), (4, 2), (None, None), (None, None), (None, None), (None, None)]


def test_nearest_names_against_all_pairs(spark):
    import random

    from tessera.functions import fuzzy

    rng = random.Random(1)
    known = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(60)})
    asked = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(80)})
    for least in (80.0, 88.0):
        found = naming.nearest_names(spark.createDataFrame([(a,) for a in asked], "n string"), spark.createDataFrame(list(enumerate(known)), "id int, name string"), "n", "id", "name", least).collect()
        want = {a: max((fuzzy.ratio(a, k), -i) for i, k in enumerate(known)) for a in asked}
        assert {(r.name, -r.id) for r in found} == {(a, i) for a, (s, i) in want.items() if s >= least}


def test_citations(spark):
    cited = spark.createDataFrame([(1, "a [x](#src:utt_V:9) b (source:12), #src:V:9. #src:bill:B:1 #src:bill:C:1 #src:5")], "k int, answer string").withColumn("ids", ft.cited_ids(F.col("answer")))
    known = spark.createDataFrame([(1, "utt_V:9"), (1, "utt_V:12"), (1, "bill:B:1"), (1, "V:5"), (1, "W:5")], "k int, id string")
    assert [(r.position, r.id) for r in citing.resolve_citations(cited, known, "k").orderBy("position").collect()] == [(0, "utt_V:9"), (1, "utt_V:12"), (2, "bill:B:1")]
    assert one(spark, ft.citation_id(F.lit("https://x.y/z#src:V:1).")), ft.page_url(F.lit("a.pdf"), F.lit(3)), ft.page_url(F.lit("a.pdf#page=2"), F.lit(3)), ft.page_url(F.lit("a"), F.lit(0))) == ("V:1", "a.pdf#page=3", "a.pdf#page=2", "a")


def test_evidence_and_ids(spark):
    content = "well then we must act now, friends, and more text follows here in the same long utterance, as it does"
    got = one(spark, ft.anchored_evidence(F.lit("he said we must act again"), F.lit(content)), ft.anchored_evidence(F.lit("must act"), F.lit(content)), ft.anchored_evidence(F.lit("nothing alike"), F.lit(content)), ft.utterance_ids(F.array(F.lit("18"), F.lit(" v:2 ")), F.lit("v")))
    assert got == (content[10 : 10 + 65].rstrip(), "must act", content[:60].rstrip(), ["v:18", "v:2"])
    assert one(spark, ft.url_seconds(F.lit("u?t=90s")), ft.url_seconds(F.lit("u?a=1&t=1h2m")), ft.source_seconds(F.lit(None), F.lit("u"), F.lit("01:05"))) == (90, 3720, 65)


def test_timeline_and_bands(spark):
    videos = spark.createDataFrame([("a", 125), ("b", 60), ("c", 0), ("d", None)], "v string, d int")
    got = [(r.v, r.segment, r.start, r.end) for r in sequence.timeline(videos, "v", F.col("d"), 60, 10).orderBy("v", "segment").collect()]
    assert got == [("a", 0, 0, 60), ("a", 1, 50, 110), ("a", 2, 100, 125), ("b", 0, 0, 60)]
    rows = spark.createDataFrame([(0, 5, 100), (0, 9, 100), (1, 99, 100), (1, 130, 100)], "s int, t int, start int")
    moved = sequence.shift_segments(rows, ["s"], "t", "start")
    assert sorted(r.t for r in moved.collect()) == [99, 105, 109, 130]
    assert sorted(r.t for r in sequence.outside_band(moved, "t", F.lit(100), F.lit(110)).collect()) == [130]


def test_running_number(spark):
    rows = spark.createDataFrame([(i * 7 % 100,) for i in range(100)], "x int")
    got = sequence.running_number(rows, ["x"], "n", each=9).collect()
    assert sorted((r.x, r.n) for r in got) == [(i, i + 1) for i in range(100)]


def test_candidate_pairs_fold_aliases_and_deal_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 2)
    rows = [(f"n{i}", "foaf:Person", f"Jo{'h' * (i % 2)}n Smith", ["José "] if i % 2 else ["jose"], [1.0, 0.0], []) for i in range(7)]
    nodes = spark.createDataFrame(rows, "id string, type string, label string, aliases array<string>, embedding array<double>, neighbors array<string>")
    same = lambda a, b: F.when(a == b, 100.0).otherwise(90.0)
    got = {(r.node_id_1, r.node_id_2): r.score for r in graph.candidate_pairs(nodes, same, 0.8).collect()}
    assert len(got) == 21 and got["n0", "n2"] == pytest.approx(0.85) and got["n0", "n1"] == pytest.approx(0.45 * 0.9 + 0.4)
    guarded = nodes.withColumn("label", F.lit("Government")).withColumn("type", F.lit("skos:Concept"))
    assert graph.candidate_pairs(guarded, same, 0.1).count() == 0


def test_delta_merge(spark):
    node = "temp_id string, type string, label string, aliases array<string>"
    edge = "source_ref string, predicate string, target_ref string, evidence string, utterance_ids array<string>, confidence double"
    base = spark.createDataFrame([(1, ([("n1", "t", "A", [])], [("n1", "P", "x", "", [], 1.0), ("n1", "Q", "x", "", [], 1.0)]))], f"w int, payload struct<nodes_new:array<struct<{node.replace(' ', ':').replace(',:', ',')}>>,edges:array<struct<{edge.replace(' ', ':').replace(',:', ',')}>>>")
    delta = spark.createDataFrame([(1, ([("n1", "t", "B", []), ("a1", "t", "C", [])], [("n1", "P", "a1", "", [], 1.0)], [("n1", "Q", "x")]))], f"w int, payload struct<nodes_new_add:array<struct<{node.replace(' ', ':').replace(',:', ',')}>>,edges_add:array<struct<{edge.replace(' ', ':').replace(',:', ',')}>>,edges_delete:array<struct<source_ref:string,predicate:string,target_ref:string>>>")
    nodes, edges = canonical.merge_delta(base, delta, ["w"])
    assert {(r.label, r.temp_id) for r in nodes.collect()} == {("A", "n1"), ("B", "a2"), ("C", "a1")}
    assert {(r.source_ref, r.predicate, r.target_ref) for r in edges.collect()} == {("n1", "P", "x"), ("a2", "P", "a1")}


def test_changes(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "b")], "k int, x string")
    assert {(r.k, r.x) for r in upsert.backfill(rows, spark.createDataFrame([(1, "a"), (2, "c")], "k int, x string"), ["k"], ["x"]).collect()} == {(1, "a"), (2, "b")}
    empty, n = upsert.delete_all(rows)
    assert (empty.count(), n) == (0, 2) and upsert.snapshot(rows, str(tmp_path / "s")).count() == 2
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        upsert.snapshot(rows, str(tmp_path / "s"))


def test_checks_and_exports(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"results": [{"video_id": "v", "timestamp": "1:00", "speaker_id": "s", "result": {"name": "N", "match_requested": false, "confidence": 0.9}}, {"video_id": "v", "result": null}, {"video_id": "w", "result": {"name": "N", "match_requested": null, "confidence": 0.9}}]}')
    found = quality_reports.overrides_from(readers.verifications(spark, str(tmp_path / "c.json")), 0.5).collect()
    assert [(r.video_id, r.old_speaker_id, r.new_speaker_name) for r in found] == [("v", "s", "N")]
    pairs = spark.createDataFrame([("a b c", "<i>A</i> b, c"), ("a", " "), ("", "a"), ("x y", "p q")], "t string, c string")
    assert [r.status for r in quality_reports.caption_check(pairs, "t", "c", 80).collect()] == ["ok", "no_captions", "empty_transcript", "mismatch"]
    nodes = spark.createDataFrame([("a", "t", "A"), ("b", "t", "B"), ("c", "t", "C")], "id string, type string, label string")
    edges = spark.createDataFrame([("e", "a", "P", "b", "v", 1, "r"), ("f", "a", "P", "c", "w", 1, "r")], "id string, source_id string, predicate string, target_id string, youtube_video_id string, earliest_seconds int, run_id string")
    assert '"B"' in (shown := writers.graph_json(nodes, edges, video="v").first().graph) and '"C"' not in shown
    assert '"C"' in writers.graph_json(nodes, edges, run="r").first().graph
    writers.report({"Nodes": nodes}, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r"), wholetext=True).first().value.startswith("## Nodes\n\n| id | type | label |")
    assert one(spark, readers.chamber_of(F.lit(None).cast("string"), F.lit("Senate"), F.lit("The House")), readers.chamber_of(F.lit(None).cast("string"), F.lit(""), F.lit("A Senate day")), readers.chamber_of(F.lit("house"), F.lit("senate"), F.lit(""))) == ("senate", "senate", "house")


def test_search_helpers(spark):
    assert search.with_recency("water", "the latest news", 2026) == "water 2026" and search.with_recency("water 2019", "latest", 2026) == "water 2019" and search.with_recency("water", "old", 2026) == "water"
    people = spark.createDataFrame([(1, "Ann Lee"), (2, "Bob Ray"), (3, None)], "id int, full_name string")
    assert [r.id for r in search.named_in(people, "what did Ann  Lee say to bob", "water").collect()] == [1]
    assert search.named_in(people, "what did ann lee say", "ann lee water").count() == 0


def test_no_text_is_lost_between_chunks():
    text = "word " * 300 + "tail"
    for size, overlap, least in ((100, 0, 90), (50, 10, 40), (900, 150, 100)):
        found = chunks.cut(text, size, overlap, least)
        seen = [False] * len(text)
        for a, b, _ in found:
            seen[a:b] = [True] * (b - a)
        assert all(s or c == " " for s, c in zip(seen, text, strict=True))
