from pyspark.sql import functions as F

from tessera.functions import answers
from tessera.functions import text as ft
from tessera.operators import retrieval, threads, upsert


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_headings_need_an_empty_line_before_and_a_full_one_after(spark):
    got = one(spark, *[answers.with_headings(F.lit(t)) for t in ("Water Supply\nmore", "Water Supply\n\nmore", "so\nWater Supply\nmore", "Water supply is low\nmore", "Water\nmore", "The End: \nmore", "so\n\nThe End of It\nmore")])
    assert got == ("### Water Supply\nmore", "Water Supply\n\nmore", "so\nWater Supply\nmore", "Water supply is low\nmore", "Water\nmore", "The End: \nmore", "so\n\n### The End of It\nmore")


def test_answers_are_cleaned(spark):
    got = lambda t: tuple(one(spark, answers.cleaned(F.lit(t)))[0])
    assert got("Wuh-loss! It is so.\n\nFollow up questions\n- A?\n3) B?\nC") == ("It is so.", ["A?", "B?"])
    assert got("It is so.\nFollow-up questions\n- A?") == ("It is so.\nFollow-up questions\n- A?", [])
    assert got("### Key connections\n- a to b\n* b to c\nend") == ("end", [])
    assert got(None) == got(" \n") == ("", [])


def test_links_ids_and_times(spark):
    base = F.lit("https://h.x")
    assert one(spark, *[ft.absolute_url(F.lit(u), base) for u in ("http://a", "/b", "c")]) == ("http://a", "https://h.x/b", "https://h.x/c")
    assert one(spark, *[ft.file_name(F.lit(u)) for u in ("https://h/a%20b.pdf?x=1#y", "https://h/a/", "", "/%zz.pdf", "a+b")]) == ("a b.pdf", "a", "order_paper.pdf", "%zz.pdf", "a+b")
    assert one(spark, *[ft.legislation_base(F.lit(n)) for n in ("The hr  12 bill", "Road traffic act")]) == ("L_HR12", "L_ROAD_TRAFF")
    assert one(spark, ft.temporary_id(F.lit(" a:b--c ")), ft.temporary_id(F.lit(None))) == ("tmp_a_b_c", "tmp_")
    times = [(0, "u?t=9", "1:00"), (0, None, "1:00"), (0, "u?t=", ""), (5, "u?t=9", None), (None, "u?start=2m", None), (None, None, None)]
    assert [one(spark, ft.source_seconds(*map(F.lit, t)))[0] for t in times] == [9, 60, 0, 5, 120, None]


def test_numbers_skip_taken_ones_and_each_other(spark):
    rows = spark.createDataFrame([("L_A", 1), ("L_A", 2), ("L_A", 3), ("L_B", 4)], "base string, n int")
    known = spark.createDataFrame([("L_A_1",), ("L_A_3",), ("L_A_3",), ("L_A_x",), ("L_B_02",), (None,)], "id string")
    assert [r.id for r in upsert.numbered_ids(rows, "base", ["n"], known, "id").orderBy("n").collect()] == ["L_A_2", "L_A_4", "L_A_5", "L_B_1"]
    assert upsert.numbered_ids(rows, "base", ["n"], known.where("false"), "id").count() == 4


def test_order_is_kept_where_an_id_is_not_mapped(spark):
    ids, mapping = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", "x"), ("b", "b"), ("c", "y")], "old_id string, new_id string")
    assert [tuple(r) for r in upsert.existing_changes(mapping, ids, "id").collect()] == [("a", "x")]
    kept = lambda i, m: upsert.keeps_order(i, m, "id").first()[0]
    assert (kept(ids, mapping), kept(ids, mapping.where("old_id <> 'b'")), kept(ids.where("false"), mapping)) == (False, True, False)


def test_threads_and_tables(spark):
    heads = spark.createDataFrame([("t", "T"), ("u", "U")], "id string, title string")
    messages = spark.createDataFrame([("m", "t", "user", "hi", 1)], "id string, thread_id string, role string, content string, created_at int")
    states = spark.createDataFrame([("t", '{"a": "b"}'), ("u", "{")], "thread_id string, state string")
    got = {r.thread_id: (r.message_id, r.state) for r in threads.thread_messages(heads, messages, states).collect()}
    assert got == {"t": ("m", {"a": "b"}), "u": (None, {})}
    rows = spark.createDataFrame([("w", 2, "i", "k", "l", ["a", "b", "c", "d"]), ("w", 1, "j", "k", None, None)], "w string, p int, id string, type string, label string, aliases array<string>")
    assert threads.known_tables(rows, ["w"], "p").first().nodes == "| ID | Type | Label | Aliases |\n|---|---|---|---|\n| j | k |  |  |\n| i | k | l | a, b, c |"


def test_counts_below_one_mean_one_and_blank_queries_find_nothing(spark):
    nodes = spark.createDataFrame([("a", "k", "Road", ["street"], [1.0, 0.0]), ("b", "k", "Bus", [], [0.0, 1.0])], "id string, type string, label string, aliases array<string>, embedding array<double>")
    aliases = spark.createDataFrame([("road", "a"), ("bus", "b")], "alias_norm string, node_id string")
    edges = spark.createDataFrame([("e", "a", "b", 0.5, 1, 0.01, ["u"]), ("f", "b", "a", None, 1, None, ["u"])], "id string, source_id string, target_id string, confidence double, earliest_seconds int, edge_rank_score double, utterance_ids array<string>")
    sentences = spark.createDataFrame([("u", "v", 1)], "id string, video_id string, seconds_since_start int")
    search = lambda q, **k: {n: [r.id for r in t.collect()] for n, t in retrieval.graph_search(nodes, aliases, edges, sentences, q, **k).items()}
    assert search("  ") == {"seeds": [], "edges": [], "nodes": [], "citations": []}
    found = search("road", seeds=0, hops=0, most_edges=0, most_citations=-3)
    assert (found["seeds"], found["edges"], sorted(found["nodes"]), found["citations"]) == (["a"], ["e"], ["a", "b"], ["u"])
    assert search("road", least_rank=0.02)["edges"] == [] and len(search("road", least_rank=0.05)["edges"]) == 2
    picked = retrieval.question_nodes(nodes, aliases, " BUS ", [1.0, 0.0], 1)
    assert [(r.id, r.source) for r in picked.collect()] == [("a", "vector"), ("b", "alias")]
    assert [r.id for r in retrieval.edges_of_nodes(edges, picked.where("id = 'a'"), 1).collect()] == ["e"]
