"""Rules of names, texts, files and graphs that other queries use only in part, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import names, score
from tessera.functions import text as ft
from tessera.operators import canonical, graph, quality_reports, retrieval, search, upsert
from tessera.plans.workspace import Workspace
from tessera.queries.tables import edges, table
from tessera.sources import readers


def _text(c):
    return F.col(c).cast("string")


def name_keys(spark, sf_dir):
    """Surnames and initials of labels in three forms, and titles of statutes without years."""
    key, name = F.col("c_custkey"), F.col("c_name")
    label = F.when(key % 3 == 0, F.concat(name, F.lit(", A B"))).when(key % 3 == 1, F.concat(F.lit("Hon. A.B. "), name, F.lit(" MP"))).otherwise(F.concat(F.lit(" Senator  "), name))
    act = F.concat(F.lit("Road  Act "), (1900 + key % 99).cast("string"), F.lit(" (no. "), _text("c_custkey"), F.lit(")"))
    return table(spark, sf_dir, "customer").select("c_custkey", ft.surname(label).alias("surname"), ft.initials(label).alias("initials"), ft.legislation_key(act).alias("act"))


def speaker_references(spark, sf_dir):
    """Speakers' references in three forms, of whom only some are known."""
    known = F.array(*[F.lit(f"s_{i}") for i in range(10)])
    form = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" speaker_s_"), _text("c_nationkey"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("s_"), _text("c_nationkey"))).otherwise(F.concat(F.lit("kg_"), _text("c_nationkey")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(names.reference(form, known), F.lit("dropped")).alias("reference"))


def terms_found(spark, sf_dir):
    terms = F.array(*map(F.lit, ["than", "tion", "que", "der", "los", "ing", "and", "the"]))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.coalesce(ft.matched_terms(terms, F.col("text"), 3), F.array().cast("array<string>")), ",").alias("terms"))


def durations(spark, sf_dir):
    key = F.col("o_orderkey")
    shown = F.when(key % 4 == 0, F.concat_ws(":", (key % 50).cast("string"), F.lit("75"), F.lit("99"))).when(key % 4 == 1, F.concat_ws(":", (key % 500).cast("string"), F.lit("05"))).when(key % 4 == 2, F.lit("1:xx")).otherwise(F.lit(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(ft.duration_seconds(shown), F.lit(-1)).cast("long").alias("seconds"))


def vectors_as_text(spark, sf_dir):
    """Vectors written as text and read again, besides texts that are none."""
    shown = F.when(F.col("vec_id") % 5 == 0, F.lit("[1, null]")).otherwise(score.format_vector(F.col("embedding")))
    read = score.parse_vector(shown)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.coalesce(F.size(read), F.lit(-1)).cast("long").alias("size"), F.round(F.coalesce(F.aggregate(read, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)), 4).alias("total"))


def reranked(spark, sf_dir):
    """Four marks as one, some of them missing."""
    mark = lambda c: F.when(F.col(c) % 3 > 0, F.col(c) % 7 / 7)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(score.rerank_blend(mark("l_partkey"), mark("l_suppkey"), mark("l_orderkey"), mark("l_linenumber")), 6).alias("score"))
    return rows.groupBy("l_orderkey").agg(F.round(F.sum("score"), 6).alias("score"))


def chambers(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    explicit = F.when(key % 5 == 0, " Senate ").when(key % 5 == 1, "other")
    parsed = F.when(key % 3 == 0, "HOUSE")
    title = F.when(key % 2 == 0, "Sitting of the SENATE").otherwise("A sitting")
    return rows.select("s_suppkey", readers.chamber_of(explicit, parsed, title).alias("chamber"))


def caption_statuses(spark, sf_dir):
    """Texts compared with captions that are the same but for marks, none, or about something else; texts that have no letters are empty."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 != 3, "a plain sentence of words").otherwise(" ").alias("said"), F.when(F.col("turn") % 4 == 0, "<c>A plain</c> sentence, of words!").when(F.col("turn") % 4 == 1, "zz yy xx").when(F.col("turn") % 4 == 3, "words").alias("shown"))
    return quality_reports.caption_check(rows, "said", "shown", 80.0).select("conv_id", "turn", "similarity", "status")


def rewritten(spark, sf_dir):
    """Edges between nations' customers and kinds of parts, by a map for some nodes."""
    customers = table(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.concat(F.lit("c"), _text("c_custkey")).alias("old_id"), F.concat(F.lit("n"), _text("c_nationkey")).alias("canonical_id"))
    parts = table(spark, sf_dir, "part").where("p_size > 10").select(F.concat(F.lit("p"), _text("p_partkey")).alias("old_id"), F.col("p_type").alias("canonical_id"))
    return graph.rewrite_endpoints(edges(spark, sf_dir), customers.union(parts)).groupBy("source_id", "target_id").agg(F.count("*").alias("edges"))


def graph_faults(spark, sf_dir):
    """What a check of the graph finds: customers are persons, large parts of an unknown kind, some parts missing."""
    people = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), _text("c_custkey")).alias("id"), F.lit("foaf:Person").alias("type"))
    parts = table(spark, sf_dir, "part").where("p_size > 5").select(F.concat(F.lit("p"), _text("p_partkey")).alias("id"), F.when(F.col("p_size") > 45, "Thing").otherwise("skos:Concept").alias("type"))
    found = edges(spark, sf_dir).withColumn("predicate", F.when(F.col("predicate") == "A", "AMENDS").when(F.col("predicate") == "N", "QUESTIONS").otherwise("OTHER"))
    return graph.verification(people.union(parts), found).select("check", F.col("violations").cast("long").alias("violations"))


def _answers(spark, sf_dir):
    """An answer for each order: one is no JSON, others propose its parts as nodes that its customer is tied to."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "p_name", "p_brand")
    tag = F.concat(F.lit("n"), _text("l_linenumber"), _text("l_partkey"))
    node = F.struct(tag.alias("temp_id"), F.lit("skos:Concept").alias("type"), F.concat_ws(" ", "p_name", "p_brand").alias("label"), F.array(F.upper("p_brand")).alias("aliases"))
    cited = F.when(F.col("l_linenumber") % 3 > 0, F.array(F.concat_ws(":", _text("l_orderkey"), _text("l_linenumber")))).otherwise(F.array().cast("array<string>"))
    edge = F.struct(F.lit("speaker_1").alias("source_ref"), F.when(F.col("l_linenumber") == 5, "EATS").otherwise("PROPOSES").alias("predicate"), tag.alias("target_ref"), F.lit("said").alias("evidence"), cited.alias("utterance_ids"), (F.col("l_discount") * 12).alias("confidence"))
    made = lines.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(node).alias("nodes_new"), F.collect_list(edge).alias("edges"))).alias("j"))
    answer = F.when(F.col("l_orderkey") % 10 == 0, F.lit("no json")).when(F.col("l_orderkey") % 10 == 1, F.lit('{"nodes_new": [], "edges": []}')).otherwise(F.concat(F.lit("Here:\n```json\n"), "j", F.lit("\n```")))
    rows = made.select(_text("l_orderkey").alias("video_id"), F.lit(0).alias("window_index"), answer.alias("answer"))
    return canonical.parse_payloads(rows, "video_id", "answer")


def payload_faults(spark, sf_dir):
    return canonical.payload_issues(_answers(spark, sf_dir)).select("video_id", "issue")


def canonical_nodes(spark, sf_dir):
    """Nodes and the edges that hold, from every order's answer."""
    sentences = table(spark, sf_dir, "lineitem").select(F.concat_ws(":", _text("l_orderkey"), _text("l_linenumber")).alias("id"), F.col("l_linenumber").cast("int").alias("seconds_since_start"))
    found = canonical.canonicalize(_answers(spark, sf_dir), sentences, spark.createDataFrame([("speaker_1",)], "id string"))
    each = found["edges"].groupBy("target_id").agg(F.count("*").alias("edges"), F.min("earliest_seconds").cast("long").alias("first"))
    return found["nodes"].join(each, F.col("id") == F.col("target_id"), "left").select("id", "label", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("first", F.lit(-1)).alias("first"))


def seeded_graph(spark, sf_dir):
    """Aliases of a graph of suppliers as speakers, part names as items and part kinds as bills."""
    speakers = table(spark, sf_dir, "supplier").select(_text("s_suppkey").alias("id"), F.concat(F.lit("Hon. "), "s_name").alias("name"))
    items = table(spark, sf_dir, "part").select(F.col("p_name").alias("title"))
    bills = table(spark, sf_dir, "part").select(F.col("p_type").alias("title"), F.when(F.col("p_type") != "SMALL", F.concat(F.lit("HR "), "p_type")).alias("bill_number")).distinct()
    return canonical.seed_graph(speakers, items, bills)[1]


def bill_files(spark, sf_dir):
    """Parts as bills in JSON files, an array for each brand, read again."""
    folder = f"{Workspace(spark, 'bills').root}/json"
    bill = F.struct(_text("p_partkey").alias("bill_id"), F.concat(F.lit("HR "), _text("p_partkey")).alias("bill_number"), F.col("p_name").alias("title"), F.array("p_type", "p_name").alias("keywords"))
    made = table(spark, sf_dir, "part").groupBy(F.regexp_replace("p_brand", "#", "").alias("brand")).agg(F.to_json(F.collect_list(bill)).alias("value"))
    made.write.partitionBy("brand").text(folder)
    return readers.bills(spark, folder).select("bill_id", "bill_number", "title", F.array_join("keywords", ",").alias("keywords"))


def flag_files(spark, sf_dir):
    """Flags in CSV files: those without a speaker or times are left out."""
    folder = f"{Workspace(spark, 'flags').root}/csv"
    times = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("00:01, , 00:0"), _text("c_custkey"))).otherwise(F.lit(" , "))
    rows = table(spark, sf_dir, "customer").select(_text("c_nationkey").alias("video_id"), F.when(F.col("c_custkey") % 5 > 0, _text("c_custkey")).alias("speaker_id"), F.col("c_name").alias("speaker_name"), F.lit("1").alias("voice_id"), times.alias("sample_timestamps"))
    rows.write.option("header", True).csv(folder)
    return readers.flags(spark, folder).select("video_id", "speaker_id", "speaker_name", F.array_join("samples", "|").alias("samples"))


def override_files(spark, sf_dir):
    """Overrides in JSON files with the reason why some don't count."""
    folder = f"{Workspace(spark, 'overrides').root}/json"
    key = F.col("c_custkey")
    end = F.when(key % 4 == 0, "00:00:01").when(key % 4 == 1, "late").otherwise("00:09:00")
    entry = F.struct(_text("c_custkey").alias("video_id"), F.lit("00:00:30").alias("start"), end.alias("end"), F.when(key % 7 > 0, F.col("c_name")).alias("new_speaker_id"))
    table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.to_json(F.collect_list(entry)).alias("value")).write.partitionBy("c_nationkey").text(folder)
    good, bad = readers.overrides(spark, folder)
    return good.select("video_id", F.lit("good").alias("reason")).unionByName(bad.select("video_id", "reason"))


def check_files(spark, sf_dir):
    """Overrides that follow from checks in JSON files."""
    folder = f"{Workspace(spark, 'checks').root}/json"
    key = F.col("c_custkey")
    result = F.when(key % 6 > 0, F.struct(F.when(key % 5 > 0, F.col("c_name")).alias("name"), (key % 2 == 0).alias("match_requested"), (key % 10 / 10).alias("confidence")))
    entry = F.struct(_text("c_custkey").alias("video_id"), F.lit("00:01:00").alias("timestamp"), F.lit("s").alias("speaker_id"), result.alias("result"))
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.to_json(F.struct(F.collect_list(entry).alias("results"))).alias("value"))
    rows.write.partitionBy("c_nationkey").text(folder)
    return quality_reports.overrides_from(readers.verifications(spark, folder), 0.5).select("video_id", "start", "new_speaker_name")


def watch_lists(spark, sf_dir):
    folder = f"{Workspace(spark, 'watch').root}/text"
    line = F.when(F.col("c_custkey") % 4 == 0, "# a comment").when(F.col("c_custkey") % 4 == 1, " ").when(F.col("c_custkey") % 4 == 2, F.concat(F.lit(" "), _text("c_custkey"), F.lit(" | "), "c_name", F.lit("|x"))).otherwise(_text("c_custkey"))
    table(spark, sf_dir, "customer").select(line).write.text(folder)
    return readers.watch_list(spark, folder).select("id", F.coalesce("title", F.lit("-")).alias("title"))


def caption_texts(spark, sf_dir):
    cues = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("position"), F.col("turn").cast("double").alias("start"), "text")
    return readers.caption_text(cues, "conv_id", 2).select("conv_id", F.length("text").cast("long").alias("size"), F.md5(F.col("text").cast("binary")).alias("digest"))


def first_pages(spark, sf_dir):
    """The first extracted page of each number: line items by part, in order of order and line."""
    return readers.first_page_of_each(table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), ["l_partkey"], ["l_orderkey", "l_linenumber"])


def snapshots(spark, sf_dir):
    """Customers by nation from a copy of their table that was made before all were deleted, and how many went."""
    rows = table(spark, sf_dir, "customer")
    copy = upsert.snapshot(rows, f"{Workspace(spark, 'snapshot').root}/copy")
    left, gone = upsert.delete_all(rows)
    return copy.groupBy("c_nationkey").agg(F.count("*").alias("kept"), F.lit(gone + left.count()).cast("long").alias("gone"))


def names_mentioned(spark, sf_dir):
    """Customers whose names a message has that the query lacks, and of the nations those that a query mentions."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"))
    first = people.orderBy("id").limit(3).collect()
    message = " ".join(["ask", *[r["full_name"].upper() for r in first]])
    found = search.named_in(people, message, first[0]["full_name"]).select(_text("id").alias("id"), F.lit("named").alias("how"))
    nations = table(spark, sf_dir, "nation").select(_text("n_nationkey").alias("id"), F.col("n_name").alias("label"), F.array("n_name").alias("aliases"))
    said = nations.orderBy("label").first()["label"]
    return found.unionByName(retrieval.prefer_mentioned(nations, "label", "aliases", f"what of {said.lower()}?").select("id", F.lit("mentioned").alias("how")))


QUERIES = {
    "name_keys": name_keys, "speaker_references": speaker_references, "terms_found": terms_found, "durations": durations, "vectors_as_text": vectors_as_text, "reranked": reranked, "chambers": chambers,
    "caption_statuses": caption_statuses, "rewritten_endpoints": rewritten, "graph_faults": graph_faults, "payload_faults": payload_faults, "canonical_nodes": canonical_nodes, "seeded_graph": seeded_graph, "bill_files": bill_files,
    "flag_files": flag_files, "override_files": override_files, "check_files": check_files, "watch_lists": watch_lists, "caption_texts": caption_texts, "first_pages": first_pages, "snapshots": snapshots, "names_mentioned": names_mentioned,
}

_MARK = "coalesce(CASE WHEN {0} % 3 > 0 THEN {0} % 7 / 7 END, 0.5)"
_GRAPH = """e AS (SELECT o_custkey, l_partkey, l_linestatus, CASE l_returnflag WHEN 'A' THEN 'AMENDS' WHEN 'N' THEN 'QUESTIONS' ELSE 'OTHER' END AS predicate, p_size > 5 AS there FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
SQL = {
    "name_keys": "SELECT c_custkey, c_name AS surname, CASE WHEN c_custkey % 3 = 2 THEN '' ELSE 'AB' END AS initials, 'road act (no. ' || CASE WHEN length(CAST(c_custkey AS VARCHAR)) = 4 THEN '' ELSE CAST(c_custkey AS VARCHAR) END || ')' AS act FROM customer",
    "speaker_references": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 'kg_' || c_nationkey WHEN c_nationkey < 10 THEN 'speaker_s_' || c_nationkey ELSE 'dropped' END AS reference FROM customer",
    "terms_found": "SELECT doc_id, coalesce(array_to_string(list_filter(['than', 'tion', 'que', 'der', 'los', 'ing', 'and', 'the'], lambda t: contains(lower(text), t))[1:3], ','), '') AS terms FROM documents",
    "durations": "SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 50 * 3600 + 75 * 60 + 99 WHEN 1 THEN o_orderkey % 500 * 60 + 5 ELSE -1 END AS BIGINT) AS seconds FROM orders",
    "vectors_as_text": "SELECT vec_id, CAST(CASE WHEN vec_id % 5 = 0 THEN -1 ELSE len(embedding) END AS BIGINT) AS size, round(CASE WHEN vec_id % 5 = 0 THEN 0 ELSE list_sum(CAST(embedding AS DOUBLE[])) END, 4) AS total FROM embeddings",
    "reranked": f"SELECT l_orderkey, round(sum(round(0.55 * {_MARK.format('l_partkey')} + 0.20 * {_MARK.format('l_suppkey')} + 0.15 * {_MARK.format('l_orderkey')} + 0.10 * {_MARK.format('l_linenumber')}, 6)), 6) AS score FROM lineitem GROUP BY l_orderkey",
    "chambers": "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'senate' WHEN s_suppkey % 3 = 0 THEN 'house' WHEN s_suppkey % 2 = 0 THEN 'senate' ELSE 'house' END AS chamber FROM supplier",
    "caption_statuses": "SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 100.0::DOUBLE WHEN turn % 4 = 1 THEN round(200.0 * 2 / 33, 12)::DOUBLE ELSE 0.0::DOUBLE END AS similarity, ['ok', 'mismatch', 'no_captions', 'empty_transcript'][turn % 4 + 1] AS status FROM conversations",
    "rewritten_endpoints": """SELECT CASE WHEN c_nationkey < 20 THEN 'n' || c_nationkey ELSE 'c' || o_custkey END AS source_id, CASE WHEN p_size > 10 THEN p_type ELSE 'p' || l_partkey END AS target_id, count(*) AS edges
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "graph_faults": f"""WITH {_GRAPH} SELECT 'missing_endpoint' AS check, count(*) AS violations FROM e WHERE NOT there UNION ALL SELECT 'predicate', count(*) FROM e WHERE there AND predicate = 'OTHER' UNION ALL SELECT 'discourse', count(*) FROM e WHERE there AND predicate = 'QUESTIONS'
UNION ALL SELECT 'node_type', count(*) FROM part WHERE p_size > 45 UNION ALL SELECT 'duplicate', CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM e GROUP BY o_custkey, l_partkey, predicate, l_linestatus) HAVING sum(c - 1) > 0""",
    "payload_faults": """SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS video_id, unnest(CASE WHEN l_orderkey % 10 = 0 THEN ['no_payload'] WHEN l_orderkey % 10 = 1 THEN [] ELSE list_filter([CASE WHEN l_linenumber = 5 THEN 'predicate' END, CASE WHEN l_discount * 12 > 1 THEN 'confidence' END,
  CASE WHEN l_linenumber % 3 = 0 THEN 'no_utterances' END, CASE WHEN twice THEN 'duplicate_temp_id' END], lambda x: x IS NOT NULL) END) AS issue FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber || '' || l_partkey) > 1 AS twice FROM lineitem)""",
    "canonical_nodes": """WITH n AS (SELECT p_name || ' ' || p_brand AS label, l_linenumber, l_linenumber <> 5 AND l_linenumber % 3 > 0 AS good, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 10 > 1)
SELECT 'kg_' || substr(md5('skos:Concept:' || lower(label)), 1, 12) AS id, label, count(DISTINCT CASE WHEN good THEN l_orderkey || ':' || l_linenumber END) AS edges, coalesce(min(CASE WHEN good THEN l_linenumber END), -1)::BIGINT AS first FROM n GROUP BY label""",
    "seeded_graph": """SELECT DISTINCT lower(unnest(['Hon. ' || s_name, s_name])) AS alias_norm, 'speaker_' || s_suppkey AS node_id FROM supplier UNION SELECT lower(p_name), 'kg_' || substr(md5('skos:Concept:' || lower(p_name)), 1, 12) FROM part
UNION SELECT unnest(list_filter([lower(p_type), CASE WHEN p_type <> 'SMALL' THEN 'hr ' || lower(p_type) END], lambda x: x IS NOT NULL)), 'kg_' || substr(md5('schema:Legislation:' || lower(p_type)), 1, 12) FROM part""",
    "bill_files": "SELECT CAST(p_partkey AS VARCHAR) AS bill_id, 'HR ' || p_partkey AS bill_number, p_name AS title, p_type || ',' || p_name AS keywords FROM part",
    "flag_files": "SELECT CAST(c_nationkey AS VARCHAR) AS video_id, CAST(c_custkey AS VARCHAR) AS speaker_id, c_name AS speaker_name, '00:01|00:0' || c_custkey AS samples FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 5 > 0",
    "override_files": "SELECT CAST(c_custkey AS VARCHAR) AS video_id, CASE WHEN c_custkey % 7 = 0 THEN 'missing field' WHEN c_custkey % 4 = 1 THEN 'bad time' WHEN c_custkey % 4 = 0 THEN 'start after end' ELSE 'good' END AS reason FROM customer",
    "check_files": "SELECT CAST(c_custkey AS VARCHAR) AS video_id, '00:01:00' AS start, c_name AS new_speaker_name FROM customer WHERE c_custkey % 6 > 0 AND c_custkey % 5 > 0 AND c_custkey % 2 = 1 AND c_custkey % 10 >= 5",
    "watch_lists": "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 4 = 2 THEN c_name || '|x' ELSE '-' END AS title FROM customer WHERE c_custkey % 4 > 1",
    "caption_texts": "SELECT conv_id, length(t) AS size, md5(t) AS digest FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS t FROM conversations WHERE turn <= 2 GROUP BY conv_id)",
    "first_pages": "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1",
    "snapshots": "SELECT c_nationkey, count(*) AS kept, (SELECT count(*) FROM customer) AS gone FROM customer GROUP BY c_nationkey",
    "names_mentioned": "SELECT CAST(c_custkey AS VARCHAR) AS id, 'named' AS how FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 3) QUALIFY row_number() OVER (ORDER BY c_custkey) > 1 UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'mentioned' FROM nation, (SELECT min(n_name) AS least FROM nation) WHERE contains('what of ' || lower(least) || '?', lower(n_name))",
}
