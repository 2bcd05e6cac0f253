"""Answers, links, ids and threads of a chat."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import answers
from tessera.functions import text as ft
from tessera.operators import retrieval, threads, upsert
from tessera.queries.tables import EDGES, edges, table


def answer_parts(spark, sf_dir):
    """Messages as answers of six forms, cleaned: headings, key connections, follow-up questions."""
    body = F.concat(F.lit("so "), F.trim(F.regexp_replace("text", r"\s+", " ")))
    asked = F.lit("\n\nFollow-up questions:\n- Who spoke?\n2. When?\n-\n* And why not")
    forms = [
        F.concat(F.lit("Wuh loss, "), body, asked),
        F.concat(F.lit("Road Tax and the Fares\n"), body, F.lit("\n\nThe Budget of 2026\n\n"), body),
        F.concat(F.lit("## Key connections\n- a, b\n* c\n\n"), body),
        F.concat(body, F.lit("\r\nfollow up questions\n- Only one?\n")),
        F.concat(F.lit("  "), body, F.lit("\n\nWater in Rural Areas\n- pipes\n")),
        F.lit("  "),
    ]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.cleaned(F.element_at(F.array(*forms), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))).alias("a"))
    return rows.select("conv_id", "turn", F.col("a.text").alias("answer"), F.array_join("a.follow_ups", "|").alias("follow_ups"))


def legislation_ids(spark, sf_dir):
    """Ids for parts as bills, of which every twentieth number of a base is taken."""
    key = F.col("p_partkey")
    name = F.when(key % 3 == 0, F.concat(F.lit("A bill, hr "), (key % 40).cast("string"))).when(key % 3 == 1, F.concat(F.lit("x "), (key % 25).cast("string"))).otherwise(F.concat(F.lit("Tax on "), F.substring("p_brand", 1, 9)))
    parts = table(spark, sf_dir, "part").select("p_partkey", ft.legislation_base(name).alias("base"))
    numbers = F.array(F.lit(1), F.lit(2), F.lit(4), F.lit(9))
    taken = parts.where("p_partkey % 20 = 0").select(F.explode(F.transform(numbers, lambda n: F.concat_ws("_", "base", n.cast("string")))).alias("id"))
    return upsert.numbered_ids(parts, "base", ["p_partkey"], taken, "id").select("p_partkey", "id")


def url_forms(spark, sf_dir):
    """Pages' addresses in several forms: whole, as bills, as file names and temporary ids."""
    path = F.regexp_replace("url", "^https?://[^/]+/", "")
    own = F.element_at(F.array(F.col("url"), F.concat(F.lit("/Bills/Details/"), path), F.concat(path, F.lit("#a/b")), F.lit("/"), F.concat(F.lit("a%20b+c%2Fd.pdf?x="), path)), (F.col("page_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", own.alias("u"))
    return rows.select("page_id", ft.absolute_url(F.col("u"), F.lit("https://h.example")).alias("url"), ft.is_bill_url(F.col("u")).alias("is_bill"), ft.file_name(F.col("u")).alias("file"), ft.temporary_id(F.col("u")).alias("temp_id"))


def source_times(spark, sf_dir):
    """Times of line items as sources: their own, their link's, or their timestamp's."""
    n, key = F.col("l_linenumber").cast("long"), F.col("l_partkey") % 6
    link = F.element_at(F.array(F.lit("https://y/w?v=a"), F.concat(F.lit("https://y/w?v=a&t="), n.cast("string"), F.lit("m5s")), F.concat(F.lit("https://y/w?start="), (n * 100).cast("string")), F.lit("https://y/w?t=x"), F.lit(None).cast("string"), F.lit("https://y/w?t=&start=1H")), (key + 1).cast("int"))
    stamp = F.when(F.col("l_suppkey") % 2 == 0, "01:02:03")
    own = F.when(n < 3, n - 1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ft.source_seconds(own, link, stamp).alias("s")).select("l_orderkey", "l_linenumber", F.when(F.col("s").isNotNull(), ft.to_timestamp_text(F.col("s"))).alias("shown"))


def thread_rows(spark, sf_dir):
    """Conversations as threads with their states, some broken, and one thread without a message for each region."""
    rows = table(spark, sf_dir, "conversations")
    empty = table(spark, sf_dir, "region").select((-1 - F.col("r_regionkey")).cast("long").alias("id"), F.col("r_name").alias("title"))
    heads = rows.select(F.col("conv_id").alias("id")).distinct().select("id", F.concat(F.lit("T"), F.col("id").cast("string")).alias("title")).union(empty)
    messages = rows.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").alias("thread_id"), "role", F.col("text").alias("content"), F.col("turn").alias("created_at"))
    states = heads.where("id % 3 <> 0").select(F.col("id").alias("thread_id"), F.when(F.col("id") % 3 == 1, F.concat(F.lit('{"topic": "t'), F.col("id").cast("string"), F.lit('"}'))).otherwise("{broken").alias("state"))
    found = threads.thread_messages(heads, messages, states)
    return found.select("thread_id", "title", "message_id", "role", F.coalesce(F.length("content").cast("long"), F.lit(-1).cast("long")).alias("chars"), F.col("state")["topic"].alias("topic"))


def known_nodes(spark, sf_dir):
    """Suppliers of each nation as a table of known nodes, and a list of speakers."""
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_suppkey").alias("place"), F.concat(F.lit("n"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("foaf:Person").alias("type"), F.col("s_name").alias("label"), F.split("s_name", "0").alias("aliases"))
    tables = threads.known_tables(rows, ["s_nationkey"], "place")
    lists = rows.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.when(F.col("place") % 2 == 0, F.struct("id", F.col("label").alias("name"))))).alias("s"))
    return tables.join(lists, "s_nationkey").select("s_nationkey", F.md5("nodes").alias("nodes"), F.md5(answers.speaker_list(F.col("s"))).alias("speakers"))


def question_edges(spark, sf_dir):
    """Nodes near a question, by vector and alias, as customers, and the surest edges at them."""
    vectors = table(spark, sf_dir, "embeddings")
    nodes = vectors.select(F.concat(F.lit("c"), (F.col("vec_id") + 1).cast("string")).alias("id"), F.lit("person").alias("type"), F.concat(F.lit("Node "), F.col("vec_id").cast("string")).alias("label"), F.array(F.col("label").cast("string")).alias("aliases"), "embedding")
    names = nodes.select(F.concat(F.lit("label "), F.col("aliases")[0]).alias("alias_norm"), F.col("id").alias("node_id"))
    vector = vectors.where("vec_id = 0").first()["embedding"]
    found = retrieval.question_nodes(nodes, names, " Label  3", vector)
    return retrieval.edges_of_nodes(edges(spark, sf_dir), found, 200).select("id", "source_id", "target_id", "confidence")


def mapping_changes(spark, sf_dir):
    """Orders' ids mapped to others: those that change an order there is, and whether its order must be kept."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    mapping = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").cast("string").alias("old_id"), F.concat(F.when(F.col("l_suppkey") % 2 == 0, "x").otherwise(""), F.col("l_orderkey").cast("string")).alias("new_id"))
    mapping = mapping.union(mapping.where("old_id like '%7'").select(F.concat(F.lit("-"), "old_id"), "new_id"))
    return upsert.existing_changes(mapping, orders, "id").crossJoin(F.broadcast(upsert.keeps_order(orders, mapping, "id")))


QUERIES = {
    "answer_parts": answer_parts,
    "legislation_ids": legislation_ids,
    "url_forms": url_forms,
    "source_times": source_times,
    "thread_rows": thread_rows,
    "known_nodes": known_nodes,
    "question_edges": question_edges,
    "mapping_changes": mapping_changes,
}

SQL = {
    "answer_parts": r"""WITH b AS (SELECT conv_id, turn, (conv_id + turn) % 6 AS f, 'so ' || trim(regexp_replace(text, '\s+', ' ', 'g')) AS b FROM conversations)
SELECT conv_id, turn, trim(CASE f WHEN 0 THEN b WHEN 1 THEN '### Road Tax and the Fares' || chr(10) || b || chr(10) || chr(10) || 'The Budget of 2026' || chr(10) || chr(10) || b WHEN 2 THEN b
  WHEN 3 THEN b || chr(10) || 'follow up questions' || chr(10) || '- Only one?' WHEN 4 THEN b || chr(10) || chr(10) || '### Water in Rural Areas' || chr(10) || '- pipes' ELSE '' END) AS answer,
  CASE WHEN f = 0 THEN 'Who spoke?|When?' ELSE '' END AS follow_ups FROM b""",
    "legislation_ids": """WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'L_HR' || p_partkey % 40 WHEN 1 THEN 'L_X_' || p_partkey % 25 ELSE 'L_' || replace(upper(substr('Tax on ' || substr(p_brand, 1, 9), 1, 10)), ' ', '_') END AS base FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS r FROM p), n AS (SELECT base, unnest(range(1, max(r) + 6)) AS n FROM r GROUP BY base),
free AS (SELECT base, n, row_number() OVER (PARTITION BY base ORDER BY n) AS r FROM n WHERE NOT (n IN (1, 2, 4, 9) AND base IN (SELECT base FROM p WHERE p_partkey % 20 = 0)))
SELECT p_partkey, base || '_' || n AS id FROM r JOIN free USING (base, r)""",
    "url_forms": r"""WITH u AS (SELECT page_id, page_id % 5 AS f, url, regexp_replace(url, '^https?://[^/]+/', '') AS path FROM pages)
SELECT page_id, CASE f WHEN 0 THEN url WHEN 1 THEN 'https://h.example/Bills/Details/' || path WHEN 2 THEN CASE WHEN path LIKE 'http%' THEN path ELSE 'https://h.example/' || path END || '#a/b' WHEN 3 THEN 'https://h.example/' ELSE 'https://h.example/a%20b+c%2Fd.pdf?x=' || path END AS url,
  f = 1 AS is_bill, CASE WHEN f = 3 THEN 'order_paper.pdf' WHEN f = 4 THEN 'a b+c/d.pdf' ELSE regexp_extract(path, '([^/?#]+)/*([?#].*)?$', 1) END AS file,
  'tmp_' || regexp_replace(CASE f WHEN 0 THEN url WHEN 1 THEN '/Bills/Details/' || path WHEN 2 THEN path || '#a/b' WHEN 3 THEN '/' ELSE 'a%20b+c%2Fd.pdf?x=' || path END, '[^a-zA-Z0-9_]+', '_', 'g') AS temp_id FROM u""",
    "source_times": """WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN 1 ELSE
  coalesce(CASE l_partkey % 6 WHEN 1 THEN l_linenumber * 60 + 5 WHEN 2 THEN l_linenumber * 100 WHEN 3 THEN 0 WHEN 5 THEN 3600 END, CASE WHEN l_suppkey % 2 = 0 THEN 3723 END, CASE WHEN l_linenumber = 1 THEN 0 END) END AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS shown FROM s""",
    "thread_rows": """SELECT conv_id AS thread_id, 'T' || conv_id AS title, conv_id || ':' || turn AS message_id, role, length(text) AS chars, CASE WHEN conv_id % 3 = 1 THEN 't' || conv_id END AS topic FROM conversations
UNION ALL SELECT -1 - r_regionkey, r_name, NULL, NULL, -1, NULL FROM region""",
    "known_nodes": """SELECT s_nationkey, md5('| ID | Type | Label | Aliases |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg('| n' || s_suppkey || ' | foaf:Person | ' || s_name || ' | ' || array_to_string(string_split(s_name, '0')[:3], ', ') || ' |', chr(10) ORDER BY s_suppkey)) AS nodes,
  md5(coalesce(string_agg('- n' || s_suppkey || ': ' || s_name, chr(10) ORDER BY 'n' || s_suppkey) FILTER (s_suppkey % 2 = 0), 'No previous speakers identified.')) AS speakers FROM supplier GROUP BY s_nationkey""",
    "question_edges": f"""WITH {EDGES}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
near AS (SELECT vec_id FROM embeddings, q ORDER BY 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), vec_id LIMIT 25),
named AS (SELECT vec_id FROM embeddings WHERE label = 3 ORDER BY 'c' || (vec_id + 1) LIMIT 5), ids AS (SELECT 'c' || (vec_id + 1) AS id FROM near UNION SELECT 'c' || (vec_id + 1) FROM named)
SELECT id, source_id, target_id, confidence FROM edges WHERE source_id IN (FROM ids) OR target_id IN (FROM ids) ORDER BY confidence DESC NULLS LAST, earliest_seconds NULLS LAST, id LIMIT 200""",
    "mapping_changes": """WITH m AS (SELECT l_orderkey, l_suppkey % 2 = 0 AS changed FROM lineitem WHERE l_linenumber = 1)
SELECT CAST(l_orderkey AS VARCHAR) AS old_id, 'x' || l_orderkey AS new_id, EXISTS (SELECT 1 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM m)) AS keeps_order FROM m JOIN orders ON o_orderkey = l_orderkey WHERE changed""",
}
