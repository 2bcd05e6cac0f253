"""Joins beyond equality and changes to keyed tables, over customers, orders, line items, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as ft
from tessera.functions import vocabulary as v
from tessera.operators import graph, jsonrows, matching, upsert
from tessera.operators.components import add_links
from tessera.plans.workspace import Workspace
from tessera.queries.tables import REACH, edges, links, table
from tessera.streaming import versioned

CATEGORIES = {"license": ["license", "apache", "gnu"], "contact": ["@", "token"], "table": [" | "]}


def unmatched(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def endpoint_filter(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("k"))
    large = table(spark, sf_dir, "part").where("p_size > 25").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("k"))
    kept = edges(spark, sf_dir).join(rich, F.col("source_id") == F.col("k"), "left_semi").join(large, F.col("target_id") == F.col("k"), "left_semi")
    return kept.select("id", "source_id", "target_id")


def range_override(spark, sf_dir):
    """Turns 1 to 2 of every third conversation become the moderator's, users' turns 2 to 4 a guest's."""
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    some = talk.where("conv_id % 3 = 0").select("conv_id").distinct()
    one = some.select("conv_id", F.lit(1).alias("start"), F.lit(2).alias("end"), F.lit("moderator").alias("new_value"), F.lit(None).cast("string").alias("old_value"))
    two = some.select("conv_id", F.lit(2).alias("start"), F.lit(4).alias("end"), F.lit("guest").alias("new_value"), F.lit("user").alias("old_value"))
    return matching.apply_overrides(talk, one.union(two), "conv_id", "turn", "role")


def _sittings(spark, sf_dir):
    """Orders of two priorities as videos and order papers; titles name a chamber, and some a date up to four days later."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("day"))
    said = F.date_format(F.date_add("day", (F.col("o_orderkey") % 5).cast("int")), "EEEE d'th' MMMM, yyyy")
    title = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("The Honourable The House - "), said, F.lit(" - Part 1"))).when(F.col("o_orderkey") % 3 == 1, "Senate sitting").otherwise("Committee Feed")
    videos = orders.where("o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("video"), title.alias("title"), F.when(F.col("o_orderkey") % 4 > 0, F.col("day")).alias("uploaded"))
    session = F.when(F.col("o_orderkey") % 2 == 0, "House of Assembly Session").otherwise("Senate Session")
    papers = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("paper"), F.col("day").alias("sitting"), session.alias("session"))
    return videos, papers


def nearest_dates(spark, sf_dir):
    found = matching.match_papers(*_sittings(spark, sf_dir))
    whole = {c: F.col(c).cast("long") for c in ("day_delta", "points", "rank")}
    return found.withColumns(whole).withColumn("day_delta", F.coalesce("day_delta", F.lit(-1)))


def order_paper_decisions(spark, sf_dir):
    videos, papers = _sittings(spark, sf_dir)
    found = matching.decisions(videos, matching.match_papers(videos, papers))
    return found.select("video", F.coalesce("paper", F.lit(-1)).alias("paper"), F.col("points").cast("long").alias("points"), "confidence", "status", F.array_join(F.transform("candidates", lambda c: c["paper"].cast("string")), ",").alias("candidates"))


def kth_occurrence(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey")
    a, b = lines.where("l_linenumber <= 3"), lines.where("l_linenumber > 3")
    order = lambda x: (x.select("l_suppkey", "l_returnflag", F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("o")))
    found = matching.kth_occurrence(order(a), order(b).withColumnRenamed("o", "p"), ["l_suppkey", "l_returnflag"], ["o"], ["p"])
    return found.select("l_suppkey", "l_returnflag", F.col("occurrence").cast("long").alias("occurrence"), F.col("o.l_orderkey").alias("left_order"), F.col("p.l_orderkey").alias("right_order"))


def remap_arrays(spark, sf_dir):
    """Orders' part lists with parts of even number replaced by their brand."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("a"))
    lists = lists.select("l_orderkey", F.transform("a", lambda x: x["l_partkey"].cast("string")).alias("parts"))
    mapping = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("old"), F.col("p_brand").alias("new"))
    return matching.remap_array(lists, "l_orderkey", "parts", mapping, "old", "new").select("l_orderkey", F.array_join("parts", ",").alias("parts"))


def tiers(spark, sf_dir):
    """Orders resolved to a nation by customer, else by segment if all of its customers are of one nation, else by none."""
    customers = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 100).alias("fallback"))
    first = customers.where("c_custkey % 3 = 0")
    second = customers.where("c_custkey < 100 and c_custkey % 2 = 0")
    found = matching.resolve_in_tiers(orders, [(first, "o_custkey", "c_custkey", "c_nationkey"), (second, "fallback", "c_custkey", "c_nationkey")])
    return found.select("o_orderkey", F.coalesce(F.col("resolved").cast("long"), F.lit(-1).cast("long")).alias("nation"), F.coalesce(F.col("tier").cast("long"), F.lit(-1).cast("long")).alias("tier"))


def _split(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    old = rows.where("c_custkey % 3 <> 0")
    new = rows.where("c_custkey % 3 <> 1").withColumn("c_name", F.upper("c_name")).withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 > 0, F.lower("c_mktsegment")))
    return old, new


def insert_if_absent(spark, sf_dir):
    old, new = _split(spark, sf_dir)
    return upsert.insert_if_absent(old, new.union(new.withColumn("c_name", F.lit("~"))), ["c_custkey"], [F.col("c_name")])


def upsert_latest(spark, sf_dir):
    return upsert.upsert(*_split(spark, sf_dir), ["c_custkey"])


def coalesce_upsert(spark, sf_dir):
    return upsert.upsert(*_split(spark, sf_dir), ["c_custkey"], {"c_mktsegment": "coalesce", "c_nationkey": "old"})


def conditional_upsert(spark, sf_dir):
    return upsert.upsert(*_split(spark, sf_dir), ["c_custkey"], {}, F.col("c_nationkey") < 10)


def update_from_aggregate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum(F.col("l_quantity")), 2).alias("o_totalprice"))
    return upsert.update_from(orders, sums, ["o_orderkey"], ["o_totalprice"])


def delete_using(spark, sf_dir):
    gone = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return upsert.delete_using(table(spark, sf_dir, "orders"), gone, ["o_orderkey"]).select("o_orderkey", "o_custkey")


def set_difference(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    key = ["o_custkey", "o_orderpriority"]
    return orders.where("o_orderstatus = 'F'").select(key).distinct().join(orders.where("o_orderstatus = 'O'").select(key), key, "left_anti")


def group_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("orders"))


def page_fields(spark, sf_dir):
    """Title, first link and language of each page, by the first pattern that fits."""
    found = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    title = F.coalesce(found(r"<title>([^<]*)</title>"), found(r"<h1>([^<]*)</h1>"), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.coalesce(found('href="([^"]*)"'), F.lit("")).alias("link"), F.coalesce(found('lang="([a-z]+)"'), F.lit("")).alias("lang"))


def categories(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ft.first_category(F.col("text"), CATEGORIES).alias("category"))


def allowed_edges(spark, sf_dir):
    rows = edges(spark, sf_dir).withColumn("predicate", F.when(F.col("predicate") == "A", "AGREE_WITH").when(F.col("predicate") == "N", "GOVERNS").otherwise("OTHER"))
    return rows.withColumn("predicate", graph.remapped(F.col("predicate"), v.PREDICATES, v.PREDICATE_REMAPS)).where("predicate is not null").groupBy("predicate").agg(F.count("*").alias("edges"))


def json_rows(spark, sf_dir):
    """Turns of conversations exploded from JSON texts of all turns, those whose object has the key ``said`` (absent where a turn is odd)."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.when(F.col("turn") % 2 == 0, F.col("text")).alias("said"))))
    texts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(turns.alias("turns"))).alias("j"))
    items = jsonrows.exploded(texts, "j", "$.turns").where(jsonrows.has_key(F.col("item"), "said"))
    return items.select("conv_id", F.col("place").cast("long").alias("place"), jsonrows.value_at(F.col("item"), "$.role").alias("role"), F.length(jsonrows.value_at(F.col("item"), "$.said")).cast("long").alias("size"))


def versioned_changes(spark, sf_dir):
    """Orders after three changes of a versioned table: all put in, those of one status repriced, those of one priority deleted."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_totalprice").cast("double").alias("price"))
    made = versioned.VersionedTable.create(spark, f"{Workspace(spark, 'versioned').root}/orders", orders.schema, ["o_orderkey"], 16)
    made.merge(orders)
    for _ in range(2):
        # the second time counts for nothing
        made.merge(orders.where("o_orderstatus = 'F'").withColumn("price", F.col("price") + 1000), source="reprice", number=1)
    made.delete(orders.where("o_orderpriority = '5-LOW'"))
    return made.read().select("o_orderkey", "o_orderstatus", F.round("price", 2).alias("price"))


def joined_components(spark, sf_dir):
    """Components of all links, which are added in four steps to labels that are kept."""
    workspace = Workspace(spark, "increments")
    every = workspace.save(links(spark, sf_dir), by=["step"])
    labels = spark.createDataFrame([], "node long, component long")
    for step in ("R", "C", "A", "N"):
        changed = workspace.save(add_links(labels, every.where(F.col("step") == step), "a", "b", workspace))
        labels = workspace.save(labels.join(changed.select("node"), "node", "left_anti").unionByName(changed))
    return labels


QUERIES = {
    "json_array_rows": json_rows,
    "versioned_changes": versioned_changes,
    "incremental_components": joined_components,
    "anti_join_unmatched": unmatched,
    "semi_endpoint_filter": endpoint_filter,
    "range_override_join": range_override,
    "nearest_date_band": nearest_dates,
    "order_paper_decisions": order_paper_decisions,
    "kth_occurrence_join": kth_occurrence,
    "array_posexplode_remap": remap_arrays,
    "tiered_resolution": tiers,
    "insert_if_absent": insert_if_absent,
    "upsert_latest": upsert_latest,
    "coalesce_upsert": coalesce_upsert,
    "conditional_upsert": conditional_upsert,
    "update_from_agg": update_from_aggregate,
    "delete_using": delete_using,
    "set_diff": set_difference,
    "group_counts": group_counts,
    "html_fields": page_fields,
    "category_keyword": categories,
    "remap_allowlist": allowed_edges,
}

_SPLIT = """WITH rows AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS c_mktsegment FROM customer),
o AS (SELECT * FROM rows WHERE c_custkey % 3 <> 0),
n AS (SELECT c_custkey, upper(c_name) AS c_name, c_nationkey, CASE WHEN c_custkey % 5 > 0 THEN lower(c_mktsegment) END AS c_mktsegment FROM rows WHERE c_custkey % 3 <> 1)"""
_RANKED = """WITH v AS (SELECT *, coalesce(uploaded, said) AS base FROM (SELECT o_orderkey AS video, CASE o_orderkey % 3 WHEN 0 THEN 'house' WHEN 1 THEN 'senate' ELSE '' END AS room, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderdate AS DATE) END AS uploaded,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER) END AS said FROM orders WHERE o_orderpriority = '2-HIGH')),
p AS (SELECT o_orderkey AS paper, CAST(o_orderdate AS DATE) AS sitting, CASE WHEN o_orderkey % 2 = 0 THEN 'house' ELSE 'senate' END AS session FROM orders WHERE o_orderpriority = '1-URGENT'),
near AS (SELECT v.*, p.*, abs(date_diff('day', sitting, base)) AS day_delta FROM v JOIN p ON sitting BETWEEN base - 7 AND base + 7
  UNION ALL SELECT v.*, p.*, NULL FROM v, (SELECT * FROM p ORDER BY paper LIMIT 25) p WHERE base IS NULL),
few AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY video ORDER BY day_delta, paper) <= 25),
scored AS (SELECT *, CAST(least(100, CASE WHEN day_delta = 0 THEN 55 WHEN day_delta = 1 THEN 35 WHEN day_delta <= 3 THEN 20 WHEN day_delta <= 7 THEN 8 ELSE 0 END + CASE WHEN said = sitting THEN 35 WHEN abs(date_diff('day', said, sitting)) = 1 THEN 20
  WHEN abs(date_diff('day', said, sitting)) <= 3 THEN 8 ELSE 0 END + CASE WHEN room = session THEN 10 ELSE 0 END) AS BIGINT) AS points FROM few),
ranked AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY points DESC, day_delta, paper) AS rank FROM scored QUALIFY rank <= 5)"""
SQL = {
    "json_array_rows": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS place, role, length(text) AS size FROM conversations QUALIFY turn % 2 = 0 AND text IS NOT NULL",
    "versioned_changes": "SELECT o_orderkey, o_orderstatus, round(CAST(o_totalprice AS DOUBLE) + CASE WHEN o_orderstatus = 'F' THEN 1000 ELSE 0 END, 2) AS price FROM orders WHERE o_orderpriority <> '5-LOW'",
    "incremental_components": f"WITH RECURSIVE {REACH} SELECT node, component FROM parts",
    "anti_join_unmatched": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "semi_endpoint_filter": """SELECT 'e-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, 'c' || o_custkey AS source_id, 'p' || l_partkey AS target_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)""",
    "range_override_join": """SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 AND turn BETWEEN 2 AND 4 AND role = 'user' THEN 'guest' WHEN conv_id % 3 = 0 AND turn BETWEEN 1 AND 2 THEN 'moderator' ELSE role END AS role FROM conversations""",
    "nearest_date_band": f"{_RANKED} SELECT video, paper, coalesce(day_delta, -1) AS day_delta, points, rank, CASE WHEN points >= 75 THEN 'high' WHEN points >= 60 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN points >= 75 THEN 'auto_matched' ELSE 'needs_review' END AS status FROM ranked",
    "order_paper_decisions": f"""{_RANKED} SELECT video, coalesce(min(paper) FILTER (rank = 1), -1) AS paper, coalesce(max(points) FILTER (rank = 1), 0) AS points, CASE WHEN max(points) >= 75 THEN 'high' WHEN max(points) >= 60 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN max(points) >= 75 THEN 'auto_matched' ELSE 'needs_review' END AS status, coalesce(string_agg(paper, ',' ORDER BY rank), '') AS candidates FROM v LEFT JOIN ranked USING (video) GROUP BY video""",
    "kth_occurrence_join": """WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_linenumber > 3 ORDER BY l_orderkey, l_linenumber, l_partkey) AS occurrence FROM lineitem),
a AS MATERIALIZED (SELECT l_suppkey, l_returnflag, occurrence, l_orderkey AS left_order FROM x WHERE l_linenumber <= 3), b AS MATERIALIZED (SELECT l_suppkey, l_returnflag, occurrence, l_orderkey AS right_order FROM x WHERE l_linenumber > 3)
SELECT l_suppkey, l_returnflag, occurrence, left_order, right_order FROM a JOIN b USING (l_suppkey, l_returnflag, occurrence)""",
    "array_posexplode_remap": """SELECT l_orderkey, string_agg(CASE WHEN l_partkey % 2 = 0 THEN p_brand ELSE CAST(l_partkey AS VARCHAR) END, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""",
    "tiered_resolution": """SELECT o_orderkey, CAST(CASE WHEN a.c_custkey IS NOT NULL THEN a.c_nationkey WHEN b.c_custkey IS NOT NULL THEN b.c_nationkey ELSE -1 END AS BIGINT) AS nation, CAST(CASE WHEN a.c_custkey IS NOT NULL THEN 0 WHEN b.c_custkey IS NOT NULL THEN 1 ELSE -1 END AS BIGINT) AS tier
FROM orders LEFT JOIN customer a ON o_custkey = a.c_custkey AND a.c_custkey % 3 = 0 LEFT JOIN customer b ON o_custkey % 100 = b.c_custkey AND b.c_custkey < 100 AND b.c_custkey % 2 = 0""",
    "insert_if_absent": f"{_SPLIT} SELECT * FROM o UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)",
    "upsert_latest": f"{_SPLIT} SELECT * FROM n UNION ALL SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n)",
    "coalesce_upsert": f"""{_SPLIT} SELECT c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(o.c_nationkey, n.c_nationkey) AS c_nationkey, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment FROM o FULL JOIN n USING (c_custkey)""",
    "conditional_upsert": f"""{_SPLIT} SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o WHERE c_nationkey < 10) UNION ALL SELECT * FROM o WHERE c_nationkey < 10 OR c_custkey NOT IN (SELECT c_custkey FROM n)""",
    "update_from_agg": """SELECT o_orderkey, coalesce(s, round(o_totalprice, 2)) AS o_totalprice FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    "delete_using": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "set_diff": "SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'",
    "group_counts": "SELECT o_orderstatus, o_orderpriority, count(*) AS orders FROM orders GROUP BY ALL",
    "html_fields": """SELECT page_id, CASE WHEN regexp_matches(html, '<title>[^<]+</title>') THEN regexp_extract(html, '<title>([^<]*)</title>', 1) ELSE regexp_extract(html, '<h1>([^<]*)</h1>', 1) END AS title,
  regexp_extract(html, 'href="([^"]*)"', 1) AS link, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang FROM pages""",
    "category_keyword": """SELECT doc_id, CASE WHEN lower(text) LIKE '%license%' OR lower(text) LIKE '%apache%' OR lower(text) LIKE '%gnu%' THEN 'license' WHEN contains(text, '@') OR lower(text) LIKE '%token%' THEN 'contact'
  WHEN contains(text, ' | ') THEN 'table' ELSE 'other' END AS category FROM documents""",
    "remap_allowlist": """SELECT CASE l_returnflag WHEN 'A' THEN 'AGREES_WITH' ELSE 'GOVERNS' END AS predicate, count(*) AS edges FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('A', 'N') GROUP BY 1""",
}
