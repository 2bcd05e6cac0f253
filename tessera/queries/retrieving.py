"""Search, fusion, trends and roll-ups over embeddings, documents, benchmark and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import score
from tessera.functions import text as ft
from tessera.functions import vocabulary as v
from tessera.operators import cells, quality_reports, retrieval, selection, sequence
from tessera.queries.tables import edges, table

TERMS = ["the", "and", "of"]
_TOKENS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"
_RANK = f"""(SELECT doc_id, round((len(list_filter(w, lambda x: x = 'the')) + len(list_filter(w, lambda x: x = 'and')) + len(list_filter(w, lambda x: x = 'of'))) / (1 + ln(greatest(len(w), 1))), 6) AS rank
  FROM (SELECT doc_id, {_TOKENS} AS w FROM documents) WHERE list_has_all(w, ['the', 'and', 'of']))"""
_NEAR = """(SELECT e.vec_id, 1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS d
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""


def vector_topk(spark, sf_dir):
    """The 20 nearest rows to every row whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    found = cells.nearest_of_each(rows, asked, "vec_id", "embedding", 20)
    return found.select("query", "vec_id", F.round("distance", 6).alias("distance"))


def vector_cells(spark, sf_dir):
    """The 10 nearest rows to every row whose id is divisible by 20, by an index of k-means cells and their bounds."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    found = cells.nearest_of_each(rows, asked, "vec_id", "embedding", 10, None)
    return found.select("query", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def _near_first(spark, sf_dir, k):
    rows = table(spark, sf_dir, "embeddings")
    return retrieval.vector_topk(rows, "vec_id", "embedding", rows.where("vec_id = 0").first()["embedding"], k)


def lexical_match_rank(spark, sf_dir):
    return retrieval.lexical_search(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS).select("doc_id", F.round("rank", 6).alias("rank"))


def rrf_fusion(spark, sf_dir):
    near = _near_first(spark, sf_dir, 40).select(F.col("vec_id").alias("doc_id"), "distance")
    full = retrieval.lexical_search(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS).withColumn("rank", F.round("rank", 6))
    channels = [retrieval.in_rank_order(near, "vector", [F.round("distance", 6)], "doc_id", 40), retrieval.in_rank_order(full, "fulltext", [-F.col("rank")], "doc_id", 40)]
    return retrieval.fuse(channels, "doc_id").select("doc_id", F.array_join("channels", ",").alias("channels"), F.round("fused", 6).alias("fused"))


def boosted_fusion(spark, sf_dir):
    """Documents' texts with fused scores by id, boosted for a topical query."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.array("source").alias("aliases"), (1 / (60 + F.col("doc_id") % 40 + 1)).alias("fused"))
    found = retrieval.boosted(rows, "text", "aliases", ft.query_intent(F.lit("latest bill on the road tax, the bus and src0")))
    return found.select("doc_id", F.round("score", 6).alias("score"))


def hybrid_score_cap(spark, sf_dir):
    docs = retrieval.lexical_search(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS).withColumn("rank", F.round("rank", 6)).join(table(spark, sf_dir, "labels"), "doc_id")
    points = F.round(score.bill_score(F.lit(0.5), F.col("rank") / 100, F.col("quality") == 1), 6)
    return retrieval.capped_excerpts(docs, "source", points, "doc_id", 2, 25).select("doc_id", "source", "score")


def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(ft.query_terms(F.col("text"), v.QUERY_STOPWORDS), " ").alias("terms"))


def _views(spark, sf_dir):
    return retrieval.daily_mentions(table(spark, sf_dir, "events").where("event_type = 'view'"), F.to_date("ts"), "user_id")


def trend_daily(spark, sf_dir):
    return _views(spark, sf_dir).withColumn("day", F.col("day").cast("string"))


def trend_summary(spark, sf_dir):
    found = retrieval.trend_summary(_views(spark, sf_dir)).withColumn("mean", F.round("mean", 6))
    return found.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day", "peak_day")})


def temporal_filter(spark, sf_dir):
    from tessera.operators.matching import date_between

    events = table(spark, sf_dir, "events").where(date_between(F.to_date("ts"), "2024-01-05", "2024-01-20") & F.col("event_type").isin("error", "purchase"))
    return events.join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey")).select("event_id", "event_type", "c_name", F.round("value", 6).alias("value"))


def speaker_rollup(spark, sf_dir):
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.groupBy("c_custkey", "c_name").agg(F.min("o_orderdate").cast("string").alias("first_seen"), F.count_distinct("o_orderkey").alias("appearances"))


def voice_conflict(spark, sf_dir):
    found = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("speakers"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("names"))
    return found.where("speakers > 1")


def percentiles(spark, sf_dir):
    found = selection.percentiles(table(spark, sf_dir, "events"), ["event_type"], F.col("value"), {"p50": 0.5, "p95": 0.95})
    return found.select("event_type", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("p50", "p95")])


def benchmark_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("elapsed_s"), (F.col("l_discount") < 0.09).alias("parse_success"), F.col("l_linenumber").cast("long").alias("total_tokens"))
    found = quality_reports.run_rollup(rows, ["l_returnflag", "l_linestatus"])
    return found.select("l_returnflag", "l_linestatus", "windows", "successes", "tokens", *[F.round(c, 6).alias(c) for c in ("success_rate", "elapsed_avg", "elapsed_p50", "elapsed_p95", "elapsed_max")])


def signature_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.concat_ws("-", F.col("l_partkey").cast("string"), "l_linestatus").alias("s"))
    return quality_reports.overlap(rows, "l_returnflag", "s").withColumn("jaccard", F.round("jaccard", 6))


def json_props(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.where("k is not null and k >= 50").groupBy("event_type").agg(F.count("*").alias("events"), F.sum("k").alias("total"))


def running_index(spark, sf_dir):
    found = retrieval.grouped_sources(table(spark, sf_dir, "conversations").withColumn("pos", F.col("conv_id") * 1000 + F.col("turn")), "role", "pos", ["conv_id", "turn"])
    return found.select("conv_id", "turn", "role", F.col("number").cast("long").alias("number"))


def best_score_dedupe(spark, sf_dir):
    hits = table(spark, sf_dir, "events").select("user_id", "event_id", F.round("value", 6).alias("value"))
    found = retrieval.merge_hits(hits, "user_id", "value", "event_id")
    return found.select("user_id", "value", F.col("event_id").alias("first_place"))


def validation_issues(spark, sf_dir):
    rules = {"low_confidence": F.col("confidence") < 0.92, "no_time": F.col("earliest_seconds") > 6, "predicate": F.col("predicate") == "R"}
    return quality_reports.issues(edges(spark, sf_dir), "id", rules).groupBy("issue").agg(F.count("*").alias("edges"))


def top_roles(spark, sf_dir):
    """Each customer's order of highest priority, then latest."""
    orders = table(spark, sf_dir, "orders")
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    best = sequence.top_per_group(orders, ["o_custkey"], [rank, F.desc("o_orderdate"), F.col("o_orderkey")])
    return table(spark, sf_dir, "customer").join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_orderpriority")


QUERIES = {
    "vector_topk": vector_topk,
    "vector_cells": vector_cells,
    "lexical_match_rank": lexical_match_rank,
    "rrf_fusion": rrf_fusion,
    "rrf_boosts": boosted_fusion,
    "hybrid_score_cap_per_group": hybrid_score_cap,
    "query_terms": query_terms,
    "trend_daily": trend_daily,
    "trend_summary": trend_summary,
    "temporal_filter": temporal_filter,
    "speaker_rollup": speaker_rollup,
    "voice_conflict": voice_conflict,
    "percentiles": percentiles,
    "benchmark_rollup": benchmark_rollup,
    "signature_overlap": signature_overlap,
    "json_props_filter": json_props,
    "global_running_index": running_index,
    "best_score_dedupe": best_score_dedupe,
    "validation_issues": validation_issues,
    "top1_by_priority": top_roles,
}

_STOP = ", ".join(f"'{w}'" for w in v.QUERY_STOPWORDS)
_DAILY = "(SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS mentions FROM events WHERE event_type = 'view' GROUP BY 1)"
SQL = {
    "vector_topk": """SELECT query, vec_id, round(d, 6) AS distance FROM (SELECT q.vec_id AS query, e.vec_id, 1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS d
  FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) QUALIFY row_number() OVER (PARTITION BY query ORDER BY d, vec_id) <= 20""",
    "vector_cells": """SELECT query, vec_id, round(d, 6) AS distance, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS rank FROM (SELECT q.vec_id AS query, e.vec_id, 1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS d
  FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) QUALIFY rank <= 10""",
    "rrf_boosts": r"""SELECT doc_id, round(1 / (60 + doc_id % 40 + 1) + 0.03 + 0.1 * least(len(list_intersect(w, ['road', 'tax', 'bus'])), 3) + CASE WHEN contains(t, 'road') OR contains(t, 'tax') OR contains(t, 'bus') THEN 0.05 ELSE 0 END
  - CASE WHEN len(list_intersect(w, ['road', 'tax', 'bus'])) = 0 THEN 0.05 ELSE 0 END, 6) AS score FROM (SELECT doc_id, t, list_distinct(regexp_extract_all(regexp_replace(t, '[^[:ascii:]]', '_', 'g'), '\b[a-z][a-z0-9-]{2,}\b')) AS w FROM (SELECT doc_id, lower(concat_ws(' ', text, source)) AS t FROM documents))""".replace("\\\\", "\\"),
    "lexical_match_rank": f"SELECT doc_id, rank FROM {_RANK}",
    "rrf_fusion": f"""WITH ranked AS (
  (SELECT vec_id AS doc_id, 'vector' AS channel, row_number() OVER (ORDER BY round(d, 6), vec_id) AS r FROM (SELECT * FROM {_NEAR} ORDER BY d, vec_id LIMIT 40))
  UNION ALL (SELECT * FROM (SELECT doc_id, 'fulltext' AS channel, row_number() OVER (ORDER BY rank DESC, doc_id) AS r FROM {_RANK}) WHERE r <= 40))
SELECT doc_id, string_agg(channel, ',' ORDER BY channel) AS channels, round(sum(1 / (60 + r)), 6) AS fused FROM ranked GROUP BY doc_id""",
    "hybrid_score_cap_per_group": f"""WITH scored AS (SELECT doc_id, source, round(0.75 * 0.5 + 0.25 * least(rank / 100, 1.0) + CASE WHEN quality = 1 THEN 0.08 ELSE 0 END, 6) AS score
  FROM {_RANK} JOIN labels USING (doc_id) JOIN documents USING (doc_id))
SELECT doc_id, source, score FROM scored QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) <= 2 ORDER BY score DESC, doc_id LIMIT 25""",
    "query_terms": rf"""SELECT item_id, coalesce(string_agg(t, ' ' ORDER BY p), '') AS terms FROM (
  SELECT item_id, t, min(p) AS p FROM (SELECT item_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM (SELECT item_id, list_transform(regexp_extract_all(regexp_replace(text, '[^[:ascii:]]', '_', 'g'), '\b[a-zA-Z][a-zA-Z0-9-]{{2,}}\b'), lambda x: lower(x)) AS w FROM benchmark))
  WHERE t NOT IN ({_STOP}) GROUP BY ALL) RIGHT JOIN (SELECT item_id FROM benchmark) USING (item_id) GROUP BY item_id""",
    "trend_daily": f"SELECT CAST(day AS VARCHAR) AS day, mentions FROM {_DAILY}",
    "trend_summary": f"""SELECT CAST(sum(mentions) AS BIGINT) AS total, round(sum(mentions) / count(*), 6) AS mean, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, max(mentions) AS peak,
  (SELECT CAST(day AS VARCHAR) FROM {_DAILY} ORDER BY mentions DESC, day LIMIT 1) AS peak_day FROM {_DAILY}""",
    "temporal_filter": """SELECT event_id, event_type, c_name, round(value, 6) AS value FROM events JOIN customer ON user_id = c_custkey
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND event_type IN ('error', 'purchase')""",
    "speaker_rollup": """SELECT c_custkey, c_name, CAST(min(o_orderdate) AS VARCHAR) AS first_seen, count(DISTINCT o_orderkey) AS appearances
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL""",
    "voice_conflict": "SELECT user_id, count(DISTINCT event_type) AS speakers, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1",
    "percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
    "benchmark_rollup": """SELECT l_returnflag, l_linestatus, count(*) AS windows, count(*) FILTER (l_discount < 0.09) AS successes, CAST(sum(l_linenumber) AS BIGINT) AS tokens,
  round(count(*) FILTER (l_discount < 0.09) / count(*), 6) AS success_rate, round(avg(l_quantity) FILTER (l_quantity > 0), 6) AS elapsed_avg,
  round(quantile_cont(l_quantity, 0.5) FILTER (l_quantity > 0), 6) AS elapsed_p50, round(quantile_cont(l_quantity, 0.95) FILTER (l_quantity > 0), 6) AS elapsed_p95,
  round(max(l_quantity), 6) AS elapsed_max FROM lineitem GROUP BY ALL""",
    "signature_overlap": """WITH s AS (SELECT DISTINCT l_returnflag AS m, l_partkey || '-' || l_linestatus AS s FROM lineitem), n AS (SELECT m, count(*) AS n FROM s GROUP BY m)
SELECT a.m AS model_a, b.m AS model_b, shared, a.n - shared AS only_a, b.n - shared AS only_b, round(shared / (a.n + b.n - shared), 6) AS jaccard
FROM n a JOIN n b ON a.m < b.m, LATERAL (SELECT count(*) AS shared FROM s x JOIN s y USING (s) WHERE x.m = a.m AND y.m = b.m)""",
    "json_props_filter": """SELECT event_type, count(*) AS events, CAST(sum(k) AS BIGINT) AS total FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k >= 50 GROUP BY event_type""",
    "global_running_index": """SELECT conv_id, turn, role, row_number() OVER (ORDER BY g, role, conv_id, turn) AS number
FROM (SELECT *, min(conv_id * 1000 + turn) OVER (PARTITION BY role) AS g FROM conversations)""",
    "best_score_dedupe": "SELECT user_id, max(round(value, 6)) AS value, min(event_id) AS first_place FROM events GROUP BY user_id",
    "validation_issues": """SELECT issue, count(*) AS edges FROM (SELECT unnest([CASE WHEN round(1 - l_discount, 6) < 0.92 THEN 'low_confidence' END, CASE WHEN l_linenumber > 6 THEN 'no_time' END,
  CASE WHEN l_returnflag = 'R' THEN 'predicate' END]) AS issue FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE issue IS NOT NULL GROUP BY issue""",
    "top1_by_priority": """SELECT c_custkey, o_orderkey, o_orderpriority FROM customer LEFT JOIN (
  SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderpriority[1] AS INTEGER), o_orderdate DESC, o_orderkey) = 1) ON c_custkey = o_custkey""",
}
