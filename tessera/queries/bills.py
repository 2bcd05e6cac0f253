"""Bill excerpts, order papers with labels, cited sentences and what hangs on deleted rows, over documents, vectors, conversations and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import bills, retrieval, search, sequence, upsert
from tessera.queries.tables import table
from tessera.sources import readers


def _excerpts(spark, sf_dir):
    """Vectors with the texts of the documents of their ids as excerpts of bills, which are the vectors' labels."""
    both = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "documents"), F.col("vec_id") == F.col("doc_id"))
    page = F.when(F.col("vec_id") % 3 > 0, F.col("vec_id") % 3).cast("int")
    rows = both.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("bill_id"), F.col("vec_id").alias("chunk_index"), "text", F.lit("http://b/x.pdf").alias("source_url"), page.alias("page_number"), "embedding", "n_chars")
    known = rows.select(F.col("bill_id").alias("id"), F.concat(F.lit("HR"), "bill_id").alias("bill_number"), F.lit(None).cast("string").alias("title")).distinct()
    return rows, known


def bill_excerpts(spark, sf_dir):
    rows, known = _excerpts(spark, sf_dir)
    vector = rows.where("id = 0").first()["embedding"]
    ranks = rows.select("id", (F.col("n_chars") % 10 / 10).alias("rank"))
    seeds = spark.createDataFrame([("2",), ("3",)], "id string")
    found = bills.excerpts_for(rows.drop("n_chars"), known, "The tion and ing for laws", vector, ranks, seeds, most=12, least=0.2, per_bill=3)
    return found.select("citation_id", "bill_number", "source_url", F.array_join("matched_terms", ",").alias("terms"), F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


def cited_excerpts(spark, sf_dir):
    """Excerpts cited by every vector's id, twice and in falling order, besides citations that are none."""
    rows, known = _excerpts(spark, sf_dir)
    ids = rows.select(F.concat_ws(":", F.lit("bill"), "bill_id", "id").alias("id"), (1_000_000_000 - F.col("id")).alias("place"))
    other = rows.select(F.concat_ws(":", F.lit("other"), "bill_id", "id").alias("id"), F.col("id").alias("place"))
    found = bills.excerpts_cited(ids.union(ids.withColumn("place", F.col("place") + 1)).union(other), rows.drop("n_chars"), known)
    return found.select("citation_id", "bill_title", F.coalesce("page_number", F.lit(0)).cast("long").alias("page_number"), "place")


def labelled_papers(spark, sf_dir):
    """An order paper for each customer whose bills are its orders; some lack their date or number."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    bill = F.concat(F.lit("*   **Order "), F.col("o_orderkey").cast("string"), F.lit("**  \n    Mover: "), "c_name", F.lit("\n    Status: "), "o_orderstatus", F.lit("\n"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", bill.alias("b")))), lambda x: x["b"]), "")
    head = F.when(F.col("o_custkey") % 5 == 0, "").otherwise("**Date:** Tuesday, 3rd March, 2026  \n")
    number = F.when(F.col("o_custkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("**Order Paper Number:** No. "), F.col("o_custkey").cast("string"), F.lit("\n")))
    text = F.concat(F.lit("**Session:** First\n"), head, number, F.lit("**3. Bills on the Order Paper:**\n"), "listed", F.lit("**4. Motions**\n*   **None of these**\n"))
    papers = orders.groupBy("o_custkey").agg(listed.alias("listed")).select("o_custkey", text.alias("body"))
    items = readers.labelled_bills(papers, "o_custkey", "body")
    facts = readers.labelled_papers(papers, "o_custkey", "body").select("o_custkey", "sitting_date", "number", "error")
    found = items.join(facts, "o_custkey")
    return found.select("o_custkey", F.col("sequence").cast("long").alias("sequence"), "title", "mover", F.coalesce("action", F.lit("none")).alias("action"), "status", F.coalesce("sitting_date", F.lit("none")).alias("sitting_date"), "number", F.coalesce("error", F.lit("good")).alias("error"))


def time_ranges(spark, sf_dir):
    """Least and largest turns of conversations, and apart from them those of the turns as text."""
    rows = table(spark, sf_dir, "conversations").withColumn("stamp", (F.col("turn") + 8).cast("string"))
    return sequence.time_ranges(rows, ["conv_id"], "turn", "stamp")


def keyed_union(spark, sf_dir):
    """Documents by source, put after one another: the last one of a source in the place of the first."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("doc_id") + 1).alias("place"))
    found = retrieval.keyed_union(rows, rows.withColumn("doc_id", -F.col("doc_id")), "source", "place")
    return found.select("source", "doc_id", F.col("place").cast("long").alias("place"))


def cited_sentences(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    name = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    sentences = rows.select(name.alias("id"), F.col("conv_id").alias("speaker_id"), F.lit(None).cast("string").alias("video_title"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.when(F.col("c_custkey") % 2 == 0, F.lower("c_name")).otherwise("").alias("normalized_name"))
    ids = rows.where("role = 'user'").select(name.alias("id"))
    return search.sentences_cited(ids.union(ids), sentences, people).select("id", "video_title", F.coalesce("full_name", F.lit("-")).alias("full_name"), "normalized_name")


def cascade(spark, sf_dir):
    """What is left of orders and line items, and of suppliers' nations, after the customers of a segment and two nations are gone."""
    customer, orders, lines = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    tables = {"customer": customer, "orders": orders, "lineitem": lines}
    links = [("orders", "o_custkey", "customer", "c_custkey", "cascade"), ("lineitem", "l_orderkey", "orders", "o_orderkey", "cascade")]
    left = upsert.delete_cascading(tables, "customer", customer.where("c_acctbal < 0").select("c_custkey"), "c_custkey", links)
    nations = {"nation": table(spark, sf_dir, "nation"), "supplier": table(spark, sf_dir, "supplier")}
    emptied = upsert.delete_cascading(nations, "nation", nations["nation"].where("n_regionkey = 1").select("n_nationkey"), "n_nationkey", [("supplier", "s_nationkey", "nation", "n_nationkey", "null")])
    counts = [frame.agg(F.lit(n).alias("what"), F.count("*").alias("rows")) for n, frame in left.items()]
    counts.append(emptied["supplier"].agg(F.lit("supplier").alias("what"), F.count("s_nationkey").alias("rows")))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


QUERIES = {"bill_excerpts": bill_excerpts, "cited_excerpts": cited_excerpts, "labelled_papers": labelled_papers, "time_ranges": time_ranges, "keyed_union": keyed_union, "cited_sentences": cited_sentences, "delete_cascading": cascade}

_EXCERPTS = """e AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS bill_id, vec_id % 3 AS page, lower(text) AS low, n_chars, embedding FROM embeddings JOIN documents ON vec_id = doc_id)"""
SQL = {
    "bill_excerpts": f"""WITH {_EXCERPTS}, d AS (SELECT *, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS d FROM e),
few AS (SELECT *, list_filter(['tion', 'ing', 'laws'], lambda t: contains(low, t)) AS terms, 0.75 * (1 - least(d, 1)) + 0.25 * least(n_chars % 10 / 10, 1) + CASE WHEN bill_id IN ('2', '3') THEN 0.08 ELSE 0 END AS score
  FROM d ORDER BY d, n_chars % 10 DESC, id LIMIT 96),
kept AS (SELECT * FROM few WHERE score >= 0.2 AND len(terms) > 0 QUALIFY row_number() OVER (PARTITION BY bill_id ORDER BY d, n_chars % 10 DESC, id) <= 3)
SELECT 'bill:' || bill_id || ':' || id AS citation_id, 'HR' || bill_id AS bill_number, 'http://b/x.pdf' || CASE WHEN page > 0 THEN '#page=' || page ELSE '' END AS source_url,
  array_to_string(terms, ',') AS terms, round(score, 6) AS score, row_number() OVER (ORDER BY d, n_chars % 10 DESC, id) AS place FROM kept QUALIFY place <= 12""",
    "cited_excerpts": f"WITH {_EXCERPTS} SELECT 'bill:' || bill_id || ':' || id AS citation_id, '' AS bill_title, page AS page_number, 1000000000 - id AS place FROM e",
    "labelled_papers": """SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sequence, 'Order ' || o_orderkey AS title, c_name AS mover, 'none' AS action, o_orderstatus AS status,
  CASE WHEN o_custkey % 5 = 0 THEN 'none' ELSE '2026-03-03' END AS sitting_date, CASE WHEN o_custkey % 7 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS number,
  CASE WHEN o_custkey % 5 = 0 THEN 'no date' WHEN o_custkey % 7 = 0 THEN 'no number' ELSE 'good' END AS error FROM orders JOIN customer ON o_custkey = c_custkey""",
    "time_ranges": "SELECT conv_id, min(turn) AS start_seconds, max(turn) AS end_seconds, min(CAST(turn + 8 AS VARCHAR)) AS start_timestamp, max(CAST(turn + 8 AS VARCHAR)) AS end_timestamp FROM conversations GROUP BY conv_id",
    "keyed_union": "SELECT source, -max(doc_id) AS doc_id, row_number() OVER (ORDER BY min(doc_id), source) AS place FROM documents GROUP BY source",
    "cited_sentences": """SELECT conv_id || ':' || turn AS id, '' AS video_title, coalesce(c_name, '-') AS full_name, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) ELSE CAST(conv_id AS VARCHAR) END AS normalized_name
FROM conversations LEFT JOIN customer ON conv_id = c_custkey WHERE role = 'user'""",
    "delete_cascading": """WITH c AS (SELECT c_custkey FROM customer WHERE c_acctbal >= 0), o AS (SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))
SELECT 'customer' AS what, count(*) AS rows FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o))
UNION ALL SELECT 'supplier', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 1""",
}
