"""Excerpts of bills for a query: by vector and full text, by citation id, and beside a graph search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import score
from tessera.functions import text as ft
from tessera.functions import vocabulary as v
from tessera.operators import retrieval
from tessera.operators.textindex import TextIndex

#: Candidates that are looked at for each excerpt wanted, and at least.
CANDIDATES, FEWEST = 8, 24
#: Types of seed nodes that are bills.
BILL_TYPES = ["BILL", "schema:Legislation"]
#: What is shown of an excerpt, in this order.
SHOWN = ["citation_id", "bill_id", "bill_number", "bill_title", "excerpt", "source_url", "chunk_index", "page_number", "matched_terms", "score"]


def _shown(rows: DataFrame, citation: Column, terms: Column, points: Column) -> list[Column]:
    page = F.when(F.col("page_number") != 0, F.col("page_number")).cast("int")
    text = lambda c: F.coalesce(c, F.lit(""))
    return [
        citation.alias("citation_id"), F.col("bill_id"), text("bill_number").alias("bill_number"), text("title").alias("bill_title"), text("text").alias("excerpt"),
        ft.page_url(text("source_url"), page).alias("source_url"), F.col("chunk_index").cast("int").alias("chunk_index"), page.alias("page_number"), terms.alias("matched_terms"), points.cast("double").alias("score"),
    ]


def _with_bills(excerpts: DataFrame, bills: DataFrame) -> DataFrame:
    return excerpts.join(bills.select(F.col("id").alias("bill_id"), "bill_number", "title"), "bill_id")


def excerpts_for(excerpts: DataFrame, bills: DataFrame, query: str, vector: Sequence[float], ranks: DataFrame | TextIndex | None = None, seeds: DataFrame | None = None, most: int = 8, least: float = 0.35, per_bill: int = 1) -> DataFrame:
    """Excerpts (SHOWN, with ``place``) for a query and its vector, in the order of the candidates.

    Candidates are the excerpts nearest to the vector, of equal distance those of the
    better full-text rank, then the earlier ones of their bill: ``CANDIDATES`` times
    as many as are wanted.  Of these count those that score ``least``, where bills
    among ``seeds`` (column id) are boosted, and have a term of the query, if it has
    any; the first ``per_bill`` of a bill, and ``most`` in all.

    ``excerpts`` have id, bill_id, chunk_index, text, source_url, page_number and
    embedding; ``ranks`` id and rank, or an index of the excerpts' texts.
    """
    empty = _with_bills(excerpts, bills).where("false").select(*_shown(excerpts, F.lit(""), F.array().cast("array<string>"), F.lit(0.0)), F.lit(0).alias("place"))
    if not query.strip():
        return empty
    found = _with_bills(excerpts, bills).where("embedding is not null")
    found = found.withColumn("_distance", F.coalesce(score.cosine_distance(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector])), F.lit(1.0)))
    if isinstance(ranks, TextIndex):
        ranks = ranks.search(query, plain=True).withColumnRenamed(ranks.key, "id")
    if ranks is None:
        found = found.withColumn("_rank", F.lit(0.0))
    else:
        found = found.join(ranks.select("id", F.col("rank").alias("_rank")), "id", "left").fillna(0.0, ["_rank"])
    order = ["_distance", F.desc("_rank"), "chunk_index", "id"]
    few = found.orderBy(*order).limit(max(most * CANDIDATES, FEWEST))
    known = F.lit(False) if seeds is None else F.col("_seed").isNotNull()
    if seeds is not None:
        few = few.join(seeds.select(F.col("id").alias("bill_id"), F.lit(True).alias("_seed")).distinct(), "bill_id", "left")
    terms = F.lit([t for t in dict.fromkeys(ft.words_in(query)) if t not in v.QUERY_STOPWORDS] or None).cast("array<string>")
    matched = F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.contains(F.lower("text"), t))
    rows = few.withColumn("_points", score.bill_score(F.least("_distance", F.lit(1.0)), F.col("_rank"), known)).withColumn("_matched", matched)
    rows = rows.where((F.col("_points") >= least) & (terms.isNull() | (F.size("_matched") > 0)))
    # no more rows than candidates
    place = F.row_number().over(Window.partitionBy("bill_id").orderBy(*order))
    kept = rows.withColumn("_of_bill", place).where(F.col("_of_bill") <= per_bill).withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") <= most)
    return kept.select(*_shown(kept, F.concat_ws(":", F.lit("bill"), "bill_id", "chunk_index"), F.slice("_matched", 1, 6), F.col("_points")), "place")


def excerpts_cited(ids: DataFrame, excerpts: DataFrame, bills: DataFrame) -> DataFrame:
    """Excerpts (SHOWN, with ``place``) of citations ``bill:<bill>:<chunk>`` (columns id, place), each once, where it is first; others are left out."""
    parts = F.split("citation_id", ":")
    first = ids.groupBy(F.col("id").alias("citation_id")).agg(F.min("place").alias("place"))
    wanted = first.where((F.size(parts) == 3) & (F.get(parts, 0) == "bill")).select("citation_id", "place", F.get(parts, 1).alias("bill_id"), F.trim(F.get(parts, 2)).try_cast("int").alias("chunk_index")).where("chunk_index is not null")
    rows = wanted.join(_with_bills(excerpts, bills).withColumn("chunk_index", F.col("chunk_index").cast("int")), ["bill_id", "chunk_index"])
    sole = retrieval.top_per_group(rows, ["citation_id"], [F.col("id")])
    return sole.select(*_shown(sole, F.col("citation_id"), F.array().cast("array<string>"), F.lit(1.0)), "place")


def search_with_bills(nodes: DataFrame, aliases: DataFrame, edges: DataFrame, sentences: DataFrame, excerpts: DataFrame, bills: DataFrame, query: str, vector: Sequence[float], ranks: DataFrame | TextIndex | None = None, most_bills: int = 8, **options) -> dict[str, DataFrame]:
    """``retrieval.graph_search`` with ``bill_citations``: excerpts for the query, then those that the edges cite and that aren't among them, ``most_bills`` in all."""
    found = retrieval.graph_search(nodes, aliases, edges, sentences, query, vector, **options)
    seeds = found["seeds"].where(F.col("type").isin(BILL_TYPES)).select("id")
    own = excerpts_for(excerpts, bills, query, vector, ranks, seeds, most_bills).withColumn("_by", F.lit(0))
    order = Window.orderBy(F.desc_nulls_last("edge_rank_score"), F.desc_nulls_last("confidence"), F.asc_nulls_last("earliest_seconds"), "id")
    cited = found["edges"].withColumn("_e", F.row_number().over(order)).select("_e", F.posexplode("utterance_ids").alias("_p", "cited")).where(F.startswith("cited", F.lit("bill:")))
    cited = cited.select(F.col("cited").alias("id"), F.struct("_e", "_p").alias("_at")).groupBy("id").agg(F.min("_at").alias("_at"))
    cited = cited.select("id", F.row_number().over(Window.orderBy("_at")).alias("place"))
    more = excerpts_cited(cited, excerpts, bills).withColumn("_by", F.lit(1)).join(own.select("citation_id"), "citation_id", "left_anti")
    both = own.unionByName(more)
    place = F.row_number().over(Window.orderBy("_by", "place"))
    return found | {"bill_citations": both.withColumn("place", place).where(F.col("place") <= most_bills).drop("_by")}
