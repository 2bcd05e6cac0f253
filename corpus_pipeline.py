"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of documents.  Every stage takes empty
tables, nulls in any column and repeated rows; rows that are repeated share their
fate but for jaccard_join, which keeps one.  Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, packing, quality, shingle_join, surrogates
from tessera.llm.queries import SURROGATE_KEY
from tessera.plans.workspace import Workspace


#: Rows that are handed to Python at once in the stages, so that long texts don't pile up in an executor.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Set for the session, as the stages' results are computed after they return."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: texts go that are null, have no letter, or are too far from the nearest profile.

    Rows without a language or text teach nothing; if nothing was learned all go.
    """
    small_batches(spark)
    learning = docs.where(language.teaching() != 0)
    profiles = language.with_limits(language.learn(learning), learning)
    return language.identify(docs, profiles, only_known=True)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed limits and the trees keep.

    A null or empty text fails the limits.  Without labels of both kinds the
    limits decide alone.  A score of exactly 0.5 keeps.
    """
    small_batches(spark)
    trees = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.apply_rules(docs, trees, only_kept=True)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id (five-word shingles, Jaccard 0.8).

    Of equal ids the smaller hash of the text stays, and an id before none.
    Documents without words are near nothing, but equal rows of them count once.
    """
    small_batches(spark)
    workspace = Workspace(spark, "pipeline")
    narrow = docs.select("doc_id", shingle_join.text_key("text").alias("_hash"), "text")
    found = shingle_join.shingle_components(narrow, k=5, threshold=80, workspace=workspace)
    found = workspace.save(found.select("doc_id", "_hash", "component"))
    grouped = found.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_hash")).alias("k")).select("k.doc_id", "k._hash")
    kept = workspace.save(grouped.union(found.where("component is null").select("doc_id", "_hash")).distinct())
    few = F.broadcast(kept) if kept.count() <= shingle_join.BROADCAST_ROWS else kept
    keyed = docs.withColumn("_hash", shingle_join.text_key("text"))
    out = keyed.join(few.withColumnsRenamed({"doc_id": "_id", "_hash": "_kept"}), F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_hash").eqNullSafe(F.col("_kept")), "left_semi")
    if found.groupBy("doc_id", "_hash").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id", "_hash"])
    return out.select(docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by keyed surrogates; n_chars follows the text, and stays as it is where that is null."""
    return surrogates.replace(docs, key=SURROGATE_KEY).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences; a null text is an empty one, of its end token alone."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("jaccard_join", jaccard_join), ("pii", pii), ("packing", pack)]

#: SQL can't express the trained stages; tests/llm/test_pipeline.py checks them otherwise.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, with every stage before it written and read again."""
    workspace = Workspace(spark, "stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, workspace.save(stage(spark, docs, sf_dir))
        if at:
            workspace.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
