"""From extracted triples and base tables to graph nodes, aliases and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as ft
from tessera.functions import vocabulary as v
from tessera.operators import upsert
from tessera.plans.workspace import Workspace

PAYLOAD = """struct<nodes_new:array<struct<temp_id:string,type:string,label:string,aliases:array<string>>>,
edges:array<struct<source_ref:string,predicate:string,target_ref:string,evidence:string,utterance_ids:array<string>,confidence:double>>>"""


def parse_payloads(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """``answers`` with ``payload`` (null if it isn't JSON of that shape) and ``parse_success``."""
    payload = F.from_json(ft.fenced_json(F.col(answer)), PAYLOAD)
    return answers.withColumn("payload", payload).withColumn("parse_success", F.col("payload.nodes_new").isNotNull() | F.col("payload.edges").isNotNull())


def canonicalize(payloads: DataFrame, sentences: DataFrame, known: DataFrame, workspace: Workspace | None = None) -> dict[str, DataFrame]:
    """Nodes, aliases and edges of the windows' payloads.

    Payload rows have video_id, window_index and payload; sentences id and
    seconds_since_start; ``known`` has the ids of existing nodes.  A reference is a
    temporary id of the same window or an existing node's id; edges with another,
    with a predicate outside the list, or without utterances are left out.  An
    edge's time is that of the earliest sentence that it cites.
    """
    # payloads are read twice and their nodes four times: each is made once
    workspace = workspace or Workspace(payloads.sparkSession, "canonical")
    payloads = workspace.save(payloads.select("video_id", "window_index", "payload"))
    new = payloads.select("video_id", "window_index", F.explode("payload.nodes_new").alias("n")).select("video_id", "window_index", "n.*")
    new = new.where("label is not null and trim(label) <> ''").withColumn("id", ft.node_id(F.col("type"), F.col("label")))
    # equal proposals are one before they are put in order
    different = new.select("id", "type", "label", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")).distinct()
    nodes = workspace.save(upsert.first_of_each(different, ["id"], [F.col("label")]))
    every = F.array_union(F.array(F.col("label")), F.col("aliases"))
    aliases = nodes.select(F.explode(every).alias("a"), F.col("id").alias("node_id")).select(ft.normalize_label(F.col("a")).alias("alias_norm"), "node_id").where("alias_norm <> ''").distinct()
    refs = new.select("video_id", "window_index", F.col("temp_id").alias("ref"), "id").dropDuplicates(["video_id", "window_index", "ref"])
    exists = known.select("id").union(nodes.select("id")).distinct()
    rows = payloads.select("video_id", "window_index", F.explode("payload.edges").alias("e")).select("video_id", "window_index", "e.*").where(F.col("predicate").isin(v.PREDICATES) & (F.size("utterance_ids") > 0))
    for end in ("source", "target"):
        named = refs.select("video_id", "window_index", F.col("ref").alias(f"{end}_ref"), F.col("id").alias("_i"))
        rows = rows.join(named, ["video_id", "window_index", f"{end}_ref"], "left").withColumn(f"{end}_id", F.coalesce("_i", f"{end}_ref")).drop("_i")
        rows = rows.join(exists.select(F.col("id").alias(f"{end}_id")), f"{end}_id", "left_semi")
    rows = rows.withColumn("id", ft.edge_id(F.col("source_id"), F.col("predicate"), F.col("target_id"), F.col("video_id"), F.array_join(F.array_sort("utterance_ids"), ",")))
    rows = upsert.first_of_each(rows, ["id"], [F.desc_nulls_last("confidence"), F.col("window_index")])
    cited = rows.select("id", F.explode("utterance_ids").alias("u")).join(sentences.select(F.col("id").alias("u"), "seconds_since_start"), "u").groupBy("id").agg(F.min("seconds_since_start").alias("earliest_seconds"))
    edges = rows.join(cited, "id", "left").select("id", "source_id", "predicate", "target_id", F.col("video_id").alias("youtube_video_id"), "earliest_seconds", ft.to_timestamp_text(F.col("earliest_seconds")).alias("earliest_timestamp_str"), "evidence", "utterance_ids", "confidence")
    return {"nodes": nodes, "aliases": aliases, "edges": edges}


def seed_graph(speakers: DataFrame, items: DataFrame, bills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, aliases) of speakers (id, name), order-paper items (title) and bills (title, bill_number)."""
    people = speakers.select(F.concat(F.lit("speaker_"), F.col("id")).alias("id"), F.lit("foaf:Person").alias("type"), F.col("name").alias("label"), F.array_distinct(F.array(F.col("name"), ft.strip_honorifics(F.col("name")))).alias("aliases"))
    topics = items.where("title is not null and title <> ''").select(ft.node_id(F.lit("skos:Concept"), F.col("title")).alias("id"), F.lit("skos:Concept").alias("type"), F.col("title").alias("label"), F.array("title").alias("aliases"))
    laws = bills.where("title is not null and title <> ''").select(ft.node_id(F.lit("schema:Legislation"), F.col("title")).alias("id"), F.lit("schema:Legislation").alias("type"), F.col("title").alias("label"), F.array_compact(F.array(F.col("title"), F.col("bill_number"))).alias("aliases"))
    nodes = upsert.first_of_each(people.union(topics).union(laws), ["id"], [F.col("label")])
    aliases = nodes.select(F.explode("aliases").alias("a"), F.col("id").alias("node_id")).select(ft.normalize_label(F.col("a")).alias("alias_norm"), "node_id").where("alias_norm <> ''").distinct()
    return nodes, aliases


def payload_issues(payloads: DataFrame) -> DataFrame:
    """(video_id, window_index, issue): structural and referential faults of payloads."""
    ids = F.transform("payload.nodes_new", lambda n: n["temp_id"])
    edges = F.coalesce("payload.edges", F.array().cast(PAYLOAD.split("edges:")[1].rsplit(">", 1)[0]))
    some = lambda test: F.exists(edges, test)
    temporary = lambda r: r.rlike("^n[0-9]+$") & ~F.array_contains(F.coalesce(ids, F.array().cast("array<string>")), r)
    rules = {
        "no_payload": F.col("payload").isNull(),
        "node_type": F.exists(F.coalesce(F.transform("payload.nodes_new", lambda n: n["type"]), F.array().cast("array<string>")), lambda t: ~F.coalesce(t.isin(v.NODE_TYPES), F.lit(False))),
        "duplicate_temp_id": F.size(ids) != F.size(F.array_distinct(ids)),
        "predicate": some(lambda e: ~F.coalesce(e["predicate"].isin(v.PREDICATES), F.lit(False))),
        "confidence": some(lambda e: (e["confidence"] < 0) | (e["confidence"] > 1)),
        "no_utterances": some(lambda e: F.coalesce(F.size(e["utterance_ids"]), F.lit(0)) <= 0),
        "unknown_reference": some(lambda e: temporary(e["source_ref"]) | temporary(e["target_ref"])),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return payloads.select("video_id", "window_index", F.explode(broken).alias("issue"))


def merge_delta(base: DataFrame, delta: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of windows' first answers with what their second answers add and delete.

    ``base`` has key and payload; ``delta`` key and payload with nodes_new_add,
    edges_add and edges_delete.  An added temporary id that the window has already
    becomes ``a<n>`` with the first free numbers; edges that are added follow it.
    Deleted are edges of the base with the same source, predicate and target.
    """
    old = base.select(*key, F.posexplode("payload.nodes_new").alias("place", "n")).select(*key, "place", "n.*")
    add = delta.select(*key, F.posexplode("payload.nodes_new_add").alias("place", "n")).select(*key, "place", "n.*")
    taken = old.select(*key, "temp_id").distinct()
    clash = add.join(taken.withColumn("_t", F.lit(True)), [*key, "temp_id"], "left")
    first = F.row_number().over(Window.partitionBy(*key, "temp_id").orderBy("place"))
    clash = clash.withColumn("_c", F.coalesce("_t", F.lit(False)) | (first > 1))
    used = taken.union(clash.where("not _c").select(*key, "temp_id")).distinct().groupBy(*key).agg(F.collect_set("temp_id").alias("_used"))
    n = F.row_number().over(Window.partitionBy(*key).orderBy("place"))
    fresh = clash.where("_c").withColumn("_n", n).join(used, key, "left")
    # among as many numbers as there are used ids and clashes, enough are free
    free = F.filter(F.transform(F.sequence(F.lit(1), F.size("_used") + F.col("_n")), lambda i: F.concat(F.lit("a"), i.cast("string"))), lambda a: ~F.array_contains(F.col("_used"), a))
    fresh = fresh.withColumn("new_id", F.element_at(free, F.col("_n")))
    renamed = clash.where("not _c").withColumn("new_id", F.col("temp_id")).unionByName(fresh.select(*clash.columns, "new_id"))
    last = renamed.groupBy(*key, F.col("temp_id").alias("ref")).agg(F.max_by("new_id", "place").alias("to"))
    nodes = old.withColumn("pass", F.lit(1)).unionByName(renamed.withColumn("temp_id", F.col("new_id")).select(*old.columns).withColumn("pass", F.lit(2)))
    gone = delta.select(*key, F.explode("payload.edges_delete").alias("d")).select(*key, *[F.coalesce(f"d.{c}", F.lit("")).alias(c) for c in ("source_ref", "predicate", "target_ref")]).distinct()
    kept = base.select(*key, F.explode("payload.edges").alias("e")).select(*key, "e.*").join(gone, [*key, "source_ref", "predicate", "target_ref"], "left_anti")
    new = delta.select(*key, F.explode("payload.edges_add").alias("e")).select(*key, "e.*")
    for end in ("source_ref", "target_ref"):
        new = new.join(last.withColumnRenamed("ref", end), [*key, end], "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return nodes, kept.withColumn("pass", F.lit(1)).unionByName(new.select(*kept.columns).withColumn("pass", F.lit(2)))
