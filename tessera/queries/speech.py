"""Names, entities, citations, sentence search and reports, and files written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import score
from tessera.functions import text as ft
from tessera.functions import vocabulary as v
from tessera.operators import citing, entities, graph, matching, naming, quality_reports, search, sequence, speakers, upsert, vectorpairs
from tessera.plans.workspace import Workspace
from tessera.queries.tables import table
from tessera.sources import chunks, readers, writers


def _text(c):
    return F.col(c).cast("string")


def _long(*names):
    return {c: F.col(c).cast("long") for c in names}


def keywords(spark, sf_dir):
    found = entities.keywords(entities.with_entities(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text"), "source")
    return found.select("doc_id", F.array_join("keywords", " ").alias("keywords"))


def segment_speakers(spark, sf_dir):
    """Parts as the speakers of segments: their kind is the video, their size the segment."""
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_type").alias("video_id"), F.col("p_size").alias("segment"), F.col("p_partkey").alias("place"), F.col("p_partkey").alias("voice"), F.col("p_name").alias("name"), F.col("p_brand").alias("position"), F.lit("part").alias("role_in_video"))
    return speakers.map_segments(rows)


def entity_counts(spark, sf_dir):
    """Entities by kind in each document, and how many characters they have."""
    found = entities.with_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", F.explode("entities").alias("e"))
    return found.groupBy("doc_id", F.col("e.kind").alias("kind")).agg(F.count("*").alias("mentions"), F.sum(F.length("e.text")).alias("chars"))


def legislation_mentions(spark, sf_dir):
    """Mentions of acts and bills, over documents and texts made of parts' brands."""
    docs = table(spark, sf_dir, "documents").select("text")
    made = table(spark, sf_dir, "part").select(F.concat_ws(" ", F.lit("then the"), F.initcap(F.split("p_type", " ")[0]), F.when(F.col("p_partkey") % 2 == 0, "Act was read").otherwise("Bill came"), F.lit("before This Bill.")).alias("text"))
    return entities.mention_counts(docs.union(made), "text")


_FIRST = ["Ann", "Boris", "Carla", "Denis", "Ella", "Frank", "Gina"]


def _people(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("id"), F.element_at(F.array(*map(F.lit, _FIRST)), (key % 7 + 1).cast("int")).alias("first"), F.concat(F.lit("Sur"), key.cast("string")).alias("last"))


def name_resolution(spark, sf_dir):
    """Customers' names in capitals, as initial and surname, with a letter doubled, and unknown ones."""
    people = _people(spark, sf_dir)
    said = F.when(F.col("id") % 50 == 1, F.concat("first", F.lit(" Surr"), F.col("id").cast("string"))).when(F.col("id") % 50 == 2, F.concat(F.lit("Nobody of this name "), F.col("id").cast("string")))
    said = said.when(F.col("id") % 2 == 0, F.upper(F.concat("first", F.lit("  "), "last"))).otherwise(F.concat(F.lit("Hon. "), F.substring("first", 1, 1), F.lit(". "), "last"))
    found = naming.resolve(people.select("id", said.alias("said")), people.select("id", F.concat_ws(" ", "first", "last").alias("name")), "said")
    return found.select("id", F.coalesce("resolved", F.lit(-1)).cast("long").alias("resolved"), F.coalesce("tier", F.lit(-1)).cast("long").alias("tier"))


def shown_names(spark, sf_dir):
    """Speakers as the latest order papers title them, else by their own name."""
    people = _people(spark, sf_dir)
    one = F.struct(F.lower(F.concat_ws(" ", "first", "last")).alias("name"), F.when(F.col("id") % 3 == 0, "Hon.").when(F.col("id") % 3 == 1, "mrs").otherwise("Dr").alias("title"), F.lit("Minister of Roads, JP").alias("role"))
    papers = people.where("id % 10 < 4").groupBy((F.col("id") % 4).alias("paper")).agg(F.collect_list(one).alias("speakers")).withColumn("sitting", F.date_add(F.lit("2026-01-01"), F.col("paper").cast("int")))
    speakers = people.select(F.concat(F.lit("s_"), F.lower("first"), F.lit("_"), F.lower("last"), F.lit("_1")).alias("id"), F.when(F.col("id") % 2 == 0, F.concat_ws(" ", "first", "last")).alias("full_name"), F.lit(None).cast("string").alias("normalized_name"), F.lit(None).cast("string").alias("title"))
    return naming.shown_names(speakers, naming.title_index(papers))


def _answers(spark, sf_dir):
    """For each conversation its known ids, and an answer that cites one id to a turn in one of six forms."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    own = F.concat(F.lit("utt_V"), F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") * 7).cast("string"))
    known = rows.select("conv_id", own.alias("id")).union(rows.where("turn = 0").select("conv_id", F.concat(F.lit("bill:B"), F.col("conv_id").cast("string"), F.lit(":3"))))
    bare = F.substr(own, F.lit(5))
    form = F.col("turn") % 6
    said = F.when(form == 0, own).when(form == 1, F.lower(own)).when(form == 2, bare).when(form == 3, (F.col("turn") * 7).cast("string")).when(form == 4, F.concat(F.lit("bill:B"), (F.col("conv_id") + F.col("turn") - 4).cast("string"), F.lit(":3"))).otherwise("utt_V:none")
    links = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("[x](#src:"), said, F.lit(")")).alias("l"))))
    answers = rows.groupBy("conv_id").agg(F.array_join(F.transform(links, lambda x: x["l"]), " and ").alias("answer"))
    return answers.select("conv_id", ft.cited_ids(F.col("answer")).alias("ids")), known


def citation_resolution(spark, sf_dir):
    cited, known = _answers(spark, sf_dir)
    return citing.resolve_citations(cited, known, "conv_id").withColumns(_long("position"))


def citation_append(spark, sf_dir):
    """Up to four citations: those of an answer, then the conversation's first ids that it lacks."""
    cited, known = _answers(spark, sf_dir)
    found = citing.resolve_citations(cited, known, "conv_id").withColumns(_long("position"))
    more = known.where("id like 'utt%'").select("conv_id", F.regexp_extract("id", r":(\d+)$", 1).cast("long").alias("position"), "id")
    return citing.append_unique(found, more, "conv_id", "id", "position", 4).withColumns(_long("position"))


def _spoken(spark, sf_dir):
    """Turns as sentences of videos, with customers as speakers; every seventh speaker isn't known."""
    rows = table(spark, sf_dir, "conversations")
    speaker = (F.col("conv_id") * 3 + F.when(F.col("role") == "user", 1).otherwise(0)) % 105
    sentences = rows.select(F.concat_ws(":", F.lit("v"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").alias("paragraph_id"), speaker.alias("speaker_id"), (F.col("turn") * 9).alias("seconds"), "text", F.col("conv_id").cast("string").alias("youtube_video_id"), "conv_id", "turn", (F.col("conv_id") % 28).alias("day"))
    speakers = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 3").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("full_name"), F.lower("c_name").alias("normalized_name"))
    return sentences, speakers


def citation_hydration(spark, sf_dir):
    sentences, speakers = _spoken(spark, sf_dir)
    cited = sentences.where("turn % 2 = 0").select("id")
    named = speakers.select("id", F.coalesce("full_name", "normalized_name").alias("name"), F.when(F.col("id") % 5 == 0, "Unknown").when(F.col("id") % 5 == 1, "Member").alias("position"))
    roles = sentences.select("youtube_video_id", "speaker_id", "turn").withColumn("source", F.when(F.col("turn") % 3 == 0, "transcript").when(F.col("turn") % 3 == 1, "order_paper").otherwise("other"))
    roles = roles.where("speaker_id % 2 = 0").withColumn("role_kind", F.when(F.col("turn") % 2 == 0, "executive").otherwise("committee")).withColumn("role_label", F.concat_ws(" ", "role_kind", F.col("turn").cast("string")))
    found = citing.hydrate(cited, sentences, named, roles)
    return found.select("id", "seconds", "url", F.coalesce(F.col("speaker_name").cast("string"), F.lit("")).alias("speaker_name"), F.coalesce("speaker_title", F.lit("")).alias("speaker_title"))


def _vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


def hybrid_sentences(spark, sf_dir):
    """Entities are vectors of even, paragraphs of odd number; a turn mentions the vector of twice its conversation."""
    sentences, speakers = _spoken(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings")
    found = search.hybrid_sentences(
        vectors.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), "embedding"), vectors.where("vec_id % 2 = 1").select(((F.col("vec_id") - 1) / 2).cast("long").alias("id"), "embedding"),
        sentences.where("turn % 3 < 2").select(F.col("id").alias("sentence_id"), (F.col("conv_id") * 2).alias("entity_id")), sentences, speakers.withColumn("full_name", F.col("full_name")), _vector(spark, sf_dir), k=40, most=60, skip=5,
    )
    return found.select("id", F.round("score", 6).alias("score"), F.col("speaker_name").cast("string").alias("speaker_name"))


def words_within(spark, sf_dir):
    sentences, speakers = _spoken(spark, sf_dir)
    found = search.words_within(sentences, speakers, "text", ["the", "and"], "day", 5, 20, most=1_000_000)
    return found.select("id", F.round("rank", 6).alias("rank"))


def candidate_nodes(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    found = search.candidate_nodes(vectors, vectors.where("id % 100 = 7").select("id"), _vector(spark, sf_dir), 50)
    return found.select("id", "label", F.col("place").cast("long").alias("place"))


def _voiced(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("video_id"), "event_type", F.col("event_id").alias("id"), (F.col("event_id") * 3).alias("seconds"), (F.col("user_id") % 6).alias("voice_id"), F.concat(F.col("event_type"), (F.floor(F.col("event_id") / 200) % 3).cast("string")).alias("speaker_id"))


def mismatch_flags(spark, sf_dir):
    rows = _voiced(spark, sf_dir)
    speakers = rows.select(F.col("speaker_id").alias("id"), F.upper("speaker_id").alias("full_name")).distinct()
    roles = rows.where("speaker_id like '%0'").select("video_id", "speaker_id", F.lit("member").alias("role_label")).distinct()
    found = quality_reports.mismatch_flags(rows, speakers, roles, 60, 2)
    return found.withColumns(_long("voice_id", "sentence_count", "total_seconds")).select("video_id", "speaker_id", "speaker_name", "sentence_count", "total_seconds", "has_role", "role_label")


def sampled_flags(spark, sf_dir):
    flags = table(spark, sf_dir, "customer").select("c_custkey", F.split("c_name", "0").alias("samples"))
    return quality_reports.sampled_flags(flags, ["c_custkey"], "samples", 2, 500).withColumns(_long("place"))


def backfill_nulls(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("c_mktsegment"), "c_nationkey")
    changes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("c_mktsegment"))
    return upsert.backfill(customers, changes, ["c_custkey"], ["c_mktsegment"]).withColumn("c_mktsegment", F.coalesce("c_mktsegment", F.lit("")))


def due_videos(spark, sf_dir):
    """Orders as watched videos at the end of 1996, seen within a day or not."""
    orders = table(spark, sf_dir, "orders")
    watched = orders.select("o_orderkey", (F.col("o_orderpriority") < "4").alias("auto_process"), F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderkey") % 2 == 0, "pending").alias("status"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate")).alias("last_processed"))
    return upsert.due(watched, F.lit("1996-12-31").cast("timestamp_ntz")).select("o_orderkey")


def filters(spark, sf_dir):
    """Orders of the 900 days before a date, of priorities in any case, with segments long enough."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    since = F.date_sub(F.lit("1998-01-01").cast("date"), 900)
    rows = rows.where((F.to_date("o_orderdate") >= since) & F.upper("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.length("c_mktsegment") >= 9))
    return sequence.after_first(rows.select("o_orderkey", "c_mktsegment"), ["o_orderkey"], 10)


def actionable_checks(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("video_id"), F.lit("00:00:01").alias("timestamp"), F.col("o_custkey").cast("string").alias("speaker_id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("name"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 4 == 1).alias("match_requested"), (F.col("o_orderkey") % 10 / 10).alias("confidence"))
    return quality_reports.overrides_from(rows, 0.5)


def search_words(spark, sf_dir):
    return upsert.with_search_words(table(spark, sf_dir, "part"), F.col("p_name"), F.col("p_brand"), F.col("p_type")).select("p_partkey", F.array_join("words", " ").alias("words"))


def rekeyed(spark, sf_dir):
    """Orders with customers' numbers from a mapping, then those of unknown customers without one."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    mapping = customers.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("old_id"), (F.col("c_custkey") + 1).alias("new_id"))
    found = upsert.null_orphans(upsert.rekey(orders, mapping, "o_custkey"), customers.where("c_custkey % 5 > 0"), "o_custkey", "c_custkey")
    return found.withColumn("o_custkey", F.coalesce("o_custkey", F.lit(-1)))


def collapsed_nodes(spark, sf_dir):
    """Parts of one brand and type as one node, under the one of smallest number."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("label"), F.array("p_brand", "p_name").alias("aliases"), "p_brand")
    mapping = parts.groupBy("type", "p_brand").agg(F.min("id").alias("canonical_id")).join(parts, ["type", "p_brand"]).where("id <> canonical_id").select(F.col("id").alias("old_id"), "canonical_id")
    found = graph.collapse_nodes(parts.drop("p_brand"), mapping)
    return found.select("id", "type", "label", F.array_join("aliases", ",").alias("aliases"), "merged_from_count")


def vector_pairs(spark, sf_dir):
    """For each vector whose number is divisible by 20 the vectors of its label at a cosine of 0.2 or more: pairs of different vectors, and the copies of each."""
    return vectorpairs.alike_in_label(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", F.col("vec_id") % 20 == 0, 0.2)


def chunk_text(spark, sf_dir):
    """Chunks of all documents: how many each has, where the last one ends, and how long they are in all."""
    found = chunks.chunked(table(spark, sf_dir, "documents"), "doc_id", ["text", "source"])
    return found.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("char_end").cast("long").alias("char_end"), F.max(F.length("text")).cast("long").alias("longest"))


def transcript_files(spark, sf_dir):
    """Conversations written as transcript records and read again."""
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.lit("v:"), _text("conv_id")).alias("video_id"), (F.col("turn") * 61).alias("seconds"), F.col("role").alias("speaker_id"), "text", F.concat(F.lit("Video "), _text("conv_id")).alias("video_title"), F.lit("2026-01-03").cast("date").alias("video_date"))
    path = f"{Workspace(spark, 'transcripts').root}/files"
    writers.transcripts_to_json(rows, path)
    found = readers.transcripts(spark, path)
    return found.select("video_id", "video_title", F.col("position").cast("long").alias("position"), F.col("seconds").cast("long").alias("seconds"), "speaker_id", F.length("text").cast("long").alias("chars"), F.col("video_date").cast("string").alias("video_date"))


def csv_files(spark, sf_dir):
    """Parts written as CSV with a field list and read again, arrays as JSON text."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("type"), F.concat(F.lit('The "'), "p_name", F.lit('", old')).alias("label"), F.array("p_brand", "p_name").alias("aliases"))
    path = f"{Workspace(spark, 'csv').root}/nodes"
    writers.to_csv(rows, path, ["id", "type", "label", "aliases", "merge_cluster_id"])
    found = readers.csv_table(spark, path, readers.NODE)
    return found.select("id", "type", "label", F.array_join(F.from_json("aliases", "array<string>"), ",").alias("aliases"), F.col("merge_cluster_id").isNull().alias("empty"))


def caption_cues(spark, sf_dir):
    """Conversations as WebVTT, and for each cue the segments of 20 seconds, widened by one, that it overlaps."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace(F.regexp_replace("text", "[<>]", ""), r"\s+", " ")).alias("text"))
    cue = F.concat(ft.to_timestamp_text(F.col("turn") * 5), F.lit(".000 --> "), ft.to_timestamp_text(F.col("turn") * 5 + 4), F.lit(".500 align:start\n<v x>"), "text", F.lit("</v>"))
    files = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cue.alias("c")))), lambda x: x["c"]), "\n\n").alias("cues"))
    cues = readers.caption_cues(files.withColumn("vtt", F.concat(F.lit("WEBVTT\n\n"), "cues")), "conv_id", "vtt")
    segments = sequence.timeline(files, "conv_id", F.lit(60), 20, 0)
    found = matching.overlapping(cues, segments, "conv_id", 1.0).select("c.conv_id", F.col("s.segment").alias("segment"), F.col("c.start").alias("start"), F.length("c.text").cast("long").alias("chars"))
    return found


def order_papers(spark, sf_dir):
    """Nations as order papers: a heading for each region, an item for each nation."""
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". Motion on "), x["n_name"])), "\n")
    papers = both.groupBy("r_name").agg(F.concat(F.lit("# "), F.first("r_name"), F.lit("\n\n"), items).alias("body"))
    found = readers.order_paper_items(papers, "r_name", "body")
    return found.select("r_name", F.col("sequence").cast("long").alias("sequence"), "heading", "item")


def table_links(spark, sf_dir):
    """Suppliers as rows of one HTML table to a nation."""
    row = F.concat(F.lit("<tr><td>"), "s_name", F.lit("</td>\n<td><a class='x' href=\"/s/"), F.col("s_suppkey").cast("string"), F.lit('.pdf">No. <b>'), F.col("s_suppkey").cast("string"), F.lit("</b></a></td></tr>"))
    pages = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.concat(F.lit("<table><tr><th>Name</th></tr>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("r")))), lambda x: x["r"]), "\n"), F.lit("</table>")).alias("html"))
    return readers.table_links(pages, "s_nationkey", "html").select("s_nationkey", F.col("cells")[0].alias("name"), "title", "url")


def dates_and_roles(spark, sf_dir):
    """Dates of orders in three written forms, read again; role labels and their kinds."""
    day = F.to_date("o_orderdate")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), F.date_format("o_orderdate", "yyyyMMdd").alias("a"), F.date_format("o_orderdate", "EEEE, 'the' d'th day of' MMMM, yyyy").alias("b"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("c"))
    role = F.element_at(F.array(*map(F.lit, ["Member for St. John, JP", "Minister of Health", "Chair, Roads Committee", "Leader of the House", "clerk", " "])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    labels = ft.role_labels(role)
    same = (ft.to_date_or_null(F.col("a")) == F.col("day")) & (ft.prose_date(F.col("b")) == F.col("day")) & (ft.slash_date(F.col("c")) == F.col("day").cast("string"))
    return rows.select("o_orderkey", same.alias("same"), F.array_join(F.transform(labels, ft.role_kind), ",").alias("kinds"))


def signatures(spark, sf_dir):
    """Strict signatures of line items as edges, and how many share one."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("source_id"), F.col("l_returnflag").alias("predicate"), F.col("l_suppkey").cast("string").alias("target_id"), F.when(F.col("l_linenumber") < 4, F.col("l_linenumber")).alias("earliest_seconds"), F.concat(F.lit(" of  "), "l_linestatus", F.lit("\n x")).alias("evidence"))
    found = rows.groupBy(quality_reports.edge_signature(strict=True).alias("s")).agg(F.count("*").alias("edges"))
    return found.select(F.replace("s", F.lit("\u0001"), F.lit("|")).alias("signature"), "edges")


QUERIES = {
    "keywords15": keywords, "entity_counts": entity_counts, "legislation_mentions": legislation_mentions, "name_resolution": name_resolution, "shown_names": shown_names, "segment_speakers": segment_speakers, "citation_resolution": citation_resolution, "citation_append": citation_append,
    "citation_hydration": citation_hydration, "hybrid_sentences": hybrid_sentences, "words_within": words_within, "candidate_nodes": candidate_nodes, "mismatch_flags": mismatch_flags, "sampled_flags": sampled_flags, "backfill_nulls": backfill_nulls,
    "due_videos": due_videos, "relative_date_enum_paging": filters, "actionable_checks": actionable_checks, "search_words": search_words, "rekey_null_orphans": rekeyed, "collapsed_nodes": collapsed_nodes, "vector_pairs_by_label": vector_pairs,
    "chunk_text": chunk_text, "transcript_files": transcript_files, "csv_files": csv_files, "caption_cues_overlap": caption_cues, "order_paper_items": order_papers, "table_links": table_links, "dates_and_roles": dates_and_roles, "edge_signatures": signatures,
}

_ASCII = "regexp_replace(text, '[^[:ascii:]]', '_', 'g')"
_OF = lambda kind: " || ".join("regexp_extract_all(t, '{}')".format(p.replace("'", "''")) for p in entities.PATTERNS[kind])
_BILLS = f"list_filter({_OF('related_bills')}, lambda x: lower(x) NOT IN ('this bill', 'the bill', 'a bill'))"
_STOP = ", ".join(f"'{w}'" for w in v.KEYWORD_STOPWORDS)
_SPOKEN = """s AS (SELECT 'v:' || conv_id || ':' || turn AS id, conv_id, turn, (conv_id * 3 + CASE WHEN role = 'user' THEN 1 ELSE 0 END) % 105 AS speaker_id, turn * 9 AS seconds, text, conv_id % 28 AS day FROM conversations),
p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE lower(c_name) END AS name FROM customer WHERE c_custkey % 7 <> 3)"""
_NEAR = "d AS (SELECT e.vec_id, e.label, 1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"
_CITED = """forms AS (SELECT conv_id, turn, 'utt_V' || conv_id || ':' || turn * 7 AS own, turn % 6 AS f FROM conversations),
found AS (SELECT conv_id, turn, CASE WHEN f <= 2 THEN own WHEN f = 3 THEN own WHEN f = 4 AND turn = 4 THEN 'bill:B' || conv_id || ':3' END AS id FROM forms),
cited AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) - 1 AS position, id FROM found WHERE id IS NOT NULL GROUP BY conv_id, id)"""
_FIRSTS = "['" + "', '".join(_FIRST) + "']"
SQL = {
    "keywords15": f"""WITH e AS (SELECT doc_id, source, {_ASCII} AS t FROM documents),
w AS (SELECT doc_id, [lower(source)] || list_transform({_OF('organizations')} || {_OF('persons')} || {_OF('dates')} || {_OF('locations')} || {_BILLS}, lambda x: lower(x)) AS w FROM e),
l AS (SELECT doc_id, list_filter(flatten(list_transform(w, lambda x: regexp_extract_all(x, '[a-z0-9_]+'))), lambda x: length(x) >= 3 AND x NOT IN ({_STOP})) AS l FROM w),
n AS (SELECT doc_id, k, min(i) AS i FROM (SELECT doc_id, unnest(l) AS k, generate_subscripts(l, 1) AS i FROM l) GROUP BY ALL)
SELECT doc_id, coalesce(string_agg(k, ' ' ORDER BY i), '') AS keywords FROM documents LEFT JOIN (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 15) USING (doc_id) GROUP BY doc_id""",
    "entity_counts": f"""WITH e AS (SELECT doc_id, {_ASCII} AS t FROM documents), k AS (SELECT doc_id, 'organizations' AS kind, unnest({_OF('organizations')}) AS x FROM e UNION ALL SELECT doc_id, 'persons', unnest({_OF('persons')}) FROM e
  UNION ALL SELECT doc_id, 'dates', unnest({_OF('dates')}) FROM e UNION ALL SELECT doc_id, 'locations', unnest({_OF('locations')}) FROM e UNION ALL SELECT doc_id, 'related_bills', unnest({_BILLS}) FROM e)
SELECT doc_id, kind, count(*) AS mentions, CAST(sum(length(x)) AS BIGINT) AS chars FROM k GROUP BY ALL""",
    "legislation_mentions": f"""WITH e AS (SELECT {_ASCII} AS t FROM documents UNION ALL SELECT 'then the ' || upper(p_type[1]) || lower(split_part(p_type, ' ', 1)[2:]) || CASE WHEN p_partkey % 2 = 0 THEN ' Act was read' ELSE ' Bill came' END || ' before This Bill.' FROM part),
m AS (SELECT unnest(regexp_extract_all(t, '\\b[A-Z][A-Za-z]*(?:\\s+[A-Z][A-Za-z]*)*\\s+Bill\\b')) AS name, 'BILL' AS kind FROM e UNION ALL SELECT unnest(regexp_extract_all(t, '\\b[A-Z][A-Za-z]*(?:\\s+[A-Z][A-Za-z]*)*\\s+Act\\b')), 'LAW' FROM e)
SELECT name, kind, count(*) AS mentions FROM m WHERE lower(name) NOT IN ('this bill', 'the bill', 'a bill') GROUP BY ALL""",
    "name_resolution": "SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 2 THEN -1 ELSE c_custkey END AS resolved, CAST(CASE WHEN c_custkey % 50 = 1 THEN 2 WHEN c_custkey % 50 = 2 THEN -1 WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END AS BIGINT) AS tier FROM customer",
    "shown_names": f"""WITH c AS (SELECT c_custkey AS k, {_FIRSTS}[c_custkey % 7 + 1] AS f, c_custkey % 10 < 4 AS titled FROM customer)
SELECT 's_' || lower(f) || '_sur' || k || '_1' AS id, CASE WHEN titled THEN CASE k % 3 WHEN 0 THEN 'The Honourable ' WHEN 1 THEN 'Mrs. ' ELSE 'Dr. ' END ELSE '' END || f || ' Sur' || k AS name FROM c""",
    "citation_resolution": f"WITH {_CITED} SELECT conv_id, position, id FROM cited",
    "citation_append": f"""WITH {_CITED}, more AS (SELECT conv_id, 1000000 + turn AS position, own AS id FROM forms WHERE own NOT IN (SELECT id FROM cited)),
every AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY position) AS r FROM (SELECT * FROM cited UNION ALL SELECT * FROM more)) SELECT conv_id, r - 1 AS position, id FROM every WHERE r <= 4""",
    "citation_hydration": f"""WITH {_SPOKEN}, r AS (SELECT conv_id, speaker_id, CASE WHEN turn % 2 = 0 THEN 'executive' ELSE 'committee' END || ' ' || turn AS label FROM s WHERE speaker_id % 2 = 0
  QUALIFY row_number() OVER (PARTITION BY conv_id, speaker_id ORDER BY CASE turn % 3 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END, turn % 2, length(label), label) = 1)
SELECT s.id, seconds, 'https://www.youtube.com/watch?v=' || s.conv_id || '&t=' || seconds || 's' AS url, coalesce(name, CAST(s.speaker_id AS VARCHAR)) AS speaker_name, coalesce(label, CASE WHEN p.id % 5 = 1 THEN 'Member' END, '') AS speaker_title
FROM s LEFT JOIN p ON s.speaker_id = p.id LEFT JOIN r ON r.conv_id = s.conv_id AND r.speaker_id = s.speaker_id WHERE turn % 2 = 0""",
    "hybrid_sentences": f"""WITH {_SPOKEN}, {_NEAR}, e AS (SELECT vec_id, 1 - d AS score FROM d WHERE vec_id % 2 = 0 ORDER BY d, vec_id LIMIT 40), q AS (SELECT (vec_id - 1) // 2 AS c FROM d WHERE vec_id % 2 = 1 ORDER BY d, vec_id LIMIT 40),
a AS (SELECT s.id, e.score, coalesce(p.name, CAST(speaker_id AS VARCHAR)) AS speaker_name FROM s JOIN e ON conv_id * 2 = vec_id LEFT JOIN p ON speaker_id = p.id WHERE turn % 3 < 2),
b AS (SELECT s.id, 0.5 AS score, p.name AS speaker_name FROM s JOIN q ON conv_id = c JOIN p ON speaker_id = p.id WHERE s.id NOT IN (SELECT id FROM a))
SELECT id, round(score, 6) AS score, speaker_name FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY score DESC, id LIMIT 60 OFFSET 5""",
    "words_within": """SELECT 'v:' || conv_id || ':' || turn AS id, round((len(list_filter(w, lambda x: x = 'the')) + len(list_filter(w, lambda x: x = 'and'))) / (1 + ln(greatest(len(w), 1))), 6) AS rank
FROM (SELECT *, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM conversations) WHERE conv_id % 28 BETWEEN 5 AND 20 AND list_has_all(w, ['the', 'and'])""",
    "candidate_nodes": f"""WITH {_NEAR}, c AS (SELECT vec_id, label, 0 AS p, 0.0 AS x FROM d WHERE vec_id % 100 = 7 UNION ALL SELECT * FROM (SELECT vec_id, label, 1 AS p, d AS x FROM d ORDER BY d, vec_id LIMIT 50) WHERE vec_id % 100 <> 7)
SELECT vec_id AS id, label, row_number() OVER (ORDER BY p, x, vec_id) AS place FROM c QUALIFY place <= greatest(50, (SELECT count(*) FROM d WHERE vec_id % 100 = 7))""",
    "mismatch_flags": """WITH r AS (SELECT user_id % 40 AS video_id, event_type || event_id // 200 % 3 AS speaker_id, event_id AS id, event_id * 3 AS seconds FROM events),
m AS (SELECT *, CASE WHEN lag(speaker_id) OVER w = speaker_id THEN 0 ELSE 1 END AS n FROM r WINDOW w AS (PARTITION BY video_id ORDER BY seconds, id)),
b AS (SELECT *, sum(n) OVER (PARTITION BY video_id ORDER BY seconds, id) AS block FROM m), l AS (SELECT video_id, speaker_id, block, max(seconds) - min(seconds) AS s, count(*) AS c FROM b GROUP BY ALL),
t AS (SELECT video_id, speaker_id, CAST(sum(c) AS BIGINT) AS sentence_count, CAST(sum(s) AS BIGINT) AS total_seconds FROM l GROUP BY ALL HAVING sum(s) >= 60)
SELECT video_id, speaker_id, upper(speaker_id) AS speaker_name, sentence_count, total_seconds, speaker_id LIKE '%0' AS has_role, CASE WHEN speaker_id LIKE '%0' THEN 'member' ELSE '' END AS role_label FROM t
QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY total_seconds DESC, speaker_id) <= 2""",
    "sampled_flags": """SELECT c_custkey, place, parts[place + 1] AS sample FROM (SELECT c_custkey, string_split(c_name, '0') AS parts, unnest([0::BIGINT, 1]) AS place FROM customer) WHERE place < len(parts) ORDER BY c_custkey, place LIMIT 500""",
    "backfill_nulls": "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END, m, '') AS c_mktsegment, c_nationkey FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "due_videos": "SELECT o_orderkey FROM orders WHERE o_orderpriority < '4' AND o_orderstatus <> 'F' AND (o_orderkey % 5 = 0 OR o_orderdate < TIMESTAMP '1996-12-30 00:00:00')",
    "relative_date_enum_paging": "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE CAST(o_orderdate AS DATE) >= DATE '1998-01-01' - 900 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND length(c_mktsegment) >= 9 ORDER BY o_orderkey OFFSET 10",
    "actionable_checks": """SELECT CAST(o_orderkey AS VARCHAR) AS video_id, '00:00:01' AS start, '00:00:01' AS "end", CAST(o_custkey AS VARCHAR) AS old_speaker_id, o_orderpriority AS new_speaker_name FROM orders WHERE o_orderkey % 4 IN (2, 3) AND o_orderkey % 3 > 0 AND o_orderkey % 10 >= 5""",
    "search_words": "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^a-z0-9]+'), lambda x: x <> ''))), ' ') AS words FROM part",
    "rekey_null_orphans": """SELECT o_orderkey, CASE WHEN k % 5 > 0 AND k IN (SELECT c_custkey FROM customer) THEN k ELSE -1 END AS o_custkey FROM (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer) THEN o_custkey + 1 ELSE o_custkey END AS k FROM orders)""",
    "collapsed_nodes": """SELECT id, type, (SELECT p_name FROM part WHERE p_partkey = id) AS label, aliases, c AS merged_from_count FROM (SELECT min(p_partkey) AS id, p_type AS type, array_to_string(list_sort(list_distinct(list(p_name) || [any_value(p_brand)])), ',') AS aliases, count(*) AS c FROM part GROUP BY p_type, p_brand)""",
    "vector_pairs_by_label": """WITH e AS (SELECT *, min(vec_id) OVER (PARTITION BY label, embedding) AS rep, bool_or(vec_id % 20 = 0) OVER (PARTITION BY label, embedding) AS asked FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, a.label, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity, a.rep = b.rep AS copy
FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id = a.rep AND (a.rep = b.rep OR (a.asked AND b.vec_id = b.rep AND similarity >= 0.2))""",
    "transcript_files": """SELECT 'v:' || conv_id AS video_id, 'Video ' || conv_id AS video_title, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, turn * 61 AS seconds, role AS speaker_id, length(text) AS chars, '2026-01-03' AS video_date FROM conversations""",
    "csv_files": """SELECT CAST(p_partkey AS VARCHAR) AS id, p_type AS type, 'The "' || p_name || '", old' AS label, p_brand || ',' || p_name AS aliases, true AS empty FROM part""",
    "caption_cues_overlap": r"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '[<>]', '', 'g'), '\s+', ' ', 'g')) AS text FROM conversations)
SELECT conv_id, segment, CAST(turn * 5 AS DOUBLE) AS start, length(text) AS chars FROM c, (SELECT unnest([0::BIGINT, 1, 2]) AS segment) WHERE text <> '' AND turn * 5 <= segment * 20 + 21 AND turn * 5 + 4.5 >= segment * 20 - 1""",
    "order_paper_items": "SELECT r_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS sequence, r_name AS heading, 'Motion on ' || n_name AS item FROM nation JOIN region ON n_regionkey = r_regionkey",
    "table_links": "SELECT s_nationkey, s_name AS name, 'No. ' || s_suppkey AS title, '/s/' || s_suppkey || '.pdf' AS url FROM supplier",
    "dates_and_roles": "SELECT o_orderkey, true AS same, ['constituency,other', 'executive', 'procedural,committee', 'parliamentary', 'other', ''][o_orderkey % 6 + 1] AS kinds FROM orders",
    "edge_signatures": "SELECT l_partkey || '|' || l_returnflag || '|' || l_suppkey || '|' || CASE WHEN l_linenumber < 4 THEN l_linenumber ELSE -1 END || '|of ' || l_linestatus || ' x' AS signature, count(*) AS edges FROM lineitem GROUP BY 1",
}
