"""Roll-ups of runs, model comparison and rule checks of extracted payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import selection


def run_rollup(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Counts, rates and exact elapsed percentiles for each configuration (of columns without nulls); elapsed only over positive times."""
    timed = F.when(F.col("elapsed_s") > 0, F.col("elapsed_s"))
    ok = F.when(F.col("parse_success"), 1).otherwise(0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    found = metrics.groupBy(*by).agg(
        F.count("*").alias("windows"),
        F.sum(ok).alias("successes"),
        (F.sum(ok) / F.count("*")).alias("success_rate"),
        zero(F.avg(timed)).alias("elapsed_avg"),
        zero(F.max(timed)).alias("elapsed_max"),
        F.sum("total_tokens").alias("tokens"),
    )
    points = selection.percentiles(metrics, by, timed, {"elapsed_p50": 0.5, "elapsed_p95": 0.95})
    both = found.join(points, by, "left").withColumns({c: zero(F.col(c)) for c in ("elapsed_p50", "elapsed_p95")})
    return both.select(*by, "windows", "successes", "success_rate", "elapsed_avg", "elapsed_p50", "elapsed_p95", "elapsed_max", "tokens")


def overlap(signatures: DataFrame, model: str, signature: str) -> DataFrame:
    """(model_a, model_b, shared, only_a, only_b, jaccard) of the models' signature sets."""
    own = signatures.select(F.col(model).alias("m"), F.col(signature).alias("s")).distinct()
    sizes = own.groupBy("m").agg(F.count("*").alias("n"))
    both = own.alias("a").join(own.alias("b"), F.col("a.s") == F.col("b.s")).where("a.m < b.m").groupBy(F.col("a.m").alias("model_a"), F.col("b.m").alias("model_b")).agg(F.count("*").alias("shared"))
    # models are few: every pair of them is reported
    pairs = F.broadcast(sizes.select(F.col("m").alias("model_a"), F.col("n").alias("n_a"))).join(F.broadcast(sizes.select(F.col("m").alias("model_b"), F.col("n").alias("n_b"))), F.col("model_a") < F.col("model_b"))
    out = pairs.join(both, ["model_a", "model_b"], "left").fillna(0, ["shared"])
    return out.select("model_a", "model_b", "shared", (F.col("n_a") - F.col("shared")).alias("only_a"), (F.col("n_b") - F.col("shared")).alias("only_b"), (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("jaccard"))


def issues(rows: DataFrame, key: str, rules: dict) -> DataFrame:
    """(key, issue) for every rule (a name and a boolean column that is true where it is broken) that a row breaks."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return rows.select(key, F.explode(broken).alias("issue"))


def second_pass(payloads: DataFrame) -> DataFrame:
    """``payloads`` with ``reason`` to run a second pass (parse_failed, issues, empty, few_edges) or null."""
    reason = F.when(~F.col("parse_success"), "parse_failed").when(F.col("issue_count") > 0, "issues").when(F.col("edges_count") == 0, "empty").when(F.col("edges_count") < F.col("nodes_count") / 2, "few_edges")
    return payloads.withColumn("reason", reason)


def edge_signature(strict: bool = False):
    """The columns by which models' edges are compared; strictly also time (-1 if unknown) and evidence with single spaces."""
    parts = [F.coalesce(c, F.lit("")) for c in ("source_id", "predicate", "target_id")]
    if strict:
        parts += [F.coalesce(F.col("earliest_seconds").cast("string"), F.lit("-1")), F.trim(F.regexp_replace(F.coalesce("evidence", F.lit("")), r"\s+", " "))]
    return F.array_join(F.array(*parts), "\u0001")


def markdown_table(rows: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table, up to ``most`` rows."""
    head = [f"| {' | '.join(rows.columns)} |", f"|{'---|' * len(rows.columns)}"]
    shown = lambda x: "" if x is None else str(x).replace("|", r"\|").replace("\n", " ")
    return "\n".join(head + [f"| {' | '.join(map(shown, r))} |" for r in rows.limit(most).collect()])


def mismatch_flags(sentences: DataFrame, speakers: DataFrame, roles: DataFrame, least_seconds: int = 120, per_video: int = 3, only_missing_roles: bool = False) -> DataFrame:
    """Speakers whose attribution is worth a look: long talkers of each video, with their role, sample times and whether their voice is another's too.

    ``sentences`` have video_id, speaker_id, seconds, voice_id and id; a block is a
    run of one speaker, as long as its first to its last second, and a speaker's
    voice the smallest of the longest block.
    """
    from tessera.functions import text as ft
    from tessera.operators import sequence

    marked = sequence.islands(sentences, ["video_id"], ["seconds", "id"], "speaker_id", "block").where("speaker_id is not null")
    blocks = marked.groupBy("video_id", "speaker_id", "block").agg(F.min("seconds").alias("start"), F.max("seconds").alias("end"), F.min("voice_id").alias("voice_id"), F.count("*").alias("n"))
    totals = sequence.block_summary(blocks, ["video_id", "speaker_id"], "start", "end", "block")
    more = blocks.groupBy("video_id", "speaker_id").agg(F.sum("n").alias("sentence_count"), F.max_by("voice_id", F.struct(F.col("end") - F.col("start"), "block")).alias("voice_id"))
    shared = sentences.where("voice_id is not null").groupBy("video_id", "voice_id").agg((F.count_distinct("speaker_id") > 1).alias("voice_id_conflict"))
    rows = totals.join(more, ["video_id", "speaker_id"]).join(shared, ["video_id", "voice_id"], "left").join(roles, ["video_id", "speaker_id"], "left").join(speakers.select(F.col("id").alias("speaker_id"), F.col("full_name").alias("speaker_name")), "speaker_id", "left")
    rows = rows.withColumn("has_role", F.coalesce(F.col("role_label") != "", F.lit(False))).where(F.col("total_seconds") >= least_seconds)
    if only_missing_roles:
        rows = rows.where(~F.col("has_role"))
    times = F.array_join(F.transform("samples", ft.to_timestamp_text), ",")
    few = sequence.top_per_group(rows, ["video_id"], [F.desc("total_seconds"), F.col("speaker_id")], per_video)
    return few.select("video_id", "speaker_id", F.coalesce("speaker_name", F.lit("")).alias("speaker_name"), "voice_id", "sentence_count", "total_seconds", "has_role", F.coalesce("role_label", F.lit("")).alias("role_label"), F.coalesce("voice_id_conflict", F.lit(False)).alias("voice_id_conflict"), times.alias("sample_timestamps"))


def sampled_flags(flags: DataFrame, key: Sequence[str], samples: str, each: int, most: int) -> DataFrame:
    """One row for each sample time of flags, the first ``each`` of a flag, ``most`` in all in the order of the key."""
    few = flags.select(*key, F.posexplode(F.slice(samples, 1, each)).alias("place", "sample"))
    return few.orderBy(*key, "place").limit(most)


def actionable(match: Column, name: Column, confidence: Column, least: float) -> Column:
    """Whether a check of who is on the screen calls for an override: it says no, names another, and is sure enough."""
    return F.coalesce((~match) & name.isNotNull() & (confidence >= least), F.lit(False))


def overrides_from(checks: DataFrame, least: float) -> DataFrame:
    """(video_id, start, end, old_speaker_id, new_speaker_name) from ``readers.verifications``."""
    rows = checks.where(actionable(F.col("match_requested"), F.col("name"), F.col("confidence"), least))
    return rows.select("video_id", F.col("timestamp").alias("start"), F.col("timestamp").alias("end"), F.col("speaker_id").alias("old_speaker_id"), F.col("name").alias("new_speaker_name"))


def caption_check(pairs: DataFrame, transcript: str, captions: str, least: float) -> DataFrame:
    """``pairs`` with ``similarity`` (token set ratio) and ``status``: no_captions, empty_transcript, ok or mismatch."""
    from tessera.functions import fuzzy

    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " ")), r"[^a-z0-9\s]", " "), r"\s+", " "))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rows = pairs.withColumn("_a", plain(F.col(transcript))).withColumn("_b", plain(F.col(captions)))
    rows = rows.withColumn("similarity", F.when(blank(captions) | blank(transcript) | (F.col("_a") == "") | (F.col("_b") == ""), 0.0).otherwise(fuzzy.fuzz_token_set_ratio("_a", "_b")))
    status = F.when(blank(captions), "no_captions").when(blank(transcript), "empty_transcript").when(F.col("similarity") >= least, "ok").otherwise("mismatch")
    return rows.withColumn("status", status).drop("_a", "_b")
