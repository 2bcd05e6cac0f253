"""Threads of a chat, and what a model is told of the nodes around a window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import answers


def thread_messages(threads: DataFrame, messages: DataFrame, states: DataFrame) -> DataFrame:
    """Each message of the threads with its thread's title and state, to be read by created_at; a thread without any has one row without a message.

    ``threads`` has id and title, ``messages`` id, thread_id, role, content and
    created_at, ``states`` thread_id and state as JSON; none or broken JSON is an empty map.
    """
    parsed = states.select(F.col("thread_id"), F.from_json("state", "map<string, string>").alias("state"))
    every = threads.select(F.col("id").alias("thread_id"), "title").join(parsed, "thread_id", "left")
    every = every.withColumn("state", F.coalesce("state", F.create_map().cast("map<string, string>")))
    return every.join(messages.select("thread_id", F.col("id").alias("message_id"), "role", "content", "created_at"), "thread_id", "left")


def known_tables(candidates: DataFrame, by: list[str], place: str) -> DataFrame:
    """(by, nodes): for each window its candidates (``search.candidate_nodes``, a few each) as a table, in their order."""
    line = answers.node_line(F.col("id"), F.col("type"), F.col("label"), F.col("aliases"))
    lines = F.array_sort(F.collect_list(F.struct(F.col(place), F.col("id"), line.alias("line"))))
    return candidates.groupBy(*by).agg(answers.node_table(F.transform(lines, lambda x: x["line"])).alias("nodes"))
