"""Cuts long texts into overlapping chunks, for excerpts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP, LEAST = 900, 150, 100
#: Most texts that a task cuts, and about as many characters of chunks that it holds, before it hands them on.
TEXTS, HELD = 256, 1 << 20


def cut(text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int, str]]:
    """(start, end, chunk) of a text: ends at a paragraph or sentence in the chunk's second half where there is one, and stops at the text's end."""
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            half = at + size // 2
            breaks = [text.rfind(mark, half, end) + len(mark) for mark in ("\n\n", ". ", "? ", "! ") if text.rfind(mark, half, end) >= 0]
            end = breaks[0] if breaks else end
        chunk = text[at:end].strip()
        # a short chunk is left out only where the one before it holds all of it
        held = out and at + len(text[at:end].rstrip()) <= out[-1][1]
        if chunk and (len(chunk) >= least or not held):
            lead = len(text[at:end]) - len(text[at:end].lstrip())
            out.append((at + lead, at + lead + len(chunk), chunk))
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def chunked(docs: DataFrame, key: str, texts: list[str], size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(key, chunk_index, char_start, char_end, text) of the first of ``texts`` that isn't blank."""
    source = F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in texts])
    kind = docs.schema[key].dataType.simpleString()

    def made(keys, rows):
        columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], [], []]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.string())], [key, "chunk_index", "char_start", "char_end", "text"])

    def run(batches):
        for batch in batches:
            keys, rows, held = batch.column(0), [], 0
            for i, text in enumerate(batch.column(1)):
                own = [(i, n, *c) for n, c in enumerate(cut(text.as_py() or "", size, overlap, least))]
                rows += own
                held += sum(len(r[-1]) for r in own)
                if held >= HELD or (i + 1) % TEXTS == 0:
                    yield made(keys, rows)
                    rows, held = [], 0
            yield made(keys, rows)

    return docs.select(F.col(key), source.alias("_t")).mapInArrow(run, f"{key} {kind}, chunk_index int, char_start int, char_end int, text string")
