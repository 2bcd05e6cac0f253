"""Entities in the text of bills by patterns, keywords and mention counts from them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import fuzzy
from tessera.functions import text as ft
from tessera.functions import vocabulary as v

#: Patterns of the kinds of entities. Kinds stand in the order in which keywords are taken from them.
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_BODIES = "Ministry|Department|Office|Agency|Commission|Authority|Council|Board"
PATTERNS = {
    "topics": [r"\b(?:[A-Z][a-z]+(?:\s+[a-z]+){0,3})\s+(?:Act|Bill|Law|Regulation|Policy|Program|Scheme|Fund|System|Authority|Commission)\b"],
    "organizations": [rf"\b(?:{_BODIES})\s+of\s+[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\b", rf"\b[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\s+(?:{_BODIES})\b", r"\b(?:The\s+)?[A-Z]{2,}(?:\s+[A-Z]{2,})*\b"],
    "persons": [r"\b(?:Mr|Mrs|Ms|Dr|Hon|Prof)\.?\s+[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\b", r"\b[A-Z][a-zA-Z]+\s+[A-Z][a-zA-Z]+\b"],
    "dates": [rf"\b\d{{1,2}}\s+(?:{_MONTHS})\s+\d{{4}}\b", r"\b\d{4}-\d{2}-\d{2}\b", rf"\b(?:{_MONTHS})\s+\d{{1,2}},\s*\d{{4}}\b"],
    "locations": [r"\b(?:Jamaica|Kingston|Portmore|Spanish\s+Town|Montego\s+Bay|Mandeville|May\s+Pen|Ocho\s+Rios)\b", r"\b(?:St\.|Saint\s+)(?:Andrew|Catherine|Thomas|Mary|Ann|James|Elizabeth|Mary)\b"],
    "related_bills": [r"\b(?:the\s+)?[A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*\s+Act\b", r"\b(?:the\s+)?[A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*\s+Bill\b"],
}
GENERIC_BILLS = {"this bill", "the bill", "a bill"}
#: Topics of a text, at most, their lengths, and how alike an entity they may be.
TOPICS, TOPIC_CHARS, TOPIC_RATIO = 10, (4, 49), 90.0

ENTITY = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


#: For each pattern, words of which a match holds one, or a pattern that is quick to look for and matches within; None if there is neither.
_NEEDED = {
    "topics": [("Act", "Bill", "Law", "Regulation", "Policy", "Program", "Scheme", "Fund", "System", "Authority", "Commission")],
    "organizations": [tuple(_BODIES.split("|")), tuple(_BODIES.split("|")), None],
    "persons": [("Mr", "Ms", "Dr", "Hon", "Prof"), None],
    "dates": [tuple(_MONTHS.split("|")), re.compile(r"-\d\d-"), tuple(_MONTHS.split("|"))],
    "locations": [("Jamaica", "Kingston", "Portmore", "Spanish", "Montego", "Mandeville", "May", "Ocho"), ("St.", "Saint")],
    "related_bills": [("Act",), ("Bill",)],
}


def _quick(pattern: str) -> re.Pattern:
    """The same matches: a scan for the first character's class passes over all other characters, which one for a word's edge does not."""
    first = r"\b[A-Z]"
    return re.compile(r"[A-Z](?<=\b[A-Z])" + pattern.removeprefix(first) if pattern.startswith(first) else pattern)


_SCANS = {kind: [(_quick(p), needed) for p, needed in zip(patterns, _NEEDED[kind], strict=True)] for kind, patterns in PATTERNS.items()}
# an optional article before capitals
_SCANS["organizations"][2] = (re.compile(r"[A-Z](?<=\b[A-Z])(?:(?<=T)he\s+[A-Z]{2,}|[A-Z]+)(?:\s+[A-Z]{2,})*\b"), None)


def _may_match(needed: tuple[str, ...] | re.Pattern | None, text: str) -> bool:
    return needed is None or (any(w in text for w in needed) if isinstance(needed, tuple) else needed.search(text) is not None)


def entities_in(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end) by kind, pattern and place; topics that are nearly another entity are left out."""
    found = {kind: [(kind, m[0].strip(), m.start(), m.end()) for scan, needed in scans if _may_match(needed, text) for m in scan.finditer(text)] for kind, scans in _SCANS.items()}
    found["related_bills"] = [x for x in found["related_bills"] if x[1].lower() not in GENERIC_BILLS]
    others = {x[1].lower() for kind, some in found.items() if kind != "topics" for x in some}
    topics = []
    for x in found["topics"]:
        low = x[1].lower()
        if len(topics) < TOPICS and TOPIC_CHARS[0] <= len(low) <= TOPIC_CHARS[1] and low not in others and all(fuzzy.ratio(low, o) <= TOPIC_RATIO for o in others):
            topics.append(x)
    found["topics"] = topics
    return [x for some in found.values() for x in some]


def with_entities(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``entities`` of the whole text; a null text has none."""
    docs = docs.drop("entities")
    schema, at = T.StructType([*docs.schema, T.StructField("entities", ENTITY)]), docs.columns.index(text)

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [[dict(zip(("kind", "text", "start", "end"), x, strict=True)) for x in entities_in(t or "")] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], schema.names)

    return docs.mapInArrow(run, schema)


def keywords(docs: DataFrame, title: str) -> DataFrame:
    """``docs`` (with ``entities``) with ``keywords``: up to 15 words of the title and of the entities, in order."""
    return docs.withColumn("keywords", ft.keywords(F.col(title), F.transform("entities", lambda e: e["text"]), v.KEYWORD_STOPWORDS))


def mention_counts(docs: DataFrame, text: str) -> DataFrame:
    """(name, kind, mentions) of titled bills (BILL) and acts (LAW) in texts, without generic ones."""
    both = []
    for kind, last in (("BILL", "Bill"), ("LAW", "Act")):
        found = F.regexp_extract_all(F.col(text), F.lit(rf"(?U)\b([A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*)*\s+{last})\b"), F.lit(1))
        both.append(docs.select(F.explode(found).alias("name"), F.lit(kind).alias("kind")))
    rows = both[0].unionByName(both[1]).where(~F.lower("name").isin(*GENERIC_BILLS))
    return rows.groupBy("name", "kind").agg(F.count("*").alias("mentions"))
