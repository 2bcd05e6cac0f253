"""Full-text search over a positional inverted index kept as Parquet.

The index is a folder: ``postings`` has a row for each term of each document (of a
stemmed index: for each word, and a search puts the words of a term together) with
the positions as differences, in folders by a hash of the term and sorted by term
within files, one for each part of the documents, so that a search reads the files
of its terms only; ``lengths`` has the words of each document; ``about`` how it was
made.  Terms are runs of letters and digits in lower case, by default stemmed,
without stop words (which keep their positions).

A query is a list of alternatives; each asks for units, words or phrases, and may
rule some out.  Documents are ranked by cover density: every shortest stretch with
a match of all units adds ``WEIGHT`` over one plus the words in it that belong to
none; so one word adds ``WEIGHT`` each time, and words far apart add little.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import stemming
from tessera.plans.workspace import Workspace

WEIGHT = 0.1
#: Documents are dealt into parts of about so many words, each sorted by one task, so that a frequent term isn't one task's; into PARTS at least, where these have LEAST_WORDS.
PART_WORDS, PARTS, LEAST_WORDS = 4_000_000, 16, 100_000
#: Most words whose stems are broadcast to the documents, the most frequent ones; postings of rarer words are shuffled.
BROADCAST_WORDS = 1_000_000
#: The folder in which postings of rarer words wait for their stems.
RARE = -1
_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), _WORD), lambda w: w != "")


@dataclass
class Unit:
    """A word, or a phrase: terms with their distances from the first."""

    terms: list[tuple[str, int]]

    def size(self) -> int:
        return self.terms[-1][1] + 1


@dataclass
class Alternative:
    wanted: list[Unit] = field(default_factory=list)
    unwanted: list[Unit] = field(default_factory=list)


class TextIndex:
    """An index in a folder; ``build`` makes one, ``TextIndex(spark, folder)`` opens it."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        about = json.loads(spark.read.text(f"{folder}/about").first()[0])
        self.key, self.buckets, self.stemmed = about["key"], about["buckets"], about["stemmed"]
        self._rows = spark.read.schema(f"doc {about['kind']}, term string, gaps array<int>, bucket int").parquet(f"{folder}/postings")

    def postings(self, terms: list[str]) -> DataFrame:
        """(doc, term, positions) of some terms; only their folders are read."""
        if not terms:
            return self._rows.where("false").select("doc", "term", F.col("gaps").alias("positions"))
        rows = self.spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term"), self.buckets)).distinct().collect()
        found = self._rows.where(F.col("bucket").isin([r[0] for r in rows]) & F.col("term").isin(terms))
        found = found.select("doc", "term", F.transform("gaps", lambda _, i: F.aggregate(F.slice("gaps", F.lit(1), i + 1), F.lit(0), lambda a, g: a + g)).alias("positions"))
        return found.groupBy("doc", "term").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")) if self.stemmed else found

    def units(self, texts: list[str]) -> list[Unit]:
        """The units of some words or phrases; those of stop words alone are left out."""
        split = self.spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.posexplode(words(F.col("t"))).alias("at", "word"))
        rows = split.withColumn("term", term_of(F.col("word"), self.stemmed)).where("term is not null").orderBy("i", "at").collect()
        out = []
        for i in range(len(texts)):
            own = [(r["term"], r["at"]) for r in rows if r["i"] == i]
            if own:
                out.append(Unit([(t, at - own[0][1]) for t, at in own]))
        return out

    def parsed(self, query: str) -> list[Alternative]:
        """Alternatives of a query as people write it for the web: quoted phrases, ``or`` between alternatives, ``-`` before what is unwanted."""
        out, texts = [[]], []
        for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
            if word.lower() == "or" and not minus:
                out.append([])
                continue
            for text in [phrase] if phrase else re.split(r"[^\w]+", word):
                if text:
                    out[-1].append((bool(minus), len(texts)))
                    texts.append(text)
        units = [self.units([t])[:1] for t in texts]
        found = [Alternative([u for m, i in part if not m for u in units[i]], [u for m, i in part if m for u in units[i]]) for part in out]
        return [a for a in found if a.wanted]

    def search(self, query: str | list[Alternative], most: int | None = None, plain: bool = False) -> DataFrame:
        """(key, rank) of documents that match any alternative, the best first, then by key; ranks of several alternatives add up.

        A ``plain`` query asks for each of its words and has no marks.  A query
        without any word but stop words finds nothing.
        """
        if isinstance(query, str):
            asked = [Alternative(self.units([w for w in re.split(r"\s+", query) if w]))] if plain else self.parsed(query)
        else:
            asked = query
        asked = [a for a in asked if a.wanted]
        lists = self.postings(sorted({t for a in asked for u in (*a.wanted, *a.unwanted) for t, _ in u.terms}))
        found = lists.select("doc", F.lit(0.0).alias("rank")).where("false")
        for a in asked:
            found = found.unionByName(_ranked(lists, a))
        found = found.groupBy("doc").agg(F.sum("rank").alias("rank")).withColumnRenamed("doc", self.key)
        ordered = found.orderBy(F.desc("rank"), self.key)
        return ordered if most is None else ordered.limit(most)


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.hash(term), F.lit(buckets)).alias("bucket")


def term_of(word: Column, stemmed: bool) -> Column:
    """What a word is indexed as; null for a stop word."""
    return F.when(~word.isin(stemming.STOPWORDS), stemming.stem(word)) if stemmed else word


def _placed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, word, places) of every word of every document; a document's words are sorted and put together within its row, without a shuffle."""
    placed = F.sort_array(F.transform(words(F.col(text)), lambda w, i: F.struct(w.alias("word"), (i + 1).alias("at"))))

    def runs(s):
        first = F.filter(F.transform(s, lambda _, i: i), lambda i: (i == 0) | (F.get(s, i)["word"] != F.get(s, i - 1)["word"]))
        run = lambda b, at, j: F.struct(F.get(s, at)["word"].alias("word"), F.slice(s, at + 1, F.coalesce(F.get(b, j + 1), F.size(s)) - at)["at"].alias("places"))
        return stemming.let(first, lambda b: F.transform(b, lambda at, j: run(b, at, j)))

    return docs.select(F.col(key).alias("doc"), F.explode(stemming.let(placed, runs)).alias("w")).select("doc", "w.word", "w.places")


def _least_frequent(terms: DataFrame) -> tuple[int, int]:
    """How many documents a word of ``terms`` (docs) must have so that BROADCAST_WORDS words at most do, and how many postings the others have."""
    least, room, rare = None, BROADCAST_WORDS, 0
    for docs, n in sorted(map(tuple, terms.groupBy("docs").count().collect()), reverse=True):
        room -= n
        if room >= 0:
            least = docs
        else:
            rare += docs * n
            least = docs + 1 if least is None else least
    return least or 1, rare


def build(docs: DataFrame, key: str, text: str, folder: str, stemmed: bool = True, buckets: int = 64, workspace: Workspace | None = None) -> TextIndex:
    """Index ``text`` of ``docs`` (unique by ``key``) into a new folder; null texts have no words."""
    spark, workspace, kind = docs.sparkSession, workspace or Workspace(docs.sparkSession, "index"), docs.schema[key].dataType.simpleString()
    docs.select(F.col(key).alias("doc"), F.coalesce(F.size(words(F.col(text))), F.lit(0)).alias("words")).write.parquet(f"{folder}/lengths")
    total = spark.read.schema(f"doc {kind}, words int").parquet(f"{folder}/lengths").agg(F.sum("words")).first()[0] or 0
    parts = max(math.ceil(total / PART_WORDS), min(PARTS, math.ceil(total / LEAST_WORDS)), 1)
    # texts are dealt, not the postings made of them, which are many times larger
    rows = _placed(docs.select(key, text).repartition(parts, key), key, text)
    gaps = F.transform("places", lambda p, i: F.when(i == 0, p).otherwise(p - F.get("places", i - 1)))
    write = lambda rows, mode: rows.sortWithinPartitions("bucket", "term", "doc").write.mode(mode).partitionBy("bucket").parquet(f"{folder}/postings")
    if stemmed:
        # every word is stemmed once; the table keeps its stems from being worked out again for a filter or for each document
        found = docs.select(F.explode(F.array_distinct(words(F.col(text)))).alias("word")).where(~F.col("word").isin(stemming.STOPWORDS)).groupBy("word").agg(F.count("*").alias("docs"))
        terms = workspace.save(found.select("word", term_of(F.col("word"), stemmed).alias("term"), "docs"))
        least, rare = _least_frequent(terms)
        rows = rows.where(~F.col("word").isin(stemming.STOPWORDS)).join(F.broadcast(terms.where(F.col("docs") >= least).select("word", "term")), "word", "left")
        rows = rows.select("doc", F.coalesce("term", "word").alias("term"), gaps.alias("gaps"), F.when(F.col("term").isNull(), RARE).otherwise(bucket_of(F.col("term"), buckets)).alias("bucket"))
        write(rows, "errorifexists")
        if rare:
            path = f"{folder}/postings/bucket={RARE}"
            waiting = spark.read.schema(f"doc {kind}, term string, gaps array<int>").parquet(path)
            waiting.workspace_path = path
            stems = terms.where(F.col("docs") < least).select("word", F.col("term").alias("stem"))
            mended = waiting.join(stems.hint("merge"), F.col("term") == F.col("word")).select("doc", F.col("stem").alias("term"), "gaps", bucket_of(F.col("stem"), buckets))
            write(mended.repartition(math.ceil(rare / PART_WORDS), "doc"), "append")
            workspace.drop(waiting)
        workspace.drop(terms)
    else:
        write(rows.select("doc", F.col("word").alias("term"), gaps.alias("gaps"), bucket_of(F.col("word"), buckets)), "errorifexists")
    spark.createDataFrame([(json.dumps({"key": key, "buckets": buckets, "stemmed": stemmed, "kind": kind}),)], "value string").coalesce(1).write.text(f"{folder}/about")
    return TextIndex(spark, folder)


def _matches(lists: DataFrame, units: list[Unit]) -> DataFrame:
    """(doc, unit, start, end): every place of every unit, by documents that have all terms of it."""
    terms = sorted({t for u in units for t, _ in u.terms})
    name = {t: f"t{i}" for i, t in enumerate(terms)}
    wide = lists.where(F.col("term").isin(terms)).groupBy("doc").agg(*[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(n) for t, n in name.items()])

    def starts(unit: Unit) -> Column:
        shifted = lambda t, at: F.transform(F.coalesce(name[t], F.array().cast("array<int>")), lambda p: p - at)
        out, *others = [shifted(t, at) for t, at in unit.terms]
        for s in others:
            out = F.array_intersect(out, s)
        return out

    def spans(i: int, unit: Unit) -> Column:
        return F.transform(starts(unit), lambda s: F.struct(F.lit(i).alias("unit"), s.alias("start"), (s + (unit.size() - 1)).alias("end")))

    every = F.flatten(F.array(*[spans(i, u) for i, u in enumerate(units)]))
    return wide.select("doc", F.explode(every).alias("m")).select("doc", "m.*")


def _ranked(lists: DataFrame, asked: Alternative) -> DataFrame:
    """(doc, rank) of one alternative's documents."""
    upto = Window.partitionBy("doc").orderBy("end", "start", "unit")
    found = _matches(lists, asked.wanted)
    if asked.unwanted:
        found = found.join(_matches(lists, asked.unwanted).select("doc").distinct(), "doc", "left_anti")
    # the latest start of each unit up to here; the earliest of them begins the shortest stretch that ends here
    sofar = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = [F.max(F.when(F.col("unit") == i, F.col("start"))).over(sofar) for i in range(len(asked.wanted))]
    begins = F.least(*latest) if len(latest) > 1 else latest[0]
    complete = F.when(~F.exists(F.array(*latest), lambda x: x.isNull()), begins)
    covers = found.select("doc", "end", complete.alias("from"), F.row_number().over(upto).alias("_n")).where("from is not null")
    fresh = covers.withColumn("_before", F.lag("from").over(Window.partitionBy("doc").orderBy("_n"))).where("_before is null or from > _before")
    between = F.greatest(F.col("end") - F.col("from") + 1 - sum(u.size() for u in asked.wanted), F.lit(0))
    return fresh.groupBy("doc").agg(F.sum(WEIGHT / (1 + between)).alias("rank"))
