"""The best documents for each of many texts, by Fagin's threshold algorithm.

The index has two sides, both Parquet: for each term its postings in order of
impact (what the term adds to a document's score, but for the term's weight), and
for each document its terms and their counts.  A round reads the next stretch of
every list, the same length for all terms (``DEPTH`` entries, then ``GROWTH`` times
as many each round), looks up the documents it met there on the other side, and
scores them whole.  What is unread of a list can't add more than the largest impact
left in it; the sum of those over a text's terms is its threshold.  A text is done
when the threshold is strictly below its k-th score, so that no unread document can
even tie, or when its lists are used up.

Lists are cut at classes of impact, which histograms by term give; so the round of
a posting is known before the lists are dealt, and they are written by round: a
round reads its own files only.  Documents are scored against all texts of a block
that aren't done; a task keeps its k best of each.  Texts are taken in blocks of
about ``BLOCK`` terms, so what is broadcast has a bound, while every block meets all documents.

A term is identified by a 64-bit hash.  All scores are whole numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.textarrays import LOWER, Words, flat_bytes, plain, slices
from tessera.plans.workspace import Workspace

#: Entries of a list read in the first round, and how many times more are read with each.
DEPTH, GROWTH = 16, 8
#: (Text, term) pairs of a block.
BLOCK = 1 << 17
#: Impacts that differ in these low bits only are read in one go.
CLASS_BITS = 12
#: Documents looked up by a broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
#: Scores that a task holds at once, and parts of scores that it adds up at once (but for those of a single document).
CELLS, PARTS = 1 << 20, 1 << 20
#: b = 0.75 and k1 = 0.8 of the score, in hundredths and thousandths.
LENGTH_PART, SATURATION = 75, 8

_TERM = np.full(256, 0x20, np.uint8)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = LOWER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]]


def _terms(column: pa.Array):
    """For slices of a text column: (first row, Words of the terms)."""
    column = plain(column)
    for a, b in slices(column):
        data, offsets = flat_bytes(column.slice(a, b - a))
        yield a, Words(_TERM[data], offsets)


def _counted(owner: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, what) pairs in order, and how often each occurs."""
    order = np.lexsort((what, owner))
    owner, what = owner[order], what[order]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (what[1:] != what[:-1]))) if len(what) else np.zeros(0, int)
    return owner[first], what[first], np.diff(np.append(first, len(what)))


def text_terms(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, times) of each text."""

    def split(batches):
        for batch in batches:
            for a, words in _terms(batch.column(1)):
                owner, term, times = _counted(words.owner(), words.hashes.view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner + a)), pa.array(term), pa.array(times)], [key, "term", "times"])

    return texts.select(key, text).mapInArrow(split, f"{key} long, term long, times long")


def forward_index(docs: DataFrame, terms: np.ndarray, key: str, text: str) -> DataFrame:
    """(doc_id, n, terms, times) of each document with a term: how many there are with repeats, and those among ``terms`` (sorted hashes) by their places there."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def index(batches):
        terms = known.value
        for batch in batches:
            for a, words in _terms(batch.column(1)):
                at = np.minimum(np.searchsorted(terms, hashes := words.hashes.view(np.int64)), len(terms) - 1)
                hit = np.flatnonzero(terms[at] == hashes)
                owner, term, times = _counted(words.owner()[hit], at[hit])
                n = words.counts()
                some = np.flatnonzero(n)
                ends = np.searchsorted(owner, some + 1)
                starts = np.searchsorted(owner, some)
                bounds = pa.array(np.append(starts, ends[-1:] if len(ends) else 0).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (term, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some + a)), pa.array(n[some].astype(np.int64)), *lists], ["doc_id", "n", "terms", "times"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(index, "doc_id long, n long, terms array<int>, times array<int>")


def impact(times: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What an occurrence count adds for each unit of its term's weight: 10^9 tf div (1000 tf + 8 m), m = 25 + 75 n N div L."""
    m = 100 - LENGTH_PART + (LENGTH_PART * n * documents) // length
    return (1_000_000_000 * times) // (1000 * times + SATURATION * m)


@dataclass
class Block:
    """Some texts and what is known of their terms; all are arrays by text or term."""

    texts: np.ndarray
    #: Pairs in order of term: where a term's begin, and the texts' places and the times of each pair.
    first: np.ndarray
    text: np.ndarray
    times: np.ndarray
    documents: int = 0
    length: int = 1
    weight: np.ndarray | None = None
    #: For each term and round, the class from which the round reads, and the largest impact that is left after it.
    cut: np.ndarray | None = None
    left: np.ndarray | None = None

    def pairs_of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs of some terms, and for each the place of its term in ``terms``."""
        count = self.first[terms + 1] - self.first[terms]
        whose = np.repeat(np.arange(len(terms)), count)
        return np.arange(len(whose)) - np.repeat(np.cumsum(count) - count, count) + self.first[terms][whose], whose

    def thresholds(self, at: int) -> np.ndarray:
        """Each text's threshold after a round."""
        out = np.zeros(len(self.texts), np.int64)
        term = np.repeat(np.arange(len(self.weight)), np.diff(self.first))
        np.add.at(out, self.text, self.times * self.weight[term] * self.left[term, at])
        return out


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _impacts(batch: pa.RecordBatch, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of the forward index: each posting's row in the batch, term and impact."""
    owner = np.repeat(np.arange(len(batch)), batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
    n = batch.column("n").to_numpy(zero_copy_only=False)
    return owner, _flat(batch, "terms"), impact(_flat(batch, "times"), n[owner], block.documents, block.length)


def _plan_rounds(histogram, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts and largest impacts left, from (term, class, count, largest impact): a round ends with the class that reaches its depth."""
    order = np.lexsort((-histogram["class"], histogram["term"]))
    term, klass, count, top = (histogram[x][order].astype(np.int64) for x in ("term", "class", "count", "top"))
    upto = np.cumsum(count)
    start = np.searchsorted(term, np.arange(terms))
    before = upto - count - np.append(0, upto)[start][term]
    depths = [DEPTH]
    while depths[-1] <= (before.max() if len(before) else 0):
        depths.append(depths[-1] * GROWTH)
    round_ = np.searchsorted(np.array(depths), before, "right")
    cut, left = np.zeros((terms, len(depths)), np.int64), np.zeros((terms, len(depths)), np.int64)
    for r in range(len(depths)):
        cut[:, r] = np.iinfo(np.int64).max
        np.minimum.at(cut[:, r], term[round_ <= r], klass[round_ <= r])
        np.maximum.at(left[:, r], term[round_ > r], top[round_ > r])
    return cut, left


def _best(item, score, none, doc, row, k: int) -> np.ndarray:
    """Places of the k best of each item: highest score, then smallest doc (none last), then row."""
    order = np.lexsort((row, doc, none, -score, item))
    item = item[order]
    first = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, int)
    rank = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
    return order[rank < k]


def scored(found: DataFrame, block, open_texts: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
    """(item, score, doc_id, row): a task's k best documents of each open text among rows of the forward index, none below ``least``."""
    sent = found.sparkSession.sparkContext.broadcast((open_texts, least))

    def score(batches):
        known, (open_texts, least) = block.value, sent.value
        place = np.full(len(known.texts), -1)
        place[open_texts] = np.arange(len(open_texts))
        held = [np.zeros(0, np.int64) for _ in range(5)]
        most = max(1, CELLS // max(1, len(open_texts)))
        fan = np.diff(known.first)

        def pieces():
            for whole in batches:
                for a in range(0, len(whole), most):
                    batch = whole.slice(a, most)
                    ends = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
                    parts = np.append(0, np.cumsum(fan[_flat(batch, "terms")]))[ends]
                    at = 0
                    while at < len(batch):
                        to = int(np.searchsorted(parts, (parts[at - 1] if at else 0) + PARTS, "right"))
                        yield batch.slice(at, max(to, at + 1) - at)
                        at = max(to, at + 1)

        for batch in pieces():
            owner, term, points = _impacts(batch, known)
            pair, whose = known.pairs_of(term)
            item = place[known.text[pair]]
            pair, whose, item = (x[item >= 0] for x in (pair, whose, item))
            cells = np.zeros(len(batch) * len(open_texts), np.int64)
            np.add.at(cells, owner[whose] * len(open_texts) + item, known.times[pair] * known.weight[term[whose]] * points[whose])
            cell = np.flatnonzero(cells)
            at, item = cell // max(1, len(open_texts)), cell % max(1, len(open_texts))
            cell, at, item = (x[cells[cell] >= least[item]] for x in (cell, at, item))
            doc = batch.column("doc_id")
            none, row = doc.is_null().to_numpy(zero_copy_only=False)[at], batch.column("row").to_numpy()[at]
            new = [item, cells[cell], none.astype(np.int64), doc.fill_null(0).to_numpy()[at], row]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            keep = _best(*held, k)
            held = [x[keep] for x in held]
        item, score, none, doc, row = held
        yield pa.RecordBatch.from_arrays([pa.array(known.texts[open_texts[item]]), pa.array(score), pa.array(doc, mask=none.astype(bool)), pa.array(row)], ["item", "score", "doc_id", "row"])

    return found.select("doc_id", "n", "terms", "times", "row").mapInArrow(score, "item long, score long, doc_id long, row long")


def _search_block(docs: DataFrame, key: str, text: str, pairs: DataFrame, k: int, workspace: Workspace) -> DataFrame | None:
    """(item, score, doc_id, row) of the k best documents for the texts of (item, term, times)."""
    sc = docs.sparkSession.sparkContext
    got = pairs.toArrow()
    item, term, times = (got.column(x).to_numpy() for x in ("item", "term", "times"))
    if not len(item):
        return None
    order = np.argsort(term, kind="stable")
    terms = np.unique(term)
    texts, place = np.unique(item, return_inverse=True)
    block = Block(texts, np.append(np.searchsorted(term[order], terms), len(term)), place[order], times[order])
    forward = workspace.save(forward_index(docs, terms, key, text).withColumn("row", F.monotonically_increasing_id()))
    sums = forward.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    if not sums.documents:
        return None
    block.documents, block.length = sums.documents, sums.length
    shared = sc.broadcast(block)

    def histogram(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            _, term, points = _impacts(batch, shared.value)
            where = (term << 20) | (points >> CLASS_BITS)
            keys, inverse = np.unique(where, return_inverse=True)
            tops = np.zeros(len(keys), np.int64)
            np.maximum.at(tops, inverse, points)
            yield pa.RecordBatch.from_arrays([pa.array(keys >> 20), pa.array(keys & 0xFFFFF), pa.array(np.bincount(inverse, minlength=len(keys))), pa.array(tops)], ["term", "class", "count", "top"])

    # at most 2^20 / 2^CLASS_BITS rows for each term of the block
    classes = forward.mapInArrow(histogram, "term long, class long, count long, top long").groupBy("term", "class").agg(F.sum("count").alias("count"), F.max("top").alias("top")).toArrow()
    classes = {c: classes.column(c).to_numpy() for c in classes.column_names}
    df = np.zeros(len(terms), np.int64)
    np.add.at(df, classes["term"], classes["count"])
    block.weight = np.floor(1000 * np.log((2 * block.documents + 2) / (2 * df + 1))).astype(np.int64)
    block.cut, block.left = _plan_rounds(classes, len(terms))
    shared = sc.broadcast(block)

    def postings(batches):
        known = shared.value
        for batch in batches:
            owner, term, points = _impacts(batch, known)
            keep = np.flatnonzero(known.weight[term] > 0)
            owner, term, points = owner[keep], term[keep], points[keep]
            klass = points >> CLASS_BITS
            round_ = np.zeros(len(term), np.int32)
            for r in range(known.cut.shape[1]):
                round_ += klass < known.cut[term, r]
            yield pa.RecordBatch.from_arrays([pa.array(round_), pa.array(term.astype(np.int32)), pa.array(points.astype(np.int32)), batch.column("row").take(pa.array(owner))], ["round", "term", "impact", "row"])

    lists = forward.mapInArrow(postings, "round int, term int, impact int, row long")
    order = ["round", "term", F.desc("impact"), "row"]
    lists = workspace.save(lists.repartitionByRange(*order).sortWithinPartitions(*order), by=["round"])
    open_texts, best = np.arange(len(texts)), None
    least, full = np.ones(len(texts), np.int64), np.zeros(len(texts), bool)
    for r in range(block.cut.shape[1]):
        reading = lists.where(F.col("round") == r)
        asked = np.zeros(len(terms), bool)
        asked[np.repeat(np.arange(len(terms)), np.diff(block.first))[np.isin(block.text, open_texts)]] = True
        if not asked.all():
            wanted = docs.sparkSession.createDataFrame(pa.table({"term": np.flatnonzero(asked).astype(np.int32)}))
            reading = reading.join(F.broadcast(wanted), "term", "left_semi")
        met = workspace.save(reading.select("row").distinct())
        few = F.broadcast(met) if met.count() <= BROADCAST_ROWS else met
        new = scored(forward.join(few, "row", "left_semi"), shared, open_texts, least[open_texts], k)
        every = new if best is None else new.unionByName(best).dropDuplicates(["item", "row"])
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row"))
        before, best = best, workspace.save(every.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))
        workspace.drop(met, *([before] if before is not None else []))
        kth = best.groupBy("item").agg(F.count("*").alias("c"), F.min("score").alias("s")).where(F.col("c") == k).toArrow()
        at = np.searchsorted(texts, kth.column("item").to_numpy())
        full[at], least[at] = True, kth.column("s").to_numpy()
        threshold = block.thresholds(r)
        open_texts = np.flatnonzero((threshold > 0) & ~(full & (threshold < least)))
        if not len(open_texts):
            break
    workspace.drop(forward, lists)
    return best


def search(docs: DataFrame, texts: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", asked: str = "text", workspace: Workspace | None = None) -> DataFrame:
    """(item, rank, doc_id, score): the ``k`` best documents of each text, best first, equal scores by ascending doc_id (null last).

    Terms are runs of digits, letters a-z in either case and any characters beyond
    ASCII.  Only documents with a term count, and only scores above 0 are given.  A
    text that is null, or shares no term of weight above 0 with any document, has no
    rows.  Every row is a document or text of its own, also if it is repeated or its
    id is; equal ids of one score are listed one after another.  Texts are read
    whole; other columns are ignored.  Without documents or texts there are no rows.
    """
    spark, workspace = docs.sparkSession, workspace or Workspace(docs.sparkSession, "search")
    rows = workspace.save(texts.select(F.col(item).alias("name"), F.col(asked).alias("text")).withColumn("item", F.monotonically_increasing_id()))
    pairs = workspace.save(text_terms(rows, "item", "text"))
    blocks = -(-pairs.count() // BLOCK)
    found = None
    for b in range(blocks):
        mine = pairs if blocks == 1 else pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        best = _search_block(docs, key, text, mine, k, workspace)
        found = best if found is None else found if best is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "item long, score long, doc_id long, row long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")).cast("int")
    return found.withColumn("rank", rank).join(rows.select("item", "name"), "item").select(F.col("name").alias(item), "rank", "doc_id", "score")
