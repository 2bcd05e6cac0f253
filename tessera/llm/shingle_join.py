"""Size-aware heavy-light Jaccard join on word shingles.

A document's set holds the hashes of its distinct k-word shingles.  The join
finds, exactly, which sets are connected by links of Jaccard similarity at
least ``threshold``:

1. *Order.* Document frequencies of all shingles of all documents put the most
   frequent ones (at most ``FREQUENT_LIMIT``, so the broadcast is bounded) last
   in a global order.  Any total order keeps the join exact; this one keeps
   inverted lists short.
2. *Signatures.* Two linked sets of sizes n and m share a shingle among the
   first ``n - ceil(t n) + 1`` of each, and two among one more.  A small (light)
   set lists all 2-subsets of its longer prefix, a large (heavy) set posts each
   shingle of its prefix to that shingle's inverted list, and small sets within
   reach of a large one post there too.  The boundary between small and large
   minimises the expected number of rows, from the histogram of set sizes.
3. *Stars, then the rest.* In each list every member is paired with its first
   and last member only; verified links give components.  What then remains are
   pairs of one list whose components differ: they are compared in blocks
   inside tasks, by a parity sketch that can only reject pairs below the
   threshold, and survivors are verified exactly.  No list is cut off.

Sets are compared once per distinct set, so copies cost one row each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.frequent import most_frequent
from tessera.llm.textarrays import Words, flat_bytes, mix, plain, sequence_hash, slices
from tessera.operators.components import connected_components
from tessera.plans.workspace import Workspace

#: Shingles in more documents than this may be called frequent; at most so many of them, the most frequent, are.
FREQUENT_FROM, FREQUENT_LIMIT = 32, 1 << 20
#: Bits of the parity sketch of a small set; larger sets have twice their size, as a power of two.
SKETCH_BITS = 512
#: Largest size at which a set may count as small.
LIGHT_MOST = 512
#: Smallest signatures of a set that tell which of several common lists returns a pair.
SAMPLE = 8
#: Members of a list compared with one another in one go.
BLOCK = 512
#: Most rows of 8 bytes that are broadcast.
BROADCAST_ROWS = 2_000_000
#: Rows that one task of the frequency count takes, in documents.
BUCKET_DOCUMENTS = 256


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased); of fewer than k words, the whole sequence."""
    for at, to in slices(texts):
        words = Words(*flat_bytes(texts.slice(at, to - at)), lower=True)
        hashes, starts = words.windows(k)
        bounds = np.searchsorted(starts, words.first)
        for i in range(to - at):
            own = hashes[bounds[i] : bounds[i + 1]]
            if len(own):
                own = np.sort(own)
                yield own[np.concatenate(([True], own[1:] != own[:-1]))]
            else:
                few = words.hashes[words.first[i] : words.first[i + 1]]
                yield sequence_hash([few[j : j + 1] for j in range(len(few))]) if len(few) else own


def text_key(text: str):
    """What stands for a text in joins: two 64-bit hashes of different beginnings."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))


def _prefix(n: int, num: int, subset: int) -> int:
    """How many first shingles of a set of size n two linked sets share ``subset`` of."""
    return min(n, n - -(-num * n // 100) + subset)


def _set_id(own: np.ndarray) -> bytes:
    salted = mix(own ^ np.uint64(0x5851F42D4C957F2D))
    return np.array([own.sum(), salted.sum() + np.uint64(len(own))], np.uint64).tobytes()


def _sketch(own: np.ndarray) -> bytes:
    bits = max(SKETCH_BITS, 1 << (2 * len(own) - 1).bit_length())
    return np.packbits(np.bincount((own >> np.uint64(20)).astype(np.int64) % bits, minlength=bits).astype(np.uint8) & 1).tobytes()


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (64-bit words along the last axis) as they'd be with fewer bits."""
    while sketches.shape[-1] > words:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


def _frequencies(docs: DataFrame, text: str, k: int, bits: int) -> DataFrame:
    """(token, df) of shingles in FREQUENT_FROM documents or more, by 24 + bits leading bits, with each bucket's sum of squares as token null."""

    def cut(batches):
        for batch in batches:
            texts = plain(batch.column(0))
            held, size = [], 0
            sets = shingle_sets(texts, k)
            for own in sets:
                held.append(own)
                size += len(own)
                if size >= 1 << 20:
                    yield pack(held)
                    held, size = [], 0
            if size:
                yield pack(held)

    def pack(held):
        tokens = np.concatenate(held)
        tokens.sort()
        cuts = np.searchsorted(tokens, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        short = ((tokens >> np.uint64(40 - bits)) & np.uint64(0xFFFFFF)).astype("<u4")
        parts = np.split(short.view(np.uint8).reshape(-1, 4)[:, :3], cuts)
        rows = [(b, p.tobytes()) for b, p in enumerate(parts) if len(p)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "tokens"])

    def count(key, table):
        packed = np.frombuffer(b"".join(table.column("tokens").to_pylist()), np.uint8).reshape(-1, 3)
        tokens = np.zeros((len(packed), 4), np.uint8)
        tokens[:, :3] = packed
        found, df = np.unique(tokens.view("<u4").ravel(), return_counts=True)
        often = df >= FREQUENT_FROM
        rare = df[~often].astype(np.float64)
        token = found[often].astype(np.int64) + (int(key[0].as_py()) << 24)
        return pa.table({"token": pa.array([*token.tolist(), None], pa.int64()), "df": pa.array([*df[often].astype(np.float64).tolist(), float((rare * rare).sum())], pa.float64()), "of": pa.array([*np.zeros(often.sum()).tolist(), float(rare.sum())], pa.float64())})

    return docs.select(text).mapInArrow(cut, "bucket int, tokens binary").groupBy("bucket").applyInArrow(count, "token long, df double, of double")


def _leading(tokens: np.ndarray, frequent: np.ndarray, bits: int, most: int) -> np.ndarray:
    """The first shingles of a sorted set in the global order."""
    if len(frequent):
        short = tokens >> np.uint64(40 - bits)
        at = np.minimum(np.searchsorted(frequent, short), len(frequent) - 1)
        often = frequent[at] == short
        if often.any():
            tokens = np.concatenate((tokens[~often], tokens[often]))
    return tokens[:most]


def _boundary(histogram: dict[int, int], num: int, partners: float) -> int:
    """The size up to which sets count as small, at least cost in rows."""
    light = {n: math.comb(_prefix(n, num, 2), 2) for n in range(2, LIGHT_MOST + 1)}
    heavy = {n: _prefix(n, num, 1) * (1 + 4 * partners) for n in range(1, LIGHT_MOST + 1)}
    best, least = 1, math.inf
    for bound in range(1, LIGHT_MOST + 1):
        reach = -(-num * (bound + 1) // 100)
        cost = sum(c * (light.get(n, 0) * (n <= bound) + heavy[n] * (n >= min(reach, bound + 1) or n == 1)) for n, c in histogram.items() if n <= LIGHT_MOST)
        if cost < least:
            best, least = bound, cost
    return best


def _signatures(prefix: np.ndarray, n: int, num: int, bound: int) -> np.ndarray:
    out = []
    if 2 <= n <= bound:
        head = prefix[: _prefix(n, num, 2)]
        i, j = np.triu_indices(len(head), 1)
        a, b = np.minimum(head[i], head[j]), np.maximum(head[i], head[j])
        out.append(sequence_hash([a, b]))
    if n == 1 or n > bound or n * 100 >= num * (bound + 1):
        out.append(prefix[: _prefix(n, num, 1)])
    return np.concatenate(out).view(np.int64)


def shingle_components(docs: DataFrame, text: str = "text", k: int = 5, threshold: int = 80, workspace: Workspace | None = None) -> DataFrame:
    """``docs`` with ``set_id`` binary, ``n_shingles`` long and ``component`` binary.

    Documents link when ``100 * |A & B| >= threshold * |A | B|``; documents with
    equal sets link with each other.  ``component`` is equal for documents that
    links connect.  Null and blank texts have no shingles, and null as
    ``set_id`` and ``component``.  Repeated rows stay; other columns
    are kept, but for earlier ones of the three names, which are replaced.
    """
    spark = docs.sparkSession
    workspace = workspace or Workspace(spark, "shingles")
    bits = min(20, max(4, math.ceil(math.log2(max(1, docs.count()) / BUCKET_DOCUMENTS + 1))))

    counted = workspace.save(_frequencies(docs, text, k, bits))
    squares, total = counted.where("token is null").agg(F.sum("df"), F.sum("of")).first()
    partners = (squares or 0) / max(1.0, total or 0) - 1 if total else 0.0
    top = most_frequent(counted.where("token is not null"), "df", "token", FREQUENT_LIMIT).select("token").toArrow()
    shared = spark.sparkContext.broadcast(np.sort(top.column(0).to_numpy()).astype(np.uint64))

    def describe(batches):
        for batch in batches:
            frequent = shared.value
            ids, sizes, prefixes, sketches = [], [], [], []
            for own in shingle_sets(plain(batch.column(0)), k):
                n = len(own)
                sizes.append(n)
                ids.append(_set_id(own) if n else None)
                sketches.append(_sketch(own) if n else None)
                prefixes.append(_leading(own, frequent, bits, _prefix(n, threshold, 2)).tobytes() if n else None)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(prefixes, pa.binary()), pa.array(sketches, pa.binary())], ["text_key", "n", "set_id", "prefix", "sketch"])

    keyed = docs.select(F.col(text).alias("text"), text_key(text).alias("text_key"))
    described = workspace.save(keyed.mapInArrow(describe, "text_key struct<a:long,b:long>, n long, set_id binary, prefix binary, sketch binary"))
    named = workspace.save(described.select("text_key", "n", "set_id").distinct())
    # the table is written once, so each set keeps its number
    sets = workspace.save(described.where("n > 0").dropDuplicates(["set_id"]).select("set_id", "n", "prefix", "sketch", F.monotonically_increasing_id().alias("set")))
    workspace.drop(described, counted)

    histogram = {r["n"]: r["c"] for r in sets.where(F.col("n") <= LIGHT_MOST).groupBy("n").agg(F.count("*").alias("c")).collect()}
    bound = _boundary(histogram, threshold, partners)

    def post(batches):
        for batch in batches:
            prefixes, sizes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [_signatures(np.frombuffer(p, np.uint64), n, threshold, bound) for p, n in zip(prefixes, sizes, strict=True)]
            counts = [len(x) for x in found]
            index = np.repeat(np.arange(len(found)), counts)
            signature = np.concatenate(found) if found else np.zeros(0, np.int64)
            for at in range(0, max(1, len(index)), 1 << 17):
                part = pa.array(index[at : at + (1 << 17)])
                yield pa.RecordBatch.from_arrays([pa.array(signature[at : at + (1 << 17)]), batch.column(0).take(part), batch.column(2).take(part)], ["signature", "set", "n"])

    postings = sets.select("set", "prefix", "n").mapInArrow(post, "signature long, set long, n long")
    repeated = workspace.save(postings.groupBy("signature").count().where("count > 1").select("signature", F.col("count").alias("c")))
    few = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    lists = workspace.save(postings.join(few, "signature"))

    ends = lists.groupBy("signature").agg(F.min("set").alias("low"), F.max("set").alias("high"))
    stars = lists.join(ends, "signature").select("set", F.explode(F.array("low", "high")).alias("end")).where("set <> end")
    stars = stars.select(F.least("set", "end").alias("a"), F.greatest("set", "end").alias("b")).distinct()
    body = docs.select(F.col(text).alias("text"), text_key(text).alias("_key"))
    links = workspace.save(_verified(body, k, threshold, _sketched(stars, sets, threshold), sets, named, workspace))
    parts = connected_components(links, "a", "b", workspace)

    labelled = lists.join(parts.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    mixed = labelled.groupBy("signature").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("c")).where("x <> y and c > 2").select("signature")
    left = workspace.save(labelled.join(mixed, "signature", "left_semi"))
    more = workspace.save(_verified(body, k, threshold, _rest(left, sets, threshold), sets, named, workspace))
    workspace.drop(lists, repeated, left)
    if more.limit(1).count():
        parts = connected_components(links.union(more), "a", "b", workspace)
    known = sets.select("set", "set_id")
    parts = parts.join(known, F.col("node") == F.col("set")).select("set_id", "component")
    parts = parts.join(known.select("set", F.col("set_id").alias("root")), F.col("component") == F.col("set")).select("set_id", F.col("root").alias("component"))
    tagged = docs.drop("set_id", "n_shingles", "component").withColumn("_key", text_key(text)).join(named.withColumnRenamed("text_key", "_key").withColumnRenamed("n", "n_shingles"), "_key", "left").drop("_key")
    return tagged.join(parts, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))


def _sketched(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs of sets within reach that their parity sketches don't rule out: sets differ in at least as many shingles as sketches in bits."""
    side = lambda x: sets.select(F.col("set").alias(x), F.col("n").alias(f"n_{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    drawn = lambda x: sets.select(F.col("set").alias(x), F.col("sketch").alias(f"s_{x}"))
    both = near.join(drawn("a"), "a").join(drawn("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def agree(batches):
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            differ = np.zeros(len(n), np.int64)
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                words = min(len(x), len(y))
                differ[i] = np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum()
            yield batch.select(["a", "b"]).filter(pa.array(_may_link(n, m, differ, threshold)))

    return both.mapInArrow(agree, "a long, b long").distinct()


def _may_link(n, m, differ, threshold: int):
    """Linked sets have 100 * (n + m - d) >= threshold * (n + m + d) for d shingles in one set only."""
    return (100 + threshold) * differ <= (100 - threshold) * (n + m)


def _verified(body: DataFrame, k: int, threshold: int, pairs: DataFrame, sets: DataFrame, named: DataFrame, workspace: Workspace) -> DataFrame:
    """The pairs that link, from the whole sets of the texts involved."""
    pairs = workspace.save(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct().join(sets.select("set", "set_id"), "set")
    wanted = workspace.save(named.join(wanted, "set_id").groupBy("set", "set_id").agg(F.min("text_key").alias("_key")))
    keys = F.broadcast(wanted.select("_key")) if wanted.count() <= BROADCAST_ROWS else wanted.select("_key")

    def whole(batches):
        for batch in batches:
            texts = plain(batch.column(0))
            for at, to in slices(texts):
                part = list(shingle_sets(texts.slice(at, to - at), k))
                bounds = np.append(0, np.cumsum([len(x) for x in part])).astype(np.int32)
                tokens = pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(part).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([_set_id(x) for x in part], pa.binary()), tokens], ["set_id", "tokens"])

    texts = body.join(keys, "_key", "left_semi").dropDuplicates(["_key"]).select("text")
    full = texts.mapInArrow(whole, "set_id binary, tokens array<long>").join(wanted.select("set", "set_id"), "set_id").select("set", "tokens")
    full = workspace.save(full)
    both = pairs.join(full.select(F.col("set").alias("a"), F.col("tokens").alias("x")), "a").join(full.select(F.col("set").alias("b"), F.col("tokens").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= threshold * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _rest(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs of one list in different components that sketches don't rule out, found block against block.

    Every set carries its SAMPLE smallest signatures.  Where those of a pair have
    one in common, only the list of the smallest such one returns the pair.
    """
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    sample = members.groupBy("set").agg(F.slice(F.array_sort(F.collect_list("signature")), 1, SAMPLE).alias("sample"))
    dealt = dealt.join(sets.select("set", "sketch").join(sample, "set"), "set").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("signature", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set", "n", "component", "sample", "sketch")

    def compare(key, table):
        block, ids, n, component = (table.column(c).to_numpy() for c in ("block", "set", "n", "component"))
        drawn = [np.frombuffer(x, np.uint64) for x in table.column("sketch").to_pylist()]
        words = np.array([len(x) for x in drawn])
        # sketches by their length, also folded to half, as sizes within reach differ by one doubling at most
        at = {w: np.stack([_folded(x, w) if len(x) in (w, 2 * w) else np.zeros(w, np.uint64) for x in drawn]) for w in np.unique(words)}
        samples = [set(x) for x in table.column("sample").to_pylist()]
        own, i, j = key[0].as_py(), key[1].as_py(), key[2].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = [], []
        for x in left:
            near = right[(component[right] != component[x]) & (100 * np.minimum(n[right], n[x]) >= threshold * np.maximum(n[right], n[x]))]
            near = near[near > x] if i == j else near
            for w in np.unique(np.minimum(words[near], words[x])):
                some = near[np.minimum(words[near], words[x]) == w]
                differ = np.bitwise_count(at[w][some] ^ at[w][x]).sum(1).astype(np.int64)
                some = some[_may_link(n[some], n[x], differ, threshold)]
                some = np.array([y for y in some.tolist() if min(samples[x] & samples[y], default=own) >= own], np.int64)
                a.append(np.minimum(ids[some], ids[x]))
                b.append(np.maximum(ids[some], ids[x]))
        return pa.table({"a": np.concatenate(a) if a else np.zeros(0, np.int64), "b": np.concatenate(b) if b else np.zeros(0, np.int64)})

    return dealt.groupBy("signature", "i", "j").applyInArrow(compare, "a long, b long").distinct()
