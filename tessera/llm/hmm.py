"""A hidden Markov language model, trained by Baum-Welch over all learning documents.

Tokens are lower-cased words and one end token a document.  The ``SYMBOLS`` most
frequent words and the end are symbols of their own; every other word belongs to
one of ``CLASSES`` classes by its ending, and its probability within the class
is ``(c + 1) / (tokens + words + 1)`` of the class.

Word counts come from all learning documents.  Those of the ``LOOKUP`` most
frequent words are broadcast (a fixed bound); rarer words are looked up by a
join on the word.  Each round of Baum-Welch reads the learning documents'
symbols, runs scaled forward and backward recursions over passages of
``PASSAGE`` tokens side by side, and adds up expected counts across partitions.
Scores come from the scaled forward recursion over whole documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.frequent import most_frequent
from tessera.llm.textarrays import Words, flat_bytes, plain, slices
from tessera.plans.workspace import Workspace

STATES = 6
ROUNDS = 8
#: How much likelier than another a state's first following state is itself.
STAY = 40
SYMBOLS = 1 << 15
CLASSES = 64
LOOKUP = 1 << 19
PASSAGE = 256
#: Passages side by side.
ABREAST = 2048
#: Numbers in a block of expected counts, and parts of a block that are added up in one go.
BLOCK, FAN = 512, 256
_HELD = 1 << 20
_CLASS = np.uint64(CLASSES - 1)


def word_keys(words: Words) -> np.ndarray:
    """A word's hash with its class (from its last two bytes) in the low bits."""
    last = words.data[words.ends - 1].astype(np.uint64)
    before = np.where(words.ends - words.starts > 1, words.data[np.maximum(words.ends - 2, 0)], 0).astype(np.uint64)
    return ((words.hashes & ~_CLASS) | ((before * np.uint64(31) + last) & _CLASS)).view(np.int64)


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, n) of every word in ``text``."""

    def count(batches):
        held, size = [], 0

        def flush():
            keys, where = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            n = np.bincount(where, np.concatenate([h[1] for h in held])).astype(np.int64)
            for at in range(0, len(keys), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 17)]), pa.array(n[at : at + (1 << 17)])], ["key", "n"])

        for batch in batches:
            texts = plain(batch.column(0))
            for a, b in slices(texts):
                held.append(np.unique(word_keys(Words(*flat_bytes(texts.slice(a, b - a)), lower=True)), return_counts=True))
                size += len(held[-1][0])
                if size > _HELD:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return docs.select(text).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """What of the word counts every task needs."""

    keys: np.ndarray
    n: np.ndarray
    #: Symbol of each key: its own for the most frequent, else its class's.
    symbol: np.ndarray
    own: int
    ends: int
    tokens: int
    distinct: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    @property
    def symbols(self) -> int:
        return self.own + CLASSES + 1

    def unigrams(self) -> np.ndarray:
        first = np.zeros(self.own)
        some = self.symbol < self.own
        first[self.symbol[some]] = self.n[some]
        return np.concatenate((first, self.class_tokens + 1, [self.ends + 1]))


def gather(vocabulary: DataFrame, documents: int) -> Counts:
    top = most_frequent(vocabulary, "n", "key", LOOKUP).toArrow()
    keys, n = top.column("key").to_numpy(), top.column("n").to_numpy()
    ranked = np.lexsort((keys, -n))
    keys, n = keys[ranked], n[ranked]
    own = min(SYMBOLS, len(keys))
    symbol = np.where(np.arange(len(keys)) < own, np.arange(len(keys)), own + (keys & int(_CLASS)))
    of_class = vocabulary.groupBy(F.col("key").bitwiseAND(F.lit(int(_CLASS))).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in of_class:
        class_n[r["c"]], class_v[r["c"]] = r["n"], r["v"]
    tokens, distinct = int(class_n.sum()) + documents, int(class_v.sum()) + (documents > 0)
    class_n -= np.bincount(keys[:own] & int(_CLASS), n[:own], CLASSES)
    class_v -= np.bincount(keys[:own] & int(_CLASS), minlength=CLASSES)
    order = np.argsort(keys)
    return Counts(keys[order], n[order], symbol[order], own, documents, tokens, distinct, class_n, class_v)


@dataclass
class Model:
    start: np.ndarray
    #: Where a passage begins that isn't a document's first.
    between: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    def pack(self) -> np.ndarray:
        return np.concatenate([self.start, self.between, self.step.ravel(), self.emit.ravel()])


def unpack(flat: np.ndarray, states: int) -> Model:
    a, b, c = states, 2 * states, 2 * states + states * states
    return Model(flat[:a], flat[a:b], flat[b:c].reshape(states, states), flat[c:].reshape(-1, states))


def first_model(unigrams: np.ndarray, states: int, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    # states that last, with words spread unevenly over them, soon part into kinds of text and of word
    emit = unigrams[:, None] * np.exp(rng.standard_normal((len(unigrams), states)))
    step = 1 + rng.random((states, states)) + STAY * np.eye(states)
    even = np.full(states, 1 / states)
    return Model(even, even, step / step.sum(1, keepdims=True), emit / emit.sum(0))


def expected(model: Model, symbols: np.ndarray, bounds: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, float]:
    """Expected counts (packed as a model) over passages, and their log likelihood."""
    states, total = len(model.start), np.zeros(len(model.pack()))
    counts, ll = unpack(total, states), 0.0
    order = np.argsort(-np.diff(bounds), kind="stable")
    for at in range(0, len(order), ABREAST):
        rows = order[at : at + ABREAST]
        starts, lengths, lead = bounds[rows], np.diff(bounds)[rows], first[rows]
        longest = int(lengths[0])
        active = np.searchsorted(-lengths, -np.arange(longest), "left")
        alphas, emits, scales, found = [], [], [], []
        alpha = np.where(lead[:, None], model.start, model.between)
        for t in range(longest):
            a = active[t]
            s = symbols[starts[:a] + t]
            e = model.emit[s]
            alpha = (alpha[:a] @ model.step if t else alpha[:a]) * e
            c = alpha.sum(1)
            alpha /= c[:, None]
            ll += float(np.log(c).sum())
            alphas.append(alpha)
            emits.append(e)
            scales.append(c)
            found.append(s)
        beta = np.ones((0, states))
        gammas = []
        for t in range(longest - 1, -1, -1):
            full = np.ones((active[t], states))
            if t + 1 < longest:
                onward = emits[t + 1] * beta / scales[t + 1][:, None]
                counts.step += alphas[t][: len(onward)].T @ onward
                full[: len(onward)] = onward @ model.step.T
            beta = full
            gammas.append(alphas[t] * beta)
        counts.start += gammas[-1][lead].sum(0)
        gamma, found = np.concatenate(gammas), np.concatenate(found[::-1])
        counts.between += gamma.sum(0)
        for k in range(states):
            counts.emit[:, k] += np.bincount(found, gamma[:, k], len(counts.emit))
    counts.step *= model.step
    return total, ll


def updated(counts: Model, unigrams: np.ndarray) -> Model:
    share = unigrams / unigrams.sum()
    emit = counts.emit + 5 * share[:, None]
    norm = lambda x: (x + 0.1) / (x + 0.1).sum(-1, keepdims=True)
    return Model(norm(counts.start), norm(counts.between), norm(counts.step), emit / emit.sum(0))


def likelihoods(model: Model, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each whole sequence, by the scaled forward recursion."""
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = bounds[:-1][order], lengths[order]
    ll = np.zeros(len(order))
    longest = int(lengths[0]) if len(order) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), "left")
    alpha = np.tile(model.start, (len(order), 1))
    for t in range(longest):
        a = active[t]
        alpha = (alpha[:a] @ model.step if t else alpha[:a]) * model.emit[symbols[starts[:a] + t]]
        c = alpha.sum(1)
        alpha /= c[:, None]
        ll[:a] += np.log(c)
    out = np.zeros(len(order))
    out[order] = ll
    return out


def _symbol_batches(column: pa.Array):
    flat = np.frombuffer(b"".join(column.to_pylist()), "<u2").astype(np.int64)
    sizes = np.array([len(x) // 2 for x in column.to_pylist()], np.int64)
    return flat, np.append(0, np.cumsum(sizes))


def train(encoded: DataFrame, counts: Counts, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the ``symbols`` of all rows."""
    sc, unigrams = encoded.sparkSession.sparkContext, counts.unigrams()
    model = first_model(unigrams, states)
    size = len(model.pack())

    def step(shared):
        def run(batches):
            model, total = unpack(shared.value, states), np.zeros(size)
            for batch in batches:
                flat, bounds = _symbol_batches(batch.column(0))
                cuts = [np.arange(a, b, PASSAGE) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                first = np.concatenate([np.arange(len(c)) == 0 for c in cuts]) if cuts else np.zeros(0, bool)
                if len(first):
                    total += expected(model, flat, np.append(np.concatenate(cuts), len(flat)), first)[0]
            parts = range(0, size, BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([p // BLOCK for p in parts], pa.int32()), pa.array([TaskContext.get().partitionId() // FAN] * len(parts), pa.int32()), pa.array([total[p : p + BLOCK].tobytes() for p in parts], pa.binary())], ["block", "fan", "part"])

        return run

    def add(key, table):
        total = np.sum([np.frombuffer(x, np.float64) for x in table.column("part").to_pylist()], 0)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "fan": pa.array([0], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    kind = "block int, fan int, part binary"
    symbols = encoded.select("symbols")
    levels = 2 if symbols.rdd.getNumPartitions() > FAN else 1
    for _ in range(rounds):
        shared = sc.broadcast(model.pack())
        parts = symbols.mapInArrow(step(shared), kind)
        for _ in range(levels):
            parts = parts.groupBy("block", "fan").applyInArrow(add, kind)
        parts = parts.collect()
        flat = np.zeros(size)
        for r in parts:
            part = np.frombuffer(r["part"], np.float64)
            flat[r["block"] * BLOCK : r["block"] * BLOCK + len(part)] = part
        model = updated(unpack(flat, states), unigrams)
        shared.unpersist()
    return model


def score(docs: DataFrame, learning, text: str = "text", states: int = STATES, rounds: int = ROUNDS, workspace: Workspace | None = None) -> DataFrame:
    """``docs`` without ``text``, with n_tokens, n_known, train_tokens, base_score and score.

    ``learning`` is a condition on the rows that the model learns from; null
    counts as false.  A null or blank text has the end token alone.  base_score
    is the unigram log10 probability with one added to every count, score that of
    the hidden Markov model.  Repeated rows are scored alike; earlier columns of
    the five names are replaced.
    """
    workspace = workspace or Workspace(docs.sparkSession, "hmm")
    sc = docs.sparkSession.sparkContext
    docs = docs.drop("n_tokens", "n_known", "train_tokens", "base_score", "score")
    marked = docs.withColumn("_learns", F.coalesce(learning, F.lit(False)))
    learners = marked.where("_learns")
    vocabulary = workspace.save(count_words(learners, text))
    counts = gather(vocabulary, learners.count())
    shared = sc.broadcast(counts)
    kept = [c for c in marked.columns if c != text]

    def encode(batches):
        counts = shared.value
        logs = np.log10(counts.n + 1.0)
        inside = np.log10(counts.class_tokens + counts.class_words + 1)
        for batch in batches:
            texts = plain(batch.column(batch.schema.names.index(text)))
            for a, b in slices(texts):
                words = Words(*flat_bytes(texts.slice(a, b - a)), lower=True)
                n, keys, owner = words.counts(), word_keys(words), words.owner()
                found, where = np.unique(keys, return_inverse=True)
                at = np.minimum(np.searchsorted(counts.keys, found), max(0, len(counts.keys) - 1))
                known = counts.keys[at] == found if len(counts.keys) else np.zeros(len(found), bool)
                symbol = np.where(known, counts.symbol[at] if len(counts.keys) else 0, counts.own + (found & int(_CLASS)))[where]
                plus = np.where(known, logs[at] if len(counts.keys) else 0.0, 0.0)[where]
                known = known[where]
                classed = symbol >= counts.own
                within = np.where(classed, inside[np.maximum(symbol - counts.own, 0)], 0.0) if len(symbol) else np.zeros(0)
                total = lambda x: np.bincount(owner, x, len(n))  # noqa: E731, B023
                every = np.insert(symbol, words.first[1:], counts.own + CLASSES).astype("<u2")
                bounds = words.first + np.arange(len(n) + 1)
                tail = np.flatnonzero(~known)
                cuts = np.searchsorted(owner[tail], np.arange(len(n) + 1))
                added = [
                    pa.array(n + 1),
                    pa.array(total(known).astype(np.int64) + (counts.ends > 0)),
                    pa.array(total(plus) + np.log10(counts.ends + 1.0)),
                    pa.array(total(np.where(classed, plus - within, 0.0))),
                    pa.array([every[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(n))], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(keys[tail])),
                ]
                carried = batch.slice(a, b - a).select(kept)
                yield pa.RecordBatch.from_arrays([*carried.columns, *added], [*kept, "_tokens", "_known", "_plus", "_inner", "symbols", "_tail"])

    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.select(kept).schema)
    encoded = marked.mapInArrow(encode, f"{carried}, _tokens long, _known long, _plus double, _inner double, symbols binary, _tail array<long>")
    encoded = workspace.save(encoded.withColumn("_row", F.monotonically_increasing_id()))

    rare = encoded.select("_row", F.explode("_tail").alias("key")).join(vocabulary, "key")
    rare = workspace.save(rare.groupBy("_row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("_rare"), F.count("*").alias("_found")))
    # a word of no learning document adds log10(0 + 1) = 0
    model = sc.broadcast(train(encoded.where("_learns"), counts, states, rounds))

    def forward(batches):
        for batch in batches:
            ll = likelihoods(model.value, *_symbol_batches(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ll / np.log(10))], ["_row", "_ll"])

    scored = encoded.select("_row", "symbols").mapInArrow(forward, "_row long, _ll double")
    all_of = encoded.drop("symbols", "_tail", "_learns").join(scored, "_row").join(rare, "_row", "left").fillna(0, ["_rare", "_found"])
    base = F.col("_plus") + F.col("_rare") - F.col("_tokens") * F.log10(F.lit(float(counts.tokens + counts.distinct + 1)))
    return all_of.select(
        *[c for c in kept if c != "_learns"],
        F.col("_tokens").alias("n_tokens"),
        (F.col("_known") + F.col("_found")).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("_ll") + F.col("_inner") + F.col("_rare")).alias("score"),
    )
