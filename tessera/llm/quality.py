"""Quality rules: fixed limits, then gradient-boosted trees over document statistics.

Statistics are computed for whole texts, a batch at a time.  The trees are
trained on at most ``SAMPLE_ROWS`` labelled documents and kept as flat arrays of
nodes, so scoring is a few gathers for each level of each tree.  Features listed
in ``FALLING`` can only lower the score: a split on them is refused where the
side of larger values would score higher.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.textarrays import SPACE, Words, flat_bytes, mix, plain, slices

#: Labelled documents that the trees are trained on, at most.
SAMPLE_ROWS = 20_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_DIGITS, _CAPITALS, _STOPS = (np.isin(np.arange(256), list(x)) for x in (b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".!?"))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "words_per_line", "digit_share", "capital_share", "stop_share", "symbol_words")
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "symbol_words")


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features) of each text, one row a text, in the order of COUNTS and FEATURES."""
    counts, features = [], []
    for at, to in slices(texts):
        data, offsets = flat_bytes(texts.slice(at, to - at))
        words, n = Words(data, offsets), to - at
        owner, n_words = words.owner(), words.counts()
        space = SPACE[data]
        first_byte = (data & 0xC0) != 0x80
        word_chars = _sums(first_byte & ~space, offsets)
        symbols = _sums(SYMBOLS[data], offsets)

        cuts = np.unique(np.concatenate((offsets[:-1], np.flatnonzero(data == 10) + 1)))
        cuts = cuts[cuts < len(data)]
        line_owner = np.searchsorted(offsets, cuts, "right") - 1
        ends = np.minimum(np.append(cuts[1:], len(data)), offsets[line_owner + 1])
        ends -= (ends > cuts) & (data[ends - 1] == 10) if len(cuts) else 0
        filled = np.zeros(len(data) + 1, np.int64)
        np.cumsum(~space, out=filled[1:])
        with_word = filled[ends] > filled[cuts]
        cuts, ends, line_owner = cuts[with_word], ends[with_word], line_owner[with_word]
        lines = np.bincount(line_owner, minlength=n)
        salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
        _, kept = np.unique(mix(words.range_hash(cuts, ends) ^ salt[line_owner]), return_index=True)
        dup_lines = lines - np.bincount(line_owner[kept], minlength=n)

        windows, start = words.windows(3)
        marked = np.zeros(len(owner) + 3, bool)
        if len(windows):
            again = start[_repeats(mix(windows ^ salt[owner[start]]))]
            for j in range(3):
                marked[again + j] = True
        repeated = np.bincount(owner[marked[: len(owner)]], minlength=n)
        _, kept = np.unique(mix(words.hashes ^ salt[owner]), return_index=True)
        distinct = np.bincount(owner[kept], minlength=n)
        symbol_words = np.bincount(owner[SYMBOLS[data[words.ends - 1]]], minlength=n) if len(owner) else np.zeros(n)

        counts.append(np.column_stack([n_words, word_chars, symbols, dup_lines, repeated]))
        some, chars, rows = (np.maximum(x, 1) for x in (n_words, word_chars, lines))
        features.append(np.column_stack([np.log1p(n_words), word_chars / some, symbols / chars, dup_lines / rows, repeated / some, distinct / some, np.log1p(n_words / rows), _sums(_DIGITS[data], offsets) / chars, _sums(_CAPITALS[data], offsets) / chars, _sums(_STOPS[data], offsets) / some, symbol_words / some]))
    if not counts:
        return np.zeros((0, len(COUNTS)), np.int64), np.zeros((0, len(FEATURES)))
    return np.concatenate(counts), np.concatenate(features)


@dataclass
class Trees:
    """Boosted trees as flat arrays of nodes; a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 50, depth: int = 3, rate: float = 0.2, bins: int = 64, smooth: float = 1.0) -> Trees:
    """Boosting with the logistic loss on quantile bins; see the module for constraints."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    signs = np.array([-1 if f in FALLING else 0 for f in FEATURES])
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    margin, nodes, roots = np.full(len(y), base), [], []

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = gradient[rows], hessian[rows]
        me = len(nodes)
        nodes.append([0, np.inf, me, me, rate * float(np.clip(g.sum() / (h.sum() + smooth), low, high))])
        best = (1e-6, None)
        if level < depth and len(rows) >= 20:
            for f, e in enumerate(edges):
                gs = np.cumsum(np.bincount(binned[rows, f], g, len(e) + 1))
                hs = np.cumsum(np.bincount(binned[rows, f], h, len(e) + 1))
                gl, hl, gr, hr = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
                vl, vr = gl / (hl + smooth), gr / (hr + smooth)
                gain = gl * vl + gr * vr - gs[-1] ** 2 / (hs[-1] + smooth)
                gain[(hl < 1e-3) | (hr < 1e-3) | (signs[f] * (vr - vl) < 0)] = 0
                if len(gain) and gain.max() > best[0]:
                    at = int(gain.argmax())
                    best = (gain[at], (f, at, float(np.clip(vl[at], low, high)), float(np.clip(vr[at], low, high))))
        if best[1]:
            f, at, vl, vr = best[1]
            middle = (vl + vr) / 2
            inner = {0: (low, high, low, high), -1: (middle, high, low, middle)}[int(signs[f])]
            goes = binned[rows, f] <= at
            children = grow(rows[goes], level + 1, *inner[:2]), grow(rows[~goes], level + 1, *inner[2:])
            nodes[me][:4] = [f, float(edges[f][at]), *children]
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = y - p, p * (1 - p)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
        tree = Trees(np.array(roots[-1:]), *(np.array(c) for c in zip(*nodes, strict=True)), depth, 0.0)
        p = tree.score(x)
        margin += np.log(p / (1 - p))
    return Trees(np.array(roots), *(np.array(c) for c in zip(*nodes, strict=True)), depth, base)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> Trees | None:
    """Trees from labelled documents: the SAMPLE_ROWS with the smallest hash of doc_id, of repeated ids at most SAMPLE_ROWS rows more.

    ``labels`` has doc_id and quality (1 good, 0 bad; null rows are left out).
    None if there is no document of either class.
    """
    few = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(few), "doc_id").select("quality", "text")

    def features(batches):
        for batch in batches:
            _, x = statistics(plain(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), *(pa.array(c) for c in x.T)], ["quality", *FEATURES])

    got = rows.mapInArrow(features, "quality int, " + ", ".join(f"{f} double" for f in FEATURES)).orderBy("quality", *FEATURES).limit(2 * SAMPLE_ROWS).toArrow()
    y = got.column(0).to_numpy().astype(np.float64)
    if not 0 < y.sum() < len(y):
        return None
    return train(np.column_stack([got.column(f).to_numpy() for f in FEATURES]), y)


def apply_rules(docs: DataFrame, trees: Trees | None, text: str = "text", least_score: float = 0.5, only_kept: bool = False) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``quality_score`` and ``kept``.

    base_failed: fewer than 50 words, or more than half the words in repeated
    3-word windows.  Others are kept if the trees score them ``least_score`` or
    more; without trees all are, with a null score.  A null text has no words.
    Earlier columns of these names are replaced.  ``only_kept`` leaves the
    columns as they were and returns the kept rows.
    """
    docs = docs if only_kept else docs.drop(*COUNTS, "base_failed", "quality_score", "kept")
    schema = T.StructType([*docs.schema, *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("quality_score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    at = docs.columns.index(text)

    def apply(batches):
        for batch in batches:
            counts, x = statistics(plain(batch.column(at)))
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            score = trees.score(x) if trees else None
            kept = ~failed & (score >= least_score) if trees else ~failed
            if only_kept:
                yield batch.filter(pa.array(kept))
                continue
            added = [*(pa.array(c) for c in counts.T), pa.array(failed), pa.array(score) if trees else pa.nulls(len(failed), pa.float64()), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], schema.names)

    return docs.mapInArrow(apply, docs.schema if only_kept else schema)
