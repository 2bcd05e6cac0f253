"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A language's profile is the order of its most frequent letter n-grams (one to
three letters, with word edges), counted over all learning documents.  A
document's own most frequent n-grams are compared with each profile: every
n-gram costs the difference of its two ranks, or ``PROFILE_SIZE`` where the
profile lacks it, and the language of the smallest sum wins.

How small the sum must be is learned as well: ``with_limits`` scores every
learning document against its own language, and ``identify`` can return only the
documents whose score isn't far below those.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.textarrays import plain, slices

#: N-grams in a profile, of a language or a document.
PROFILE_SIZE = 300
UNKNOWN = "und"
#: Stands for whatever isn't a letter; not a letter itself.
_EDGE = 1
#: A score is too low if it is below the lower quartile by more than FENCE interquartile ranges, and below the median times SHARE.
FENCE, SHARE = 3.0, 0.5
#: Scores are counted by this many steps.
_STEPS = 1000
#: Counted n-grams that a task holds before it hands them on.
_HELD = 2_000_000


@cache
def _letters() -> np.ndarray:
    """Code point to its lower-case letter, or to _EDGE."""
    table = np.full(0x110000, _EDGE, np.int64)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            table[c] = ord(low) if len(low := x.lower()) == 1 and low.isalpha() else c
    return table


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of some texts with single edges between words, and what follows the edge before each text."""
    lengths = np.array([len(t) + 1 for t in texts])
    symbols = _letters()[np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)]
    stays = np.append(True, (symbols[1:] != _EDGE) | (symbols[:-1] != _EDGE))
    bounds = np.cumsum(stays)[np.append(0, np.cumsum(lengths))]
    return symbols[stays], bounds


def _grams(s: np.ndarray) -> np.ndarray:
    """Codes of the n-grams of a run of symbols: 21 bits a symbol."""
    letter = s != _EDGE
    single = s[letter]
    double = ((s[:-1] << 21) | s[1:])[letter[:-1] | letter[1:]]
    triple = ((s[:-2] << 42) | (s[1:-1] << 21) | s[2:])[letter[1:-1]]
    return np.concatenate((single, double, triple))


def _ranked(codes: np.ndarray) -> np.ndarray:
    """The most frequent codes in order; of equally frequent ones the smaller first."""
    found, counts = np.unique(codes, return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:PROFILE_SIZE]]


def _class(n: int) -> int:
    """Texts of few n-grams score otherwise than long ones: classes by powers of 2."""
    return n.bit_length() - 1


@dataclass
class Profiles:
    languages: list[str]
    codes: np.ndarray
    #: Rank of each code in each language; PROFILE_SIZE where it isn't in the profile.
    ranks: np.ndarray
    #: Least score of a text by language and by _class of its number of n-grams; without it a score above 0 is enough.
    limits: np.ndarray | None = None

    def scored(self, texts: list[str]):
        """For each text its number of n-grams and its score in every language: 1 - distance / largest possible distance."""
        symbols, bounds = _symbols(texts)
        for i in range(len(texts)):
            own = symbols[bounds[i] - 1 : bounds[i + 1]]
            codes = _ranked(_grams(own)) if (own != _EDGE).any() else ()
            if not len(codes) or not self.languages:
                yield 0, None
                continue
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            known = self.codes[at] == codes
            apart = np.abs(self.ranks[at[known]] - np.flatnonzero(known)[:, None]).sum(0) + PROFILE_SIZE * int((~known).sum())
            # a code of another language's profile has rank PROFILE_SIZE here, and costs PROFILE_SIZE as well
            absent = self.ranks[at[known]] == PROFILE_SIZE
            apart = apart + (np.flatnonzero(known)[:, None] * absent).sum(0)
            yield len(codes), 1 - apart / (PROFILE_SIZE * len(codes))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The nearest language of each text and its score."""
        found = [(UNKNOWN, 0.0) if s is None else (self.languages[i := int(s.argmax())], float(s[i])) for _, s in self.scored(texts)]
        return [x for x, _ in found], [x for _, x in found]

    def known(self, texts: list[str]) -> list[bool]:
        """Whether the score of each text's nearest language is above 0 and not below its limit."""
        found = []
        for n, s in self.scored(texts):
            best = 0 if s is None else int(s.argmax())
            found.append(s is not None and s[best] > 0 and (self.limits is None or bool(s[best] >= self.limits[best, _class(n)])))
        return found


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles of every language in ``lang``; rows with a null language or text teach nothing."""

    def count(batches):
        held: dict[str, list] = {}
        size = 0

        def flush():
            nonlocal size
            for name, parts in held.items():
                codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                total = np.bincount(where, np.concatenate([p[1] for p in parts]))
                for at in range(0, len(codes), 1 << 18):
                    part = codes[at : at + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(part), pa.array(total[at : at + (1 << 18)].astype(np.int64))], ["lang", "gram", "n"])
            held.clear()
            size = 0

        for batch in batches:
            texts, names = plain(batch.column(0)), np.array(batch.column(1).to_pylist(), object)
            for at, to in slices(texts):
                part = texts.slice(at, to - at)
                for name in set(names[at:to]):
                    symbols, _ = _symbols(part.filter(pa.array(names[at:to] == name)).to_pylist())
                    if len(symbols) > 2:
                        got = _counted(symbols)
                        held.setdefault(name, []).append(got)
                        size += len(got[0])
                if size > _HELD:
                    yield from flush()
        yield from flush()

    rows = docs.select(F.col(text), F.col(lang)).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < PROFILE_SIZE).select("lang", "gram", "rank").collect()
    languages = sorted({r["lang"] for r in top})
    codes = np.array(sorted({r["gram"] for r in top}), np.int64)
    ranks = np.full((len(codes), len(languages)), PROFILE_SIZE)
    row, column = {c: i for i, c in enumerate(codes.tolist())}, {x: i for i, x in enumerate(languages)}
    for r in top:
        ranks[row[r["gram"]], column[r["lang"]]] = r["rank"]
    return Profiles(languages, codes, ranks)


def with_limits(profiles: Profiles, docs: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """``profiles`` with the least scores that the learning documents ``docs`` suggest.

    Quartiles are taken, so that mislabelled documents move a limit little.  A
    class of sizes without learning documents has the limit of the next smaller
    one, or 0.
    """
    names = {x: i for i, x in enumerate(profiles.languages)}
    classes = _class(PROFILE_SIZE) + 1

    def count(batches):
        for batch in batches:
            texts, langs, held = plain(batch.column(0)), batch.column(1).to_pylist(), {}
            for a, b in slices(texts):
                for x, (n, s) in zip(langs[a:b], profiles.scored(texts.slice(a, b - a).to_pylist()), strict=True):
                    if s is not None and x in names:
                        key = names[x], _class(n), int(s[names[x]] * _STEPS)
                        held[key] = held.get(key, 0) + 1
            if held:
                keys = list(zip(*held, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int32()) for k in keys), pa.array(list(held.values()), pa.int64())], ["lang", "class", "score", "n"])

    rows = docs.select(F.col(text), F.col(lang)).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = np.zeros((len(names), classes, _STEPS + 1), np.int64)
    for r in rows.mapInArrow(count, "lang int, class int, score int, n long").groupBy("lang", "class", "score").agg(F.sum("n").alias("n")).collect():
        counts[r["lang"], r["class"], r["score"]] = r["n"]
    limits = np.zeros((len(names), classes))
    for i in range(len(names)):
        for c in range(classes):
            below = counts[i, c].cumsum()
            if below[-1]:
                low, middle, high = (int(np.searchsorted(below, below[-1] * q)) / _STEPS for q in (0.25, 0.5, 0.75))
                limits[i, c] = max(0.0, min(low - FENCE * (high - low), SHARE * middle))
            elif c:
                limits[i, c] = limits[i, c - 1]
    return replace(profiles, limits=limits)


def _counted(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes and their counts; over a small alphabet by direct addressing."""
    alphabet = np.flatnonzero(np.bincount(symbols))
    v = len(alphabet)
    if v > 160:
        return np.unique(_grams(symbols), return_counts=True)
    small = np.zeros(alphabet[-1] + 1, np.int64)
    small[alphabet] = np.arange(v)
    s = small[symbols]
    letter = symbols != _EDGE
    found, counts = [], []
    for keys, back in (
        (s[letter], lambda k: alphabet[k]),
        ((s[:-1] * v + s[1:])[letter[:-1] | letter[1:]], lambda k: (alphabet[k // v] << 21) | alphabet[k % v]),
        (((s[:-2] * v + s[1:-1]) * v + s[2:])[letter[1:-1]], lambda k: (alphabet[k // v // v] << 42) | (alphabet[k // v % v] << 21) | alphabet[k % v]),
    ):
        n = np.bincount(keys)
        k = np.flatnonzero(n)
        found.append(back(k))
        counts.append(n[k])
    return np.concatenate(found), np.concatenate(counts)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", only_known: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``.

    A null text, or one without a letter, is ``und`` with score 0, as is every
    text if nothing was learned.  Of equally near languages the first by name
    wins.  Earlier columns of the two names are replaced.  ``only_known`` leaves
    the columns as they were and returns the rows in a language of the profiles:
    score above 0, and not below the profiles' limits if they have them.
    """
    docs = docs if only_known else docs.drop("lang_pred", "lang_score")
    schema = docs.schema if only_known else T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    at = docs.columns.index(text)

    def apply(batches):
        for batch in batches:
            texts, names, scores, keep = plain(batch.column(at)), [], [], []
            for a, b in slices(texts):
                part = texts.slice(a, b - a).to_pylist()
                if only_known:
                    keep += profiles.known(part)
                    continue
                got = profiles.predict(part)
                names += got[0]
                scores += got[1]
            if only_known:
                yield batch.filter(pa.array(keep, pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return docs.mapInArrow(apply, schema)


def teaching(doc_id: str = "doc_id"):
    """The remainder that deals documents into held-out (0) and learning ones."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5
