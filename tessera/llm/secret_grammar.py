"""Secrets in texts: fixed patterns, and formats inferred from what these find.

The fixed patterns (``assign``, ``access`` and ``hex``) label credentials.  For each
kind, and for plain candidates that no pattern covers, grammar inference (ALERGIA;
Carrasco and Oncina, 1994) makes a probabilistic automaton: credentials form a
prefix tree with counts; its states are taken in order of count and merged with the
most similar earlier state that they are statistically compatible with, by
Hoeffding's bound on the frequencies of every next character and of the end, also
of the states that follow; a state without such a partner stays.

Every candidate of every text is then scored by all automata.  It is a secret of a
kind, ``<kind>_like``, if it has a length that labelled ones have, is as likely for
its length as they are, and if of the strings like it, labelled or not, a share of
``SHARE`` is labelled: by the two likelihoods, and by how many labelled and plain
candidates the whole corpus has.  (What isn't labelled may well be a secret, so the
share needn't be near 1.)

Automata are fitted to at most ``TRAIN`` distinct strings of a kind, each of at most
``LONGEST`` characters (those of the smallest hash; plain ones count in proportion to their occurrences); candidates and
labelled ones are counted over all texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textarrays import RangeHash, plain, slices
from tessera.plans.workspace import Workspace

#: Distinct strings of a kind that an automaton is fitted to, and the fewest that it is fitted to.
TRAIN, FEWEST = 2000, 20
#: Chance of taking two like states for different ones.
ALPHA = 0.05
#: Of strings like a secret, the share that must be labelled.
SHARE = 0.05
#: Shortest candidate that can be told by its format.
SHORTEST = 12
#: Longer strings don't teach: one of them would outweigh all others.
LONGEST = 256
#: Share of labelled credentials that may be less likely, for their length, than what is found.
TAIL = 0.01

#: The patterns that decide at once, with the group and the length that count.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KINDS = ["assign", "access", "hex"]
LEAST = {"assign": 6, "access": 20, "hex": 24}
PLAIN = "plain"

_CHARACTERS = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "+/_.-="
#: Symbol of a code point below 128; len(_CHARACTERS) for any other.
SYMBOL = np.full(129, len(_CHARACTERS), np.int64)
SYMBOL[[ord(c) for c in _CHARACTERS]] = np.arange(len(_CHARACTERS))
_END = len(_CHARACTERS)


def _mask(characters: str) -> np.ndarray:
    out = np.zeros(129, bool)
    out[[ord(c) for c in characters]] = True
    return out


_HEX, _UPPER = _mask("0123456789abcdef"), _mask(_CHARACTERS[:36])
_INNER, _EDGE = _mask(_CHARACTERS[:-1]), _mask(_CHARACTERS[:62])


@cache
def _letter() -> np.ndarray:
    """Code points beyond ASCII that are letters or digits: a candidate doesn't touch one."""
    return np.array([c > 127 and chr(c).isalnum() for c in range(0x110000)])


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Texts:
    """Code points of some texts in a row, each after a line end, and what lies in them."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        self.first = np.append(0, np.cumsum([len(t) + 1 for t in texts])) + 1
        self.small, self.points = np.minimum(points, 128).astype(np.uint8), points

    def owner(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, "right") - 1

    def base(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, place of the kind, start of the credential itself) of what the fixed patterns find."""
        found = []
        for i, text in enumerate(self.texts):
            if ("=" in text or ":" in text) and any(w in (low := text.lower()) for w in ("passw", "secret", "token", "apikey", "api_key")):
                at = self.first[i]
                found += [(m.start() + at, m.end() + at, 0, m.start(2) + at) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
        rows = [np.array(found, np.int64).reshape(-1, 4)]
        s = self.small
        key = np.flatnonzero((s[:-3] == 65) & (s[1:-2] == 75) & (s[2:-1] == 73) & (s[3:] == 65))
        if len(key):
            starts, ends = _runs(_UPPER[s])
            run = np.searchsorted(starts, key, "right") - 1
            run, first = np.unique(run, return_index=True)
            rows.append(np.stack((key[first], ends[run], np.full(len(run), 1), key[first]), 1)[ends[run] - key[first] >= LEAST["access"]])
        starts, ends = _runs(_HEX[s])
        keep = ends - starts >= LEAST["hex"]
        rows.append(np.stack((starts[keep], ends[keep], np.full(keep.sum(), 2), starts[keep]), 1))
        every = np.concatenate(rows)
        every = every[np.lexsort((every[:, 2], every[:, 0]))]
        return every[:, 0], every[:, 1], every[:, 2], every[:, 3]

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of runs of letters, digits and + / _ . - that begin and end with a letter or digit, and don't touch other letters."""
        inner, edge = _INNER[self.small], _EDGE[self.small]
        starts, ends = _runs(inner)
        # trimmed: the first letter or digit from the start, the last one before the end
        at = np.arange(len(edge))
        following = np.minimum.accumulate(np.where(edge, at, len(edge))[::-1])[::-1]
        last = np.maximum.accumulate(np.where(edge, at, -1))
        outside = _letter()[self.points]
        free = ~outside[starts - 1] & ~outside[np.minimum(ends, len(outside) - 1)]
        a, b = following[starts], last[ends - 1] + 1
        keep = free & (b - a >= SHORTEST)
        return a[keep], b[keep]

    def text_at(self, start: int, end: int) -> str:
        i = int(self.owner(np.array([start]))[0])
        return self.texts[i][start - self.first[i] : end - self.first[i]]


def uncovered(a: np.ndarray, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which ranges [a, b) meet none of the ranges [starts, ends), these in order of start."""
    reach = np.append(0, np.maximum.accumulate(ends)) if len(ends) else np.zeros(1, int)
    return reach[np.searchsorted(starts, b, "left")] <= a


@dataclass
class Automaton:
    """Transitions and log2 probabilities by state and symbol; the last symbol is the end, the last state knows nothing."""

    go: np.ndarray
    bits: np.ndarray
    lengths: tuple[int, int] = (0, 0)
    #: Least bits a symbol.
    floor: float = -np.inf

    def likelihood(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log2 probability of each range of ``symbols``, with its end."""
        order = np.argsort(starts - ends, kind="stable")
        starts, lengths = starts[order], (ends - starts)[order]
        state, total = np.zeros(len(starts), np.int64), np.zeros(len(starts))
        active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
        for j, n in enumerate(active):
            symbol = symbols[starts[:n] + j]
            total[:n] += self.bits[state[:n], symbol]
            state[:n] = self.go[state[:n], symbol]
        total += self.bits[state, _END]
        out = np.empty(len(starts))
        out[order] = total
        return out


def _symbols(text: str) -> list[int]:
    return SYMBOL[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 128)].tolist()


def infer(strings: list[str], weights: list[int] | None = None) -> Automaton:
    """The automaton of some strings, each counted as often as its weight says (once): their prefix tree with compatible states merged."""
    count, stop, go = [0], [0], [{}]
    uses: list[dict[int, int]] = [{}]
    for text, weight in zip(strings, weights or [1] * len(strings), strict=True):
        at = 0
        count[0] += weight
        for s in _symbols(text):
            if s not in go[at]:
                go[at][s] = len(count)
                count.append(0), stop.append(0), go.append({}), uses.append({})
            uses[at][s] = uses[at].get(s, 0) + weight
            at = go[at][s]
            count[at] += weight
        stop[at] += weight
    reach = np.sqrt(0.5 * np.log(2 / ALPHA))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            bound = reach * (count[a] ** -0.5 + count[b] ** -0.5)
            if abs(stop[a] / count[a] - stop[b] / count[b]) > bound:
                return False
            for s in uses[a].keys() | uses[b].keys():
                if abs(uses[a].get(s, 0) / count[a] - uses[b].get(s, 0) / count[b]) > bound:
                    return False
            todo += [(go[a][s], go[b][s]) for s in go[a].keys() & go[b].keys()]
        return True

    def apart(a: int, b: int) -> float:
        return abs(stop[a] / count[a] - stop[b] / count[b]) + sum(abs(uses[a].get(s, 0) / count[a] - uses[b].get(s, 0) / count[b]) for s in uses[a].keys() | uses[b].keys())

    def fold(a: int, b: int) -> None:
        """b, the root of a tree, into a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            count[a] += count[b]
            stop[a] += stop[b]
            for s, n in uses[b].items():
                uses[a][s] = uses[a].get(s, 0) + n
                if s in go[a]:
                    todo.append((go[a][s], go[b][s]))
                else:
                    go[a][s] = go[b][s]

    settled = [0]
    while True:
        known = set(settled)
        open_ = {t: (s, x) for s in settled for x, t in go[s].items() if t not in known}
        if not open_:
            break
        b = max(open_, key=lambda t: (count[t], -t))
        fits = [a for a in settled if compatible(a, b)]
        if fits:
            a = min(fits, key=lambda a: (apart(a, b), -a))
            s, x = open_[b]
            go[s][x] = a
            fold(a, b)
        else:
            settled.append(b)
    place, n, wide = {s: i for i, s in enumerate(settled)}, len(settled), _END + 1
    # the end, and characters a state hasn't shown, lead to the state that knows nothing
    table, bits = np.full((n + 1, wide), n), np.full((n + 1, wide), -np.log2(wide))
    for s, i in place.items():
        seen = dict(uses[s]) | ({_END: stop[s]} if stop[s] else {})
        total, new = sum(seen.values()), wide - len(seen)
        bits[i] = np.log2(len(seen) / (total + len(seen)) / max(1, new))
        for x, c in seen.items():
            bits[i, x] = np.log2(c / (total + (len(seen) if new else 0)))
            if x != _END:
                table[i, x] = place[go[s][x]]
    return Automaton(table, bits)


def labelled(docs: DataFrame, text: str, workspace: Workspace) -> DataFrame:
    """(kind, hash, value, n): of each task, its distinct strings of each kind with the TRAIN smallest hashes and how often they occur, and a row without a string for how many there were.

    A string that is among the smallest of all is so in each task from its first occurrence on, so its count is whole.
    """

    def collect(batches):
        sample: dict[str, dict[int, tuple[str, int]]] = {k: {} for k in [*KINDS, PLAIN]}
        counts = dict.fromkeys(sample, 0)
        for batch in batches:
            column = plain(batch.column(0))
            for i, j in slices(column):
                found = Texts(column.slice(i, j - i).to_pylist())
                start, end, kind, inner = found.base()
                a, b = found.candidates()
                free = uncovered(a, b, start, end)
                hashes = RangeHash(found.small)
                for name, x, y in [*((k, inner[kind == p], end[kind == p]) for p, k in enumerate(KINDS)), (PLAIN, a[free], b[free])]:
                    counts[name] += len(x)
                    x, y = x[y - x <= LONGEST], y[y - x <= LONGEST]
                    own, h = sample[name], hashes(x, y)
                    if len(own) >= TRAIN:
                        near = np.flatnonzero(h <= np.uint64(max(own)))
                        x, y, h = x[near], y[near], h[near]
                    h, first, times = np.unique(h, return_index=True, return_counts=True)
                    for v, p, n in zip(h[:TRAIN].tolist(), first[:TRAIN].tolist(), times[:TRAIN].tolist(), strict=True):
                        own[v] = (own[v][0], own[v][1] + n) if v in own else (found.text_at(x[p], y[p]), n)
                    sample[name] = {v: own[v] for v in sorted(own)[:TRAIN]}
        rows = [(k, v - (1 << 63), s, n) for k, own in sample.items() for v, (s, n) in own.items()] + [(k, 0, None, n) for k, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], ["kind", "hash", "value", "n"])

    return workspace.save(docs.select(text).mapInArrow(collect, "kind string, hash long, value string, n long"))


@dataclass
class Model:
    """Automata by kind; ``odds`` has the bits by which plain candidates outnumber a kind."""

    automata: dict[str, Automaton]
    odds: dict[str, float]


def learn(docs: DataFrame, text: str = "text", workspace: Workspace | None = None) -> Model:
    """Automata from what the fixed patterns find in ``docs``; none of a kind with fewer than FEWEST distinct strings, none at all without plain candidates."""
    rows = labelled(docs, text, workspace or Workspace(docs.sparkSession, "secrets"))
    counts = {r["kind"]: r["n"] for r in rows.where("value is null").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    summed = rows.where("value is not null").groupBy("kind", "hash", "value").agg(F.sum("n").alias("n"))
    strings = {k: {r["value"]: r["n"] for r in summed.where(F.col("kind") == k).orderBy("hash", "value").limit(TRAIN).collect()} for k in [*KINDS, PLAIN]}
    return fit(strings, counts)


def fit(strings: dict[str, dict[str, int]], counts: dict[str, int]) -> Model:
    """A model of strings with their occurrences by kind, given how many of each kind there are in all."""
    model = Model({}, {})
    for kind, times in strings.items():
        kept = {v: t for v in times if (t := v.strip("+/_.-=")) and (kind == PLAIN or len(t) >= SHORTEST)}
        values = list(dict.fromkeys(kept.values()))
        if len(values) < (1 if kind == PLAIN else FEWEST):
            continue
        if kind == PLAIN:
            # about TRAIN in all, in proportion to occurrences; the rarest still count once
            all_ = sum(times[v] for v in kept)
            values, weights = list(kept.values()), [-(-times[v] * TRAIN // all_) for v in kept]
            automaton = infer(values, weights)
        else:
            automaton = infer(values)
        flat = np.array([s for v in values for s in _symbols(v)], np.int64)
        ends = np.cumsum([len(v) for v in values])
        starts = ends - [len(v) for v in values]
        automaton.lengths = (min(map(len, values)), max(map(len, values)))
        automaton.floor = float(np.quantile(automaton.likelihood(flat, starts, ends) / (ends - starts + 1), TAIL))
        model.automata[kind] = automaton
        model.odds[kind] = float(np.log2(max(1, counts.get(PLAIN, 0)) / max(1, counts.get(kind, 0))))
    return model if PLAIN in model.automata else Model({}, {})


def _added(found: Texts, model: Model, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, place of the kind in KINDS) of candidates that are secrets by their format and meet none of the given ranges."""
    a, b = found.candidates()
    free = uncovered(a, b, start, end)
    a, b = a[free], b[free]
    symbols = SYMBOL[found.small]
    best, which = np.zeros(len(a)), np.full(len(a), -1)
    kinds = [k for k in KINDS if k in model.automata]
    if not kinds or not len(a):
        return a[:0], b[:0], which[:0]
    known = model.automata[PLAIN].likelihood(symbols, a, b)
    for kind in kinds:
        automaton = model.automata[kind]
        fits = np.flatnonzero((b - a >= automaton.lengths[0]) & (b - a <= automaton.lengths[1]))
        bits = automaton.likelihood(symbols, a[fits], b[fits])
        gain = bits - known[fits] - model.odds[kind] - np.log2(SHARE / (1 - SHARE))
        good = (bits / (b - a + 1)[fits] >= automaton.floor) & (gain > best[fits])
        best[fits[good]], which[fits[good]] = gain[good], KINDS.index(kind)
    chosen = which >= 0
    return a[chosen], b[chosen], which[chosen]


def scan(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_sha256 and spans (``kind:start:end`` of whole matches in code points, end exclusive, by start and kind, joined by commas).

    A null text is an empty one; texts are read whole, whatever their length;
    repeated rows are alike; columns of these names are replaced, others stay.  The spans of a format meet no span of a pattern.
    """
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    rest = [c for c in docs.columns if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*rest).schema
    for name in names:
        schema = schema.add(name, "long" if name.startswith("n_") else "string")
    place = rest.index(text)

    def spans(batches):
        for batch in batches:
            column = plain(batch.column(place))
            base, every, counts = [], [], []
            for i, j in slices(column):
                found = Texts(column.slice(i, j - i).to_pylist())
                start, end, kind, _ = found.base()
                a, b, like = _added(found, shared.value, start, end)
                s, e, k = np.append(start, a), np.append(end, b), np.append(kind, like + len(KINDS))
                order = np.lexsort((k, s))
                s, e, k = s[order], e[order], k[order]
                owner = found.owner(s)
                shift = found.first[owner]
                shown = [[] for _ in range(j - i)]
                for o, x, y, z in zip(owner.tolist(), (s - shift).tolist(), (e - shift).tolist(), k.tolist(), strict=True):
                    shown[o].append((z, f"{KINDS[z]}:{x}:{y}" if z < len(KINDS) else f"{KINDS[z - len(KINDS)]}_like:{x}:{y}"))
                for own in shown:
                    base.append(",".join(t for z, t in own if z < len(KINDS)))
                    every.append(",".join(t for _, t in own))
                    counts.append([sum(z == p for z, _ in own) for p in range(len(KINDS))])
            counts = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, counts.T), pa.array(base, pa.string()), pa.array(every, pa.string())], [*batch.schema.names, *names])

    return docs.select(*rest).mapInArrow(spans, schema).withColumn("base_sha256", F.sha2("base_sha256", 256))
