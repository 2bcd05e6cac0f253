"""Byte-level BPE encoding and decoding by batched merge rounds.

A batch of texts is cut into pretokens with array operations.  The distinct
pretokens not met before put their byte symbols into one flat array; each round
looks every adjacent pair up in the sorted pair keys by binary search, takes the
lowest rank in each pretoken and merges all its occurrences, until no pair of
any pretoken has a rank.  Texts are then put together from the pretokens' ids.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.textarrays import RangeHash, plain, slices

#: Distinct pretokens remembered by a worker, at most.
REMEMBERED = 1_000_000
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: The code points of Unicode's White_Space property.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SHIFT = np.int64(20)
_NO_RANK = np.int64(1 << 40)


@cache
def _classes() -> np.ndarray:
    kinds = np.array([{"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    kinds[_WHITE] = _SPACE
    return kinds


def pretoken_starts(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pretokens begin in the code points of some texts, by the usual byte-level BPE pattern.

    The pattern: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    """
    n = len(codes)
    kind = np.concatenate((_classes()[codes], np.full(4, _OTHER, np.uint8)))
    padded = np.concatenate((codes, np.zeros(4, codes.dtype)))
    edge = np.zeros(n + 4, bool)
    edge[bounds] = True
    start = edge.copy()
    start[1:n] |= kind[1:n] != kind[: n - 1]
    # the last white space before something else stands alone, and a blank joins what follows
    last = np.zeros(n + 4, bool)
    last[: n - 1] = (kind[: n - 1] == _SPACE) & (kind[1:n] != _SPACE) & ~edge[1:n]
    start |= last
    blank = np.flatnonzero(last & (padded == 0x20))
    start[blank + 1] = False
    # contractions, where an apostrophe begins a pretoken
    mark = np.flatnonzero((padded[:n] == 0x27) & start[:n])
    mark = mark[~edge[mark + 1]]
    one, two = padded[mark + 1], padded[mark + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ~edge[mark + 2] & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
    for at, size in ((mark[short], 2), (mark[long], 3)):
        start[at + 1] = False
        start[at + size] = True
    return np.flatnonzero(start[:n])


@cache
def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Encodes and decodes with one vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary, letters = content["model"]["vocab"], _byte_letters()
        self.special = {x["content"]: x["id"] for x in content["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocabulary.values(), *self.special.values()]) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = token.encode() if token in self.special else bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_ids[b] = vocabulary[letter]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in content["model"]["merges"]]
        keys = np.array([(vocabulary[a] << int(_SHIFT)) | vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.pair_ids = np.array([vocabulary[a + b] for a, b in pairs], np.int64)[order]
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def merged(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as ranges of bytes, and the bounds of each word's ids."""
        symbols, word = self.byte_ids[data], np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        done_ids, done_words = [], []
        while len(symbols):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            key = (symbols << _SHIFT) | np.append(symbols[1:], 0)
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            inner = np.append(word[1:] == word[:-1], False)
            rank = np.where(inner & (self.pair_keys[at] == key), self.pair_ranks[at], _NO_RANK)
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(symbols)))
            ended = np.repeat(least == _NO_RANK, sizes)
            if ended.any():
                done_ids.append(symbols[ended])
                done_words.append(word[ended])
            chosen = (rank == np.repeat(least, sizes)) & ~ended
            # of overlapping occurrences every other one, from the left
            position = np.flatnonzero(chosen)
            head = np.append(True, np.diff(position) > 1) if len(position) else np.zeros(0, bool)
            run = position[np.flatnonzero(head)][np.cumsum(head) - 1] if len(position) else position
            position = position[(position - run) % 2 == 0]
            symbols[position] = self.pair_ids[at[position]]
            keep = ~ended
            keep[position + 1] = False
            symbols, word = symbols[keep], word[keep]
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
        words = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        order = np.argsort(words, kind="stable")
        return ids[order], np.append(0, np.cumsum(np.bincount(words, minlength=len(bounds) - 1)))

    def pretokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each pretoken of some texts its number among the remembered ones, and the bounds of each text's pretokens."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        bounds = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        starts = pretoken_starts(codes, bounds) if len(codes) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(codes)).astype(np.int64)
        hashes = RangeHash(codes)(starts, ends) if len(codes) else np.zeros(0, np.uint64)
        if len(self.hashes) > REMEMBERED:
            self.forget()
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        new = np.flatnonzero(self.hashes[at] != hashes) if len(self.hashes) else np.arange(len(hashes))
        if len(new):
            found, where = np.unique(hashes[new], return_index=True)
            self._remember(found, codes, starts[new[where]], ends[new[where]])
            at = np.searchsorted(self.hashes, hashes)
        return self.slot[at], np.searchsorted(starts, bounds)

    def _remember(self, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        sizes = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        place = np.append(0, np.cumsum(sizes))
        data = np.frombuffer(codes.tobytes().decode("utf-32-le").encode(), np.uint8)
        lengths = place[ends] - place[starts]
        ids, bounds = self.merged(data[_spread(place[starts], lengths)], np.append(0, np.cumsum(lengths)))
        slots = (len(self.ends) - 1 + np.arange(len(hashes))).astype(np.int32)
        self.ends = np.concatenate((self.ends, len(self.ids) + bounds[1:]))
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        hashes, slots = np.concatenate((self.hashes, hashes)), np.concatenate((self.slot, slots))
        order = np.argsort(hashes)
        self.hashes, self.slot = hashes[order], slots[order]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the bounds of each text's ids; special tokens' strings become those tokens."""
        pieces, owner, special = self._without_special(texts)
        slots, bounds = self.pretokens(pieces)
        lengths = self.ends[slots + 1] - self.ends[slots]
        ids = self.ids[_spread(self.ends[slots], lengths)]
        sizes = np.append(0, np.cumsum(lengths))[bounds]
        if special is None:
            return ids, sizes
        parts = np.split(ids, sizes[1:-1])
        parts = [np.array([i]) if i >= 0 else part for part, i in zip(parts, special, strict=True)]
        counts = np.bincount(owner, [len(p) for p in parts], len(texts)).astype(np.int64)
        return np.concatenate(parts), np.append(0, np.cumsum(counts))

    def _without_special(self, texts: list[str]):
        marks = [m for m in self.special if any(m in t for t in texts)]
        if not marks:
            return texts, None, None
        pieces, owner, special = [], [], []
        for i, text in enumerate(texts):
            rest = text
            while rest is not None:
                at, mark = min(((rest.find(m), m) for m in marks if m in rest), default=(-1, ""), key=lambda x: (x[0], -len(x[1])))
                pieces.append(rest[:at] if at >= 0 else rest)
                owner.append(i)
                special.append(-1)
                rest = rest[at + len(mark) :] if at >= 0 else None
                if at >= 0:
                    pieces.append("")
                    owner.append(i)
                    special.append(self.special[mark])
        return pieces, np.array(owner), special

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join([self.bytes_of[i] for i in ids.tolist()]).decode("utf-8", "replace")


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    total = np.append(0, np.cumsum(lengths))
    return np.arange(total[-1]) + np.repeat(starts - total[:-1], lengths)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def round_trip(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` of the ids as decimals with commas, and ``decoded_sha256``.

    A null text counts as empty.  Earlier columns of these names are replaced.
    ``path`` is the vocabulary file, on every machine.
    """
    path = path or default_path()
    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256")
    schema = T.StructType([*docs.schema, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    at = docs.columns.index(text)

    def apply(batches):
        code = encoder(path)
        decimals = np.array([str(i).encode() for i in range(len(code.bytes_of))], object)
        letters = np.array(code.bytes_of, object)
        for batch in batches:
            texts, counts, forward, back = plain(batch.column(at)), [], [], []
            for a, b in slices(texts):
                ids, bounds = code.encode(texts.slice(a, b - a).to_pylist())
                for i in range(b - a):
                    own = ids[bounds[i] : bounds[i + 1]]
                    counts.append(len(own))
                    forward.append(hashlib.sha256(b",".join(decimals[own].tolist())).hexdigest())
                    back.append(hashlib.sha256(b"".join(letters[own].tolist()).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(forward, pa.string()), pa.array(back, pa.string())], schema.names)

    return docs.mapInArrow(apply, schema)
