"""Hashes of the words of many texts at once, on numpy arrays over the texts' bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Its hash is a polynomial in a fixed odd base over a fixed random
table of byte values, mixed at the end; n-word sequences are hashed by a second polynomial over their words. Two lanes
with other constants together make 128 bits, where equality of hashes stands for equality of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLES = [_rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1) for _ in range(2)]
_BASES = [int(x) | 1 for x in _rng.integers(1 << 40, 1 << 62, 2)]
_GRAM_BASES = [int(x) | 1 for x in _rng.integers(1 << 40, 1 << 62, 2)]
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Texts are taken together up to so many bytes, so temporary arrays stay small whatever a batch holds.
CHUNK_BYTES = 1 << 18
WORDS_AT_ONCE = 1 << 16
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done = 1
    with np.errstate(over="ignore"):
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * _U(pow(base, done, 1 << 64))
            done += more
    return out


class Chunk:
    """Some texts' words. hashes: by lane, of all words in order. starts: the first word of each text, and the end.

    begins, ends: the bytes of each word in data; offsets: those of each text.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lanes: int, lower: bool):
        word = ~_SEPARATOR[data]
        n = len(data)
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = offsets[1:-1]
        inner = inner[inner < n]
        first[inner] = word[inner]
        self.begins = np.flatnonzero(first)
        last = word.copy()
        last[:-1] &= ~word[1:] | first[1:]
        self.ends = np.flatnonzero(last) + 1
        self.starts = np.searchsorted(self.begins, offsets)
        self.data, self.offsets = data, offsets
        total = len(self.begins)
        self.hashes = [np.empty(total, np.uint64) for _ in range(lanes)]
        for at in range(0, total, WORDS_AT_ONCE):  # one text may be longer than all others together
            own = slice(at, min(at + WORDS_AT_ONCE, total))
            low, high = self.begins[own.start], self.ends[own.stop - 1]
            values = data[low:high][word[low:high]]
            values = _LOWER[values] if lower else values
            lengths = self.ends[own] - self.begins[own]
            heads = np.cumsum(lengths) - lengths
            place = np.arange(len(values)) - np.repeat(heads, lengths)
            powers = int(lengths.max())
            with np.errstate(over="ignore"):
                for k in range(lanes):
                    terms = _TABLES[k][values] * _powers(_BASES[k], powers)[place]
                    self.hashes[k][own] = mix(np.add.reduceat(terms, heads) + lengths.astype(np.uint64))

    def texts(self) -> np.ndarray:
        """For each word the number of its text in this chunk."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def grams(self, n: int, lane: int = 0) -> np.ndarray:
        """The hash of the n words from each word on; the last n - 1 words have none. Sequences may cross texts."""
        return grams(self.hashes[lane], n, lane)

    def whole(self, n: int) -> np.ndarray:
        """The places at which a sequence of n words starts that stays in its text."""
        total = len(self.hashes[0])
        if total < n:
            return np.zeros(0, np.int64)
        room = np.repeat(self.starts[1:], np.diff(self.starts))
        return np.flatnonzero(np.arange(total) + n <= room)


def grams(hashes: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hashes of all n-word sequences, by doubling their length."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total, base = len(hashes) - n + 1, _GRAM_BASES[lane]
    out = np.zeros(total, np.uint64)
    done, size, part = 0, 1, hashes
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                out += part[done : done + total] * _U(pow(base, done, 1 << 64))
                done += size
            if done == n:
                return mix(out + _U(n))
            part = part[: len(part) - size] + part[size:] * _U(pow(base, size, 1 << 64))
            size *= 2


def chunks(texts: pa.Array, lanes: int = 1, lower: bool = False) -> Iterator[tuple[int, Chunk]]:
    """(number of the first text, its chunk) over a column of strings; nulls are empty texts."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield at, Chunk(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lanes, lower)
        at = to
