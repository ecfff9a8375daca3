"""Whole Arrow batches of texts as numpy arrays: words, their hashes, and pre-tokens.

Every function works on a batch at once. Positions are indexes into the concatenated
batch; ``offsets`` (n + 1 entries) gives the part of each text. A null text is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts of one batch are handled in slices of about so many bytes, to bound memory.
SLICE_BYTES = 1_000_000

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, of about SLICE_BYTES of text each; one text is never split."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the offsets of each."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def codepoints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(texts)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, lead[offsets]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside``, cut at text borders: starts, ends, index of the text."""
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts] = False
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


@lru_cache(maxsize=1)
def _powers(at_least: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_MULTIPLIER, -1, 1 << 64)
    out = []
    for base in (_MULTIPLIER, inverse):
        factors = np.full(at_least, base, np.uint64)
        factors[0] = 1
        out.append(np.multiply.accumulate(factors))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the whole."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class SpanHasher:
    """64-bit hashes of any spans of one array of symbols, in time that does not depend on their lengths.

    Prefix sums of symbol * r^position modulo 2^64; a span's sum times r^-start does not
    depend on where it stands.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        size = 1 << max(20, n.bit_length())
        self._up, self._down = _powers(size)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * self._up[:n], out=sums[1:])
        self._sums = sums

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def table(inside: str) -> np.ndarray:
    """256 booleans: the bytes that belong to a word. ``inside``: 'space' for all but ASCII white space,
    'alnum' for ASCII letters, digits and every byte of a non-ASCII character."""
    b = np.arange(256)
    space = (b == 0x20) | ((b >= 0x09) & (b <= 0x0D))
    if inside == "space":
        return ~space
    return (b >= 0x80) | ((b >= 0x30) & (b <= 0x39)) | ((b >= 0x41) & (b <= 0x5A)) | ((b >= 0x61) & (b <= 0x7A))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
LOWER_BYTES = LOWER.tobytes()


def folded(texts: pa.Array) -> pa.Array:
    """Texts without differences of case, in any script: upper-cased and then lower-cased, so that a final sigma is a sigma, and sharp s as ss."""
    return pc.replace_substring(pc.utf8_lower(pc.utf8_upper(pc.fill_null(texts, ""))), "\u00df", "ss")


class Words:
    """The words of a batch of texts: ``hash``, ``start``, ``end`` (bytes), ``doc``; ``first[d]:first[d + 1]`` are those of text d."""

    def __init__(self, texts: pa.Array, inside: str = "alnum"):
        data, self.offsets = utf8(texts)
        self.data = LOWER[data]
        self.start, self.end, self.doc = spans(table(inside)[data], self.offsets)
        self.hasher = SpanHasher(self.data)
        self.hash = self.hasher(self.start, self.end)
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words within a text, and the index of each one's first word."""
        count = len(self.hash) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:count] == self.doc[n - 1 :])
        return gram_hash([self.hash[at + k] for k in range(n)]), at


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + w)
    return h


def word_hashes(text: str) -> np.ndarray:
    """The hashes ``Words`` gives for one text."""
    return Words(pa.array([text], pa.string())).hash


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, start + length), one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    return np.repeat(starts - begin, lengths) + np.arange(total)
