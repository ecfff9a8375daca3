"""Pre-tokens of a batch of texts, found with numpy, for the two pre-tokenizers of the public vocabularies.

Splits are those of the tokenizers library, in all scripts: the classes of characters and their lower-case forms are asked of the library once by
each worker. Texts with characters that composition may change are composed by the library's normalizer first. Texts that
hold a special token's string are not split here: ``plain`` is False for them and callers give them to the library whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textscan import SpanHasher, codepoints

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Characters up to here are classed by tables; none above is a letter, a number or white space.
CLASSED = 0x40000
_STEP = 1 << 13
_DOTTED_I, _APOSTROPHE, _BLANK = 0x130, 0x27, 0x20
#: Hangul vowels and final consonants, which join the syllable before them (fixed values).
_JAMO = (range(0x1161, 0x1176), range(0x11A8, 0x11C3))
#: What may follow an apostrophe at the start of a pre-token, as the patterns of both vocabularies list it (fixed values).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _characters(low: int) -> np.ndarray:
    points = np.arange(low, low + _STEP, dtype=np.uint32)
    return points[(points < 0xD800) | (points > 0xDFFF)]


def _string(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each character below CLASSED by the library's regular expressions."""
    from tokenizers import Regex, pre_tokenizers

    out = np.zeros(CLASSED + 1, np.uint8)  # the last: all characters above
    for value, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        found = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        for low in range(0, CLASSED, _STEP):
            points = _characters(low)
            if len(points):
                for _, (a, b) in found.pre_tokenize_str(_string(points)):
                    out[points[a:b]] = value
    return out


@lru_cache(maxsize=1)
def lower() -> np.ndarray:
    """Lower-case forms by the library; of the dotted I, which has two characters, none."""
    from tokenizers import normalizers

    out = np.arange(CLASSED, dtype=np.uint32)
    for low in range(0, CLASSED, _STEP):
        points = _characters(low)
        points = points[points != _DOTTED_I]
        out[points] = np.frombuffer(normalizers.Lowercase().normalize_str(_string(points)).encode("utf-32-le"), np.uint32)
    return out


@lru_cache(maxsize=1)
def stable() -> np.ndarray:
    """Characters that composition leaves as they are next to any others, and that have one lower-case character."""
    out = np.zeros(CLASSED + 1, bool)
    second = {c for r in _JAMO for c in r} | {_DOTTED_I}
    for c in range(CLASSED):
        x = chr(c)
        parts = unicodedata.decomposition(x)
        canonical = parts and parts[0] != "<"
        if canonical and " " in parts:
            second.add(int(parts.split()[1], 16))
        out[c] = not unicodedata.combining(x) and unicodedata.category(x) not in ("Cn", "Cs") and (not canonical or unicodedata.is_normalized("NFC", x))
    out[list(second)] = False
    return out


@dataclass
class Pieces:
    """Pre-tokens in order: ``hash``, ``doc``, and ``text(i)``. ``plain``: the texts that were split."""

    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    plain: np.ndarray

    def text(self, i: int) -> str:
        return self.points[self.start[i] : self.end[i]].tobytes().decode("utf-32-le")


def split(texts: pa.Array, specials: tuple[str, ...], words: bool, normalize: Callable[[str], str] = str) -> Pieces:
    """``words``: lower-cased pre-tokens without white space, digits one by one, of texts that ``normalize`` composes; else byte-level ones, with the
    blank before them."""
    texts = pc.fill_null(texts, "")
    plain = np.ones(len(texts), bool)
    for s in specials:
        plain &= ~pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    if not plain.all():
        texts = pc.replace_with_mask(texts, pa.array(~plain), pa.scalar("", texts.type))
    points, offsets = codepoints(texts)
    if words:
        odd = np.unique(np.searchsorted(offsets, np.flatnonzero(~stable()[np.minimum(points, CLASSED)]), side="right") - 1)
        if len(odd):
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([normalize(texts[d].as_py()) for d in odd.tolist()], texts.type))
            points, offsets = codepoints(texts)
        known = points < CLASSED
        points = np.where(known, lower()[np.where(known, points, 0)], points)
    kinds = classes()[np.minimum(points, CLASSED)]
    n = len(points)
    starts = _starts(points, kinds, offsets, words) if n else np.zeros(0, np.int64)
    ends = np.append(starts[1:], n)
    if words:
        kept = kinds[starts] != SPACE if n else np.zeros(0, bool)
        starts, ends = starts[kept], ends[kept]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return Pieces(points, starts, ends, doc, SpanHasher(points)(starts, ends), plain)


def _starts(points: np.ndarray, kinds: np.ndarray, offsets: np.ndarray, words: bool) -> np.ndarray:
    n = len(points)
    flag = np.ones(n + 1, bool)
    flag[1:n] = kinds[1:] != kinds[:-1]
    flag[offsets[offsets < n]] = True
    runs = np.flatnonzero(flag)  # the last is n
    kind, size = kinds[runs[:-1]], np.diff(runs)
    new_text = np.zeros(n + 1, bool)
    new_text[offsets] = True
    new_text[n] = True
    followed = ~new_text[runs[1:]]  # another run of the same text comes next
    glued = np.zeros(len(runs), bool)  # a blank before the run belongs to it
    if not words:
        gap = np.flatnonzero((kind == SPACE) & followed)
        flag[runs[gap + 1] - 1] = True
        blank = gap[points[runs[gap + 1] - 1] == _BLANK]
        flag[runs[blank + 1]] = False
        glued[blank + 1] = True
    # contractions: a run of one apostrophe takes the first letters of the next one
    mark = np.flatnonzero((kind == OTHER) & (size == 1) & followed & ~glued[:-1] & (points[runs[:-1]] == _APOSTROPHE))
    mark = mark[kind[mark + 1] == LETTER] if len(mark) else mark
    for i in mark.tolist():
        at, stop = runs[i + 1], runs[i + 2]
        after = points[at : min(at + 2, stop)].tobytes().decode("utf-32-le")
        ending = next((e for e in ENDINGS if after.startswith(e)), None)
        if ending:
            flag[at] = False
            flag[at + len(ending)] = True
    if words:
        flag[:n][kinds == NUMBER] = True
    return np.flatnonzero(flag[:n])


class Memo:
    """Values of pre-tokens that one worker has seen, by hash: sorted arrays, emptied when they hold ``most``."""

    def __init__(self, most: int = 1_000_000):
        self.most = most
        self.keys = np.zeros(0, np.uint64)
        self.values = np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        have = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        return at, have

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], np.concatenate([self.values, values])[order]
