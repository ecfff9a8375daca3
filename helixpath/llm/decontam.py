"""Benchmark decontamination: rare n-gram seeds join texts to test items, Smith-Waterman alignment scores them.

Words are runs of ASCII letters and digits and of all non-ASCII characters, without differences of case. An item of L words matches a text whose best local
alignment (match 1, mismatch and gap -1, over words) scores at least ``least`` * L; that is 0.6, which a copy
with every fifth word replaced still reaches.

Seeds are runs of SEED words, of fewer in items so short that edits could spoil all of those. An alignment that good loses a bounded number
of the item's seeds to its edits, so it keeps at least ``kept_seeds``, and one of them is among the item's rarest: rarity is counted over
all texts, and no match is lost by seeding with those only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import saved
from .textscan import Words, folded, gram_hash, ranges, slices

SEED = 3
LEAST = 0.6
#: Items are handled in blocks of about so many words, each of which goes to every task; more items take more passes over the texts.
BLOCK_WORDS = 1_000_000
_FILTER_BITS = 20


def kept_seeds(words: int, n: int, least: float) -> int:
    """How many of an item's runs of n words a match keeps. A replaced word costs two points and n runs, an inserted one costs one
    point and n - 1, a word beyond the alignment costs one of each."""
    lost = max(n / 2, n - 1, 1) * (1 - least) * words
    return math.ceil(words - n + 1 - lost - 1e-9)


def seed_words(words: int, least: float) -> int:
    """The longest runs, of up to SEED words, of which a match surely keeps one. Of single words that is so for any item."""
    return next((n for n in range(min(SEED, words), 1, -1) if kept_seeds(words, n, least) > 0), 1)


@dataclass
class Items:
    """A block of distinct items: word hashes, the seed at each place of an item, and the items that have a seed among their rarest."""

    ids: list[int | None]
    times: list[int]  # rows of the benchmark that are this item
    least: float
    words: np.ndarray
    first: np.ndarray  # of each item's words
    sizes: np.ndarray  # words of each item's seeds
    seeds: np.ndarray  # sorted hashes
    place_seed: np.ndarray
    place_first: np.ndarray  # of each item's places
    rare: np.ndarray  # of places
    rare_item: np.ndarray  # by seed
    rare_first: np.ndarray  # of each seed's items

    @classmethod
    def of(cls, ids: list[int | None], times: list[int], words: list[np.ndarray], least: float) -> Items:
        lengths = np.array([len(w) for w in words], np.int64)
        sizes = np.array([seed_words(n, least) for n in lengths.tolist()], np.int64)
        hashes = [gram_hash([w[k : len(w) - n + 1 + k] for k in range(n)]) for w, n in zip(words, sizes.tolist(), strict=True)]
        seeds, place_seed = np.unique(np.concatenate(hashes), return_inverse=True)
        none = np.zeros(0, np.int64)
        offsets = [np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int64) for xs in (words, hashes)]
        return cls(ids, times, least, np.concatenate(words), offsets[0], sizes, seeds, place_seed, offsets[1], np.ones(len(place_seed), bool), none, np.zeros(len(seeds) + 1, np.int64))

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Index of each gram's seed, or -1."""
        low = np.uint64((1 << _FILTER_BITS) - 1)
        mask = np.zeros(1 << _FILTER_BITS, bool)
        mask[(self.seeds & low).astype(np.int64)] = True
        out = np.full(len(grams), -1)
        some = np.flatnonzero(mask[(grams & low).astype(np.int64)])
        at = np.searchsorted(self.seeds, grams[some])
        at[at == len(self.seeds)] = 0
        hit = self.seeds[at] == grams[some]
        out[some[hit]] = at[hit]
        return out

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The seeds in a batch of texts, and the word at which each stands, by that word."""
        found, places = [], []
        for n in np.unique(self.sizes).tolist():
            grams, at = words.grams(n)
            seed = self.find(grams)
            there = np.flatnonzero(seed >= 0)
            found.append(seed[there])
            places.append(at[there])
        seed, place = np.concatenate(found), np.concatenate(places)
        order = np.argsort(place, kind="stable")
        return seed[order], place[order]

    def keep_rarest(self, frequency: np.ndarray) -> None:
        """Marks as rare, of each item's m places, the m - kept_seeds + 1 whose seeds the fewest texts hold."""
        self.rare[:] = False
        for i, n in enumerate(self.sizes.tolist()):
            a, b = self.place_first[i : i + 2].tolist()
            order = np.argsort(frequency[self.place_seed[a:b]], kind="stable")
            self.rare[a + order[: b - a - kept_seeds(int(self.first[i + 1] - self.first[i]), n, self.least) + 1]] = True
        item = np.repeat(np.arange(len(self.sizes)), np.diff(self.place_first))
        pairs = np.unique(self.place_seed[self.rare] * len(self.sizes) + item[self.rare])
        self.rare_item = pairs % len(self.sizes)
        self.rare_first = np.searchsorted(pairs // len(self.sizes), np.arange(len(self.seeds) + 1))


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: score, and the first and last word of ``text`` in it."""
    score, last = _best(item, text)
    if not score:
        return 0, 0, -1
    back = text[: last + 1][::-1]
    again, size = _best(item[::-1], back)
    return score, last - size, last


def _best(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman row by row: score and where in ``text`` it is first reached. Gaps along a row are a running maximum."""
    steps = np.arange(1, len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    best, where = 0, 0
    for w in item:
        up = np.maximum(row[1:] - 1, row[:-1] + np.where(text == w, 1, -1))
        new = np.maximum.accumulate(np.maximum(up, 0) + steps) - steps
        row[1:] = new
        at = int(np.argmax(new))
        if new[at] > best:
            best, where = int(new[at]), at
    return best, where


def matches(items: Items, texts: pa.Array) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, last word) for all matches in a batch. Only rare seeds make pairs of a text and an item; the
    item's other seeds are then looked up among those of that text."""
    words = Words(folded(texts))
    seed, place = items.hits(words)
    doc = words.doc[place]
    count = np.diff(items.rare_first)[seed]
    pairs = np.unique(np.repeat(doc, count) * len(items.sizes) + items.rare_item[ranges(items.rare_first[seed], count)])
    out = []
    for d, i in zip((pairs // len(items.sizes)).tolist(), (pairs % len(items.sizes)).tolist(), strict=True):
        low, high = np.searchsorted(doc, [d, d + 1])
        own = slice(items.place_first[i], items.place_first[i + 1])
        mine, rare = items.place_seed[own], items.place_seed[own][items.rare[own]]
        there = low + np.flatnonzero(np.isin(seed[low:high], mine))
        target = items.words[items.first[i] : items.first[i + 1]]
        size = len(target)
        need = kept_seeds(size, int(items.sizes[i]), items.least)
        reach = math.ceil(size * (2 - items.least)) + 1  # no match is longer than this in the text
        best = (0, 0, -1)
        for at in np.split(there, np.flatnonzero(np.diff(place[there]) > reach) + 1):
            if np.isin(mine, seed[at]).sum() < need or not np.isin(rare, seed[at]).any():
                continue
            start = max(int(words.first[d]), int(place[at[0]]) - reach)
            end = min(int(words.first[d + 1]), int(place[at[-1]]) + reach)
            score, a, b = align(target, words.hash[start:end])
            if score > best[0]:
                best = (score, a + start - int(words.first[d]), b + start - int(words.first[d]))
        if best[0] >= items.least * size - 1e-9:
            out.append((d, i, best[0] / size, best[1], best[2]))
    return out


def item_blocks(benchmark: DataFrame, least: float) -> Iterator[tuple[Items, bool]]:
    """The benchmark's distinct items in blocks of about BLOCK_WORDS words, dealt out by a hash of id and text, and whether a block is the last one.
    Items without a word match nothing."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.groupBy("item_id", "text").agg(F.count("*").alias("times"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (4 * BLOCK_WORDS)))
    for k in range(blocks):
        some = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").toArrow()
        w = Words(folded(some.column("text").combine_chunks()))
        split = [(i, n, x) for i, n, x in zip(some.column("item_id").to_pylist(), some.column("times").to_pylist(), np.split(w.hash, w.first[1:-1]), strict=False) if len(x)]
        if split:
            ids, times, words = map(list, zip(*split, strict=True))
            yield Items.of(ids, times, words, least), k == blocks - 1


def _with_rare_seeds(docs: DataFrame, items: Items) -> Broadcast:
    """Counts, over all texts, how many hold each seed, marks the rarest, and sends the block to every task. One number for each seed comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        total = np.zeros(len(block.seeds), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(folded(part.column("text")))
                seed, place = block.hits(words)
                pairs = np.unique(words.doc[place] * len(block.seeds) + seed)
                total += np.bincount(pairs % len(block.seeds), minlength=len(block.seeds))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["seed", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    frequency = np.zeros(len(items.seeds), np.int64)
    frequency[rows.column("seed").to_numpy()] = rows.column("n").to_numpy()
    items.keep_rarest(frequency)
    return docs.sparkSession.sparkContext.broadcast(items)


def contamination(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): a row for each row of ``docs`` and item that match, with the best place.

    Null and empty texts match nothing, nor do items without words; repeated rows of either table match each for itself. Other
    columns are left out.
    """
    schema = "doc_id long, item_id long, score double, first_word long, last_word long"
    out, done = None, False
    for items, done in item_blocks(benchmark, least):
        shared = _with_rare_seeds(docs, items)

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    found = [m for m in matches(shared.value, part.column("text")) for _ in range(shared.value.times[m[1]])]
                    d, i, score, first, last = zip(*found, strict=True) if found else ((),) * 5
                    ids = [part.column("doc_id")[k].as_py() for k in d]
                    items_ = [shared.value.ids[k] for k in i]
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip((ids, items_, score, first, last), kinds, strict=True)], ["doc_id", "item_id", "score", "first_word", "last_word"])

        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, schema)
        if not done or out is not None:  # of several blocks each one's matches are written, so that the executors hold one block at a time
            part = saved(part, "matches")
            shared.destroy()
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that match no item, with all their columns; no row moves to another task.

    Null and empty texts match nothing and stay; repeated rows stay or go together. Between several blocks of items, what is left is written to the shared folder.
    """
    for items, last in item_blocks(benchmark, least):
        shared = _with_rare_seeds(docs, items)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    keep = np.ones(part.num_rows, bool)
                    keep[[m[0] for m in matches(shared.value, part.column("text"))]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
        if not last:
            docs = saved(docs, "clean")
            shared.destroy()
    return docs
