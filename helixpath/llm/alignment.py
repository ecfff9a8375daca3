"""Alignment of two tokenizers: where tokens of both end, a text is cut into groups; which ids stand for the same bytes, counted over all documents.

A whole Arrow batch is one array of bytes with document offsets. The ends of both tokenizers' tokens are counted at each byte once; a cut is where
both counts are not zero. Prefix sums over the batch, taken at the documents' borders, give each document's numbers.

Tokenizers are given each distinct pre-token once by each worker: A those of its own pattern, B runs of blanks with what follows them,
which none of its pieces crosses (checked when it is opened). Both are known by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pretokens import Memo, split
from .scratch import saved
from .textscan import SpanHasher, ranges, slices, utf8

#: Id pairs, the most frequent ones, whose counts are sent to every task (17 bytes each); the rest is joined by a shuffle.
FREQUENT = 1 << 20
#: Groups of more links than this are counted by distinct ids before their pairs are made.
LARGE = 64
_BLANK, _MARK = 0x20, "▁"


class Vocabulary:
    """What each id stands for: bytes, and the digits of the id itself. Ids of pre-tokens are remembered."""

    def __init__(self, entries: list[bytes]):
        self.size = len(entries)
        self.length = np.array([len(e) for e in entries], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)
        names = [str(i).encode() for i in range(len(entries))]
        self.digits = np.array([len(n) for n in names], np.int64)
        self.cells = np.zeros((len(names), int(self.digits.max(initial=1)) + 1), np.uint8)
        for i, n in enumerate(names):
            self.cells[i, : len(n)] = np.frombuffer(n, np.uint8)
        self._clear()

    def _clear(self) -> None:
        self.memo, self.pool, self.known = Memo(), np.zeros(1 << 16, np.int64), np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        encoded = self._encode(texts)
        have, used = len(self.known) - 1, int(self.known[-1])
        ends = used + np.cumsum([len(e) for e in encoded])
        while ends[-1] > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.int64)])
        self.pool[used : ends[-1]] = np.fromiter((i for e in encoded for i in e), np.int64, ends[-1] - used)
        self.known = np.concatenate([self.known, ends])
        self.memo.add(keys, np.arange(have, have + len(keys)))

    def ids(self, hashes: np.ndarray, doc: np.ndarray, text, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens, ``text(i)`` each, and the number of each document's ids."""
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(docs, np.int64)
        have = self.memo.find(keys)[1]
        if not have.all():
            if len(self.memo.keys) + int((~have).sum()) > self.memo.most:
                self._clear()
                have[:] = False
            new = np.flatnonzero(~have)
            self._learn(keys[new], [text(i) for i in first[new].tolist()])
        at = self.memo.values[self.memo.find(keys)[0]]
        size = (self.known[at + 1] - self.known[at])[which]
        return self.pool[ranges(self.known[at][which], size)], np.bincount(doc, weights=size, minlength=docs).astype(np.int64)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ranges(self.first[ids], self.length[ids])]


class ByteLevel(Vocabulary):
    """A byte-level vocabulary of the tokenizers library. Special tokens' strings are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        # printable bytes stand for themselves, the others, in order, for the characters from 256 on
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        entries = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())]
        super().__init__([bytes(byte[c] for c in e) if all(c in byte for c in e) else e.encode() for e in entries])

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = split(texts, (), False)
        return self.ids(found.hash, found.doc, found.text, len(texts))


class Pieces(Vocabulary):
    """A sentencepiece vocabulary with a blank before each text and bytes for what it lacks."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(re.search(f"[^{_MARK}]{_MARK}", n) for n in names):
            raise ValueError("pieces that cross the start of a word are not supported")
        self.blank = self.library.piece_to_id(_MARK)
        super().__init__([bytes([int(n[3:5], 16)]) if self.library.is_byte(i) else n.replace(_MARK, " ").encode() for i, n in enumerate(names)])

    def _encode(self, texts: list[str]) -> list[list[int]]:
        """Of texts that begin with a blank; the library adds that one itself, but to no empty text."""
        return [ids if len(t) > 1 else [self.blank] for t, ids in zip(texts, self.library.encode([t[1:] for t in texts], num_threads=1), strict=True)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = utf8(texts)
        blank = data == _BLANK
        begin = blank.copy()
        begin[1:] &= ~blank[:-1]
        begin[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(data))
        raw = data.tobytes()
        doc = np.searchsorted(offsets, start, side="right") - 1
        return self.ids(SpanHasher(data)(start, end), doc, lambda i: raw[start[i] : end[i]].decode(), len(texts))


@lru_cache(maxsize=4)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Aligned:
    """The groups of a batch of texts. ``n_a``, ``n_b``, ``n_groups``, ``n_links``: a number for each text; ``a``, ``b``: the ids of texts that align, in order."""

    def __init__(self, texts: pa.Array, a: Vocabulary, b: Vocabulary):
        n = len(texts)
        texts = pc.fill_null(texts, "")
        there = pc.greater(pc.binary_length(texts), 0)
        spaced = pc.binary_join_element_wise(pa.scalar(" "), texts, "").filter(there)
        rows = np.flatnonzero(there.to_numpy(zero_copy_only=False))
        data, offsets = utf8(spaced)
        (ids_a, n_a), (ids_b, n_b) = a(spaced), b(spaced)
        good = np.ones(len(rows), bool)
        for v, ids, count in ((a, ids_a, n_a), (b, ids_b, n_b)):
            good &= _spells(v, ids, count, data, offsets)
        ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
        n_a, n_b, size = n_a[good], n_b[good], np.diff(offsets)[good]
        self.vocabularies, self.a, self.b = (a, b), ids_a, ids_b
        # ends of tokens are counted once at each byte, over all texts; cuts are where both have some
        border = np.concatenate([[0], np.cumsum(size)])
        total = int(border[-1])
        end_a, end_b = np.cumsum(a.length[ids_a]), np.cumsum(b.length[ids_b])
        cut = (np.bincount(end_a, minlength=total + 1) > 0) & (np.bincount(end_b, minlength=total + 1) > 0)
        before = np.cumsum(cut)  # cuts up to and with each byte
        self.group_a, self.group_b = before[end_a - 1], before[end_b - 1]
        groups = int(before[-1])
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        links = np.concatenate([[0], np.cumsum(self.in_a * self.in_b)])
        self.border = before[border]  # groups before each text
        self.text_of_group = np.repeat(np.arange(len(size)), np.diff(self.border))
        self.rows = rows[good]
        self.n_a, self.n_b, self.n_groups, self.n_links = (self._spread(x, n) for x in (n_a, n_b, np.diff(self.border), np.diff(links[self.border])))

    def _spread(self, x: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[self.rows] = x
        return out

    def rendered(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text that aligns."""
        (a, b), groups = self.vocabularies, len(self.in_a)
        if not groups:
            return [b""] * len(self.rows)
        before_a, before_b = np.cumsum(self.in_a), np.cumsum(self.in_b)
        width = max(a.cells.shape[1], b.cells.shape[1])
        cells, length = np.zeros((len(self.a) + len(self.b), width), np.uint8), np.zeros(len(self.a) + len(self.b), np.int64)
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[before_a - 1], last_b[before_b - 1] = True, True
        at_a = np.arange(len(self.a)) + (before_b - self.in_b)[self.group_a]
        at_b = np.arange(len(self.b)) + before_a[self.group_b]
        for v, ids, at, last, end in ((a, self.a, at_a, last_a, b"|"), (b, self.b, at_b, last_b, b";")):
            cells[at, : v.cells.shape[1]] = v.cells[ids]
            length[at] = v.digits[ids]
            cells[at, v.digits[ids]] = np.where(last, end[0], b","[0])
        flat = cells[np.arange(width) <= length[:, None]].tobytes()
        per_text = np.add.reduceat(length + 1, (before_a - self.in_a + before_b - self.in_b)[self.border[:-1]]) if len(self.rows) else np.zeros(0, np.int64)
        ends = np.cumsum(per_text)
        return [flat[e - s : e - 1] for s, e in zip(per_text.tolist(), ends.tolist(), strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, links): each id pair once for each text that links it, pair = a * size of B's vocabulary + b."""
        size = self.vocabularies[1].size
        big = self.in_a * self.in_b > LARGE
        parts = [self._product(*self._some(~big))]
        if big.any():
            parts.append(self._product(*self._distinct(big)))
        text, pair, links = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pair, text)) if len(parts) > 1 else np.argsort(text * (self.vocabularies[0].size * size) + pair, kind="stable")
        text, pair, links = text[order], pair[order], links[order]
        if not len(pair):
            return text, pair, links
        first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])])
        return text[first], pair[first], np.add.reduceat(links, first)

    def _some(self, groups: np.ndarray):
        """Tokens of some groups: ids, groups and how often each counts, of both sides."""
        keep_a, keep_b = groups[self.group_a], groups[self.group_b]
        return (self.a[keep_a], self.group_a[keep_a], None), (self.b[keep_b], self.group_b[keep_b], None)

    def _distinct(self, groups: np.ndarray):
        sides = []
        for (ids, group, _), v in zip(self._some(groups), self.vocabularies, strict=True):
            key, times = np.unique(group * v.size + ids, return_counts=True)
            sides.append((key % v.size, key // v.size, times))
        return tuple(sides)

    def _product(self, a, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (ids_a, group_a, times_a), (ids_b, group_b, times_b) = a, b
        n = len(self.in_a)
        in_b = np.bincount(group_b, minlength=n)
        first_b = np.cumsum(in_b) - in_b
        repeat = in_b[group_a]
        other = ranges(first_b[group_a], repeat)
        links = np.repeat(times_a, repeat) * times_b[other] if times_a is not None else np.ones(len(other), np.int64)
        return self.text_of_group[np.repeat(group_a, repeat)], np.repeat(ids_a, repeat) * self.vocabularies[1].size + ids_b[other], links


def _spells(v: Vocabulary, ids: np.ndarray, count: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The texts whose tokens' bytes, joined, are those of the text."""
    spelled = v.joined(ids)
    doc = np.repeat(np.arange(len(count)), count)
    size = np.bincount(doc, weights=v.length[ids], minlength=len(count)).astype(np.int64)
    same = size == np.diff(offsets)
    if same.all():
        wrong = np.flatnonzero(spelled != data)
    else:
        wrong = np.flatnonzero(spelled[np.repeat(same, size)] != data[np.repeat(same, np.diff(offsets))])
        offsets = np.concatenate([[0], np.cumsum(np.where(same, size, 0))])
    same[np.searchsorted(offsets, wrong, side="right") - 1] = False
    return same


def aligned(docs: DataFrame, a: str, b: str, groups: bool = False) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links), one row for each row of ``docs``, written to the shared folder.

    ``pairs`` are the distinct id pairs that a text links (a * size of B's vocabulary + b), ``links`` how often. ``groups``: also the groups themselves, as
    the text that is hashed. Texts that are null, empty, or not spelled by their tokens (those with U+2581, say) have no tokens, an
    empty hash and no pairs. Repeated rows stay, each with its own ``row``. Other columns are left out.
    """
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<int>" + (", groups string" if groups else "")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, row = byte_level(a), pieces(b), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                found, n = Aligned(part.column("text"), one, two), part.num_rows
                texts: list[bytes | None] = [None] * n
                for r, t in zip(found.rows.tolist(), found.rendered(), strict=True):
                    texts[r] = t
                text, pair, links = found.pairs()
                ends = np.searchsorted(found.rows[text] if len(text) else text, np.arange(n + 1)).astype(np.int32)
                columns = [
                    pa.array(np.arange(row, row + n)), part.column("doc_id"), *(pa.array(x) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)),
                    pa.array(["" if t is None else hashlib.sha256(t).hexdigest() for t in texts]), pa.ListArray.from_arrays(ends, pa.array(pair)), pa.ListArray.from_arrays(ends, pa.array(links.astype(np.int32))),
                ]
                if groups:
                    columns.append(pa.array(["" if t is None else t.decode() for t in texts]))
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])
                row += n

    return saved(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, schema), "aligned")


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): in how many documents each id pair is linked, and whether no pair of the same A id is in more. Written to the shared folder."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    highest = F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / size_b)))  # at most one row for each B id
    return saved(counts.withColumn("best", F.col("n") == highest), "pairs")


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The pairs in at least some power of two documents, ``most`` at most: pairs, counts, whether best, and that power."""
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect()  # 64 rows at most
    total, least = 0, 64
    for power, n in sorted(((r["power"], r["count"]) for r in sizes), reverse=True):
        if total + n > most:
            break
        total, least = total + n, power
    rows = counts.where(F.col("n") >= F.lit(float(2**least))).toArrow()
    pair, n, best = (rows.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    return pair[order], n[order], best[order].astype(bool), least


def alignment_counts(docs: DataFrame, a: str, b: str, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of ``docs``: see ``aligned``.

    ``count_sum`` sums the counts of ``pair_counts`` over all links, ``n_best`` counts the links whose pair is a best one. The counts of the most
    frequent pairs, ``frequent`` of them at most, go to every task; the other pairs, of which none is in many documents, are joined by a shuffle.
    """
    found = aligned(docs, a, b)
    counts = pair_counts(found, pieces(b).size)
    *table, least = _frequent(counts, frequent)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(table))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            offsets = lists.offsets.to_numpy()
            here, links = lists.flatten().to_numpy(), batch.column("links").flatten().to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            at = np.searchsorted(pair, here)
            at[at == len(pair)] = 0
            have = pair[at] == here if len(pair) else np.zeros(len(here), bool)
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])  # noqa: E731, B023
            known, top = np.where(have, n[at] * links, 0) if len(pair) else np.zeros(len(here), np.int64), links * (have & best[at]) if len(pair) else np.zeros(len(here), np.int64)
            rest = np.concatenate([[0], np.cumsum(~have)])[offsets].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(total(top)), pa.array(total(known)), pa.ListArray.from_arrays(rest, pa.array(here[~have])), pa.ListArray.from_arrays(rest, pa.array(links[~have].astype(np.int32)))],
                [*kept, "best_known", "sum_known", "pairs", "links"],
            )

    kept = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    part = found.mapInArrow(sums, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, best_known long, sum_known long, pairs array<long>, links array<int>")
    if least > 0:  # some pairs are in none of the tables sent
        part = saved(part, "summed")
        rare = part.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.links")
        met = rare.join(counts.where(F.col("n") < F.lit(float(2**least))), "pair")
        more = met.groupBy("row").agg(F.sum(F.col("links") * F.col("best").cast("int")).alias("best_more"), F.sum(F.col("links") * F.col("n")).alias("sum_more"))
        part = part.drop("pairs", "links").join(more, "row", "left")
    else:
        part = part.withColumns({"best_more": F.lit(0), "sum_more": F.lit(0)})
    whole = lambda x, y: F.col(x) + F.coalesce(F.col(y), F.lit(0))
    return part.select("doc_id", "n_a", "n_b", "n_groups", "n_links", whole("best_known", "best_more").alias("n_best"), whole("sum_known", "sum_more").alias("count_sum"), "groups_sha256")
