"""Token ids in fixed-width packed files, in document order.

A segment is one file image: a header, an index of documents, block offsets, and the ids of its
documents, each in the least number of bits that the vocabulary needs, most significant bit
first. Blocks hold BLOCK_IDS ids (the last one fewer) and start on a byte, so any range of ids is
read from its own blocks only. Integers of the header and the indexes are little-endian:

    magic 8s | bits u4 | block_ids u4 | n_docs u8 | n_ids u8 | n_blocks u8
    doc_id i8 x n_docs | doc_known u1 x n_docs | doc_end u8 x n_docs | block_offset u8 x (n_blocks + 1) | payload

Segments are rows of a Parquet table in the shared folder, so that they can lie in any store
Spark writes to. Sorted by (part, part_start) they hold all documents by ascending doc_id. They are stored as they are, without
compression, each in a page of its own, and are small: a range of ids is read from the pages of its segments, and unpacked from its blocks.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import Memo, split
from .scratch import deleted_at_end, new_path
from .textscan import ranges, slices

MAGIC = b"HXIDS\x00\x00\x01"
HEADER = np.dtype([("magic", "S8"), ("bits", "<u4"), ("block_ids", "<u4"), ("n_docs", "<u8"), ("n_ids", "<u8"), ("n_blocks", "<u8")])
BLOCK_IDS = 4_096
#: A segment is closed once it has so many ids; it ends with a whole document.
SEGMENT_IDS = 1 << 16
FILES = "part int, part_start long, n_ids long, image binary"
PAGE_BYTES = 64 << 10


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    raw = np.unpackbits(ids.astype(">u4").view(np.uint8)).reshape(-1, 32)[:, 32 - bits :]
    return np.packbits(raw).tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype(np.uint32)
    raw = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, 32 - bits :] = raw
    return np.packbits(full).view(">u4").astype(np.uint32)


def write_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    starts = np.arange(0, len(ids), BLOCK_IDS)
    blocks = [pack(ids[s : s + BLOCK_IDS], bits) for s in starts]
    header = np.zeros(1, HEADER)
    header[0] = (MAGIC, bits, BLOCK_IDS, len(doc_ids), len(ids), len(blocks))
    index = [
        np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is not None for x in doc_ids], np.uint8),
        np.cumsum(lengths).astype("<u8"), np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8"),
    ]
    return b"".join([header.tobytes(), *(x.tobytes() for x in index), *blocks])


class Segment:
    """Reads a segment's image: ``doc_ids``, ``doc_end``, and ``ids(start, stop)`` for any range."""

    def __init__(self, image: bytes):
        head = np.frombuffer(image, HEADER, 1)[0]
        if bytes(head["magic"]).ljust(8, b"\0") != MAGIC:
            raise ValueError("not a segment of token ids")
        self.bits, self.block_ids = int(head["bits"]), int(head["block_ids"])
        self.n_ids, n_docs, n_blocks = int(head["n_ids"]), int(head["n_docs"]), int(head["n_blocks"])
        at = HEADER.itemsize
        ids = np.frombuffer(image, "<i8", n_docs, at)
        known = np.frombuffer(image, np.uint8, n_docs, at := at + 8 * n_docs)
        self.doc_end = np.frombuffer(image, "<u8", n_docs, at := at + n_docs).astype(np.int64)
        self.block_offset = np.frombuffer(image, "<u8", n_blocks + 1, at := at + 8 * n_docs).astype(np.int64)
        self.payload = memoryview(image)[at + 8 * (n_blocks + 1) :]
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]

    def ids(self, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        out = []
        for b in range(first, last + 1):
            n = min(self.block_ids, self.n_ids - b * self.block_ids)
            out.append(unpack(self.payload[self.block_offset[b] : self.block_offset[b + 1]], n, self.bits))
        base = first * self.block_ids
        return np.concatenate(out)[start - base : stop - base]


class Encoder:
    """Ids of whole texts by the tokenizers library. A pre-token is given to it once by each worker that meets it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size()
        self.specials = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self._clear()

    def _clear(self) -> None:
        self.memo = Memo()
        self.pool = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1, np.int64)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        if len(self.memo.keys) + len(keys) > self.memo.most:
            self._clear()
        encoded = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        known, used = len(self.first) - 1, int(self.first[-1])
        ends = used + np.cumsum([len(e) for e in encoded])
        while ends[-1] > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[used : ends[-1]] = np.fromiter((i for e in encoded for i in e), np.uint32, ends[-1] - used)
        self.first = np.concatenate([self.first, ends])
        self.memo.add(keys, np.arange(known, known + len(keys)))

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, end_id after each, and the number of each text's ids."""
        found = split(texts, self.specials, False)
        keys, first, which = np.unique(found.hash, return_index=True, return_inverse=True)
        _, have = self.memo.find(keys)
        if not have.all():
            if len(self.memo.keys) + int((~have).sum()) > self.memo.most:
                have[:] = False  # learning empties the memo
            new = np.flatnonzero(~have)
            self._learn(keys[new], [found.text(i) for i in first[new]])
        at = self.memo.values[self.memo.find(keys)[0]] if len(keys) else np.zeros(0, np.int64)
        begin, size = self.first[at][which], (self.first[at + 1] - self.first[at])[which] if len(at) else np.zeros(0, np.int64)
        ids = self.pool[ranges(begin, size)]
        lengths = np.bincount(found.doc, weights=size, minlength=len(texts)).astype(np.int64)
        if found.plain.all():
            out = np.insert(ids, np.cumsum(lengths), end_id)
            return out, lengths + 1
        parts, starts = [], np.cumsum(lengths) - lengths
        for d in range(len(texts)):
            if found.plain[d]:
                parts.append(ids[starts[d] : starts[d] + lengths[d]])
            else:
                parts.append(np.array(self.library.encode(texts[d].as_py(), add_special_tokens=False).ids, np.uint32))
                lengths[d] = len(parts[-1])
            parts.append(np.array([end_id], np.uint32))
        return np.concatenate(parts), lengths + 1


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> str:
    """Writes the ids of all whole texts (null: empty) by ascending doc_id, nulls first, and returns the folder: ``path``, or a new one in the shared
    folder, which is deleted when the driver ends.

    Equal doc_ids follow each other by their texts' hashes. Rows are dealt out by ranges of (doc_id,
    text hash), so repeated ids do not meet in one task. Other columns are not read. An
    empty table gives a folder without segments.
    """
    path = path or deleted_at_end(docs.sparkSession, new_path(docs.sparkSession, "ids"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        bits = max(1, (max(encode.vocabulary - 1, end_id)).bit_length())
        doc_ids: list[int | None] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            image = write_segment(doc_ids, np.concatenate(lengths), np.concatenate(ids), bits)
            return pa.RecordBatch.from_pylist([{"part": part, "part_start": start, "n_ids": held, "image": image}], schema)

        schema = pa.schema([("part", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())])
        for batch in batches:
            for piece in slices(batch, "text"):
                some, n = encode(piece.column("text"), end_id)
                names, ends, at = piece.column("doc_id").to_pylist(), np.concatenate([[0], np.cumsum(n)]), 0
                while at < len(n):  # the documents that fill the segment
                    upto = min(len(n), int(np.searchsorted(ends, ends[at] + SEGMENT_IDS - held)))
                    doc_ids += names[at:upto]
                    lengths.append(n[at:upto])
                    ids.append(some[ends[at] : ends[upto]])
                    held, at = held + int(ends[upto] - ends[at]), upto
                    if held >= SEGMENT_IDS:
                        yield flush()
                        start, held, doc_ids, lengths, ids = start + held, 0, [], [], []
        if doc_ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = rows.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)
    rows.mapInArrow(segments, FILES).write.options(compression="none", **{"parquet.page.size": PAGE_BYTES, "parquet.enable.dictionary": "false", "parquet.page.size.row.check.min": 1}).parquet(path)
    return path


def _bases(files: DataFrame) -> list[tuple[int, int, int]]:
    """(part, ids before it, its ids): one row for each task of the writing job."""
    totals = files.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_ids")).alias("n")).orderBy("part").collect()
    ends = np.cumsum([r["n"] for r in totals]).tolist()
    return [(r["part"], end - r["n"], r["n"]) for r, end in zip(totals, ends, strict=True)]


def read_range(spark, path: str, start: int, stop: int) -> np.ndarray:
    """The ids of [start, stop) of all documents' ids. Only the segments that hold some are read, and only their blocks of it are unpacked."""
    files = spark.read.schema(FILES).parquet(path)
    out = []
    for part, base, n in _bases(files):
        low, high = max(start - base, 0), min(stop - base, n)
        if low < high:
            met = files.where((F.col("part") == part) & (F.col("part_start") < high)).where(F.col("part_start") + F.col("n_ids") > low)
            first = met.agg(F.min("part_start")).first()[0]
            for r in files.where((F.col("part") == part) & (F.col("part_start") >= first) & (F.col("part_start") < high)).orderBy("part_start").toLocalIterator():
                out.append(Segment(r["image"]).ids(max(low - r["part_start"], 0), min(high - r["part_start"], r["n_ids"])))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def read_ids(spark, path: str) -> DataFrame:
    """One row for each document of the folder's segments: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.schema(FILES).parquet(path)
    bases = spark.createDataFrame([(part, base) for part, base, _ in _bases(files)], "part int, base long")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, image in zip(batch.column("start").to_pylist(), batch.column("image"), strict=True):
                s = Segment(image.as_py())
                ids, begin = s.ids(0, s.n_ids).astype("<u4"), np.concatenate([[0], s.doc_end[:-1]]).astype(np.int64)
                crc = [zlib.crc32(ids[a:b].data) for a, b in zip(begin.tolist(), s.doc_end.tolist(), strict=True)]
                arrays = [pa.array(s.doc_ids, pa.int64()), pa.array(start + begin), pa.array(s.doc_end - begin), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = files.join(F.broadcast(bases), "part").select((F.col("base") + F.col("part_start")).alias("start"), "image")
    return placed.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
