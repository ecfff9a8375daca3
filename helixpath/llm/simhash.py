"""SimHash fingerprints, and their links by a binary trie's self-join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .scratch import saved
from .textscan import LOWER_BYTES, slices

#: Fingerprints that are walked together in one task: those under one node of a trie, at most about so many.
LEAF_ROWS = 16_384
#: Node pairs that one task opens at a time (each of 64 levels may hold four times as many), the
#: comparisons below which it opens no further, and those made at a time.
OPEN_PAIRS = 20_000
SMALL = 32
COMPARED = 250_000


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all runs of ``words`` words; 0 where there is no word."""
    parts = text.translate(LOWER_BYTES).split()
    if not parts:
        return 0
    if len(parts) < words:
        shingles = [b" ".join(parts)]
    else:
        shingles = list(map(b" ".join, zip(*(parts[k:] for k in range(words)))))
    total = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 65_536):
        some = shingles[at : at + 65_536]
        h = np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(seed)), ">u8", len(some))
        bits = np.unpackbits(h.view(np.uint8)).reshape(-1, 64)
        for low in range(0, len(bits), 255):  # sums of up to 255 bits fit in a byte
            total += np.add.reduce(bits[low : low + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(total * 2 > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, text_hash): the fingerprint of each whole text as a signed long. One row for each row of ``docs``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                fps = np.array([fingerprint(t or b"", words) for t in texts], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64)), part.column("text_hash")], ["doc_id", "fp", "text_hash"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash().alias("text_hash"))
    return rows.mapInArrow(scan, "doc_id long, fp long, text_hash long")


def trie_links(values: np.ndarray, first: np.ndarray, last: np.ndarray, level: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs i < j of sorted values within [first, last) of a node at ``level`` that differ in ``budget`` bits at most.

    Each node's trie is joined with itself: pairs of its nodes are walked together. A pair is two ranges of the values and the number of bits
    in which the paths to them differ; it is given up as soon as that exceeds the budget, and compared
    value by value once both ranges are small.
    """
    if not len(first):
        return
    work = [(level, (first, last, first, last, np.zeros(len(first), np.int64)))]
    while work:
        level, pairs = work.pop()
        a0, a1, b0, b1, bits = pairs
        if len(a0) > OPEN_PAIRS:
            half = len(a0) // 2
            work += [(level, tuple(x[:half] for x in pairs)), (level, tuple(x[half:] for x in pairs))]
            continue
        small = ((a1 - a0) * (b1 - b0) <= SMALL) | (level == 64)
        if small.any():
            yield from _compare(values, *(x[small] for x in pairs[:4]), budget)
        if small.all():
            continue
        a0, a1, b0, b1, bits = (x[~small] for x in pairs)
        am, bm = _middle(values, a0, level), _middle(values, b0, level)
        am, bm = np.minimum(np.maximum(am, a0), a1), np.minimum(np.maximum(bm, b0), b1)
        other = a0 != b0  # of a node with itself, the children meet once
        kids = [(a0, am, b0, bm, bits), (am, a1, bm, b1, bits), (a0, am, bm, b1, bits + 1), tuple(x[other] for x in (am, a1, b0, bm, bits + 1))]
        pairs = tuple(np.concatenate(x) for x in zip(*kids, strict=True))
        live = (pairs[0] < pairs[1]) & (pairs[2] < pairs[3]) & (pairs[4] <= budget)
        if live.any():
            work.append((level + 1, tuple(x[live] for x in pairs)))


def _middle(values: np.ndarray, first: np.ndarray, level: int) -> np.ndarray:
    """For nodes at ``level`` that start at index ``first``: where the values with that bit set start."""
    bit = np.uint64(1 << (63 - level))
    above = np.uint64(((1 << 64) - 1) ^ ((1 << (64 - level)) - 1))
    return np.searchsorted(values, (values[first] & above) | bit)


def _compare(values, a0, a1, b0, b1, budget):
    counts = (a1 - a0) * (b1 - b0)
    ends = np.cumsum(counts)
    start = 0
    while start < len(counts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + COMPARED, side="right")))
        n = counts[start:stop]
        which = np.repeat(np.arange(start, stop), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        wide = (b1 - b0)[which]
        i, j = a0[which] + k // wide, b0[which] + k % wide
        near = (np.bitwise_count(values[i] ^ values[j]) <= budget) & (i < j)
        yield i[near], j[near]
        start = stop


def _led_by(value: Column, depth: int, part: int, parts: int) -> tuple[Column, int]:
    """``value`` with one of ``parts`` equal parts of the bits after its first ``depth`` moved up to these, and how many bits that part has."""
    wide = (64 - depth) // parts
    between, below = wide * part, 64 - depth - wide * (part + 1)  # bits on both sides of the part
    bits = lambda at, n: F.shiftrightunsigned(value, at).bitwiseAND((1 << n) - 1 if n < 64 else -1)
    moved = F.shiftleft(bits(below, wide), between + below)
    if between:
        moved = moved.bitwiseOR(F.shiftleft(bits(below + wide, between), below))
    if below:
        moved = moved.bitwiseOR(bits(0, below))
    return moved.bitwiseOR(value.bitwiseAND(_mask(depth))), wide


def _mask(depth: int) -> int:
    """The first ``depth`` bits, as a signed long."""
    return -(1 << (64 - depth)) if depth else 0


def fingerprint_links(fps: DataFrame, budget: int = 3) -> DataFrame:
    """(src, dst): edges that connect exactly the fingerprints connected by links of ``budget`` differing bits.

    ``fps`` has distinct fingerprints in ``fp``. Of budget + 1 parts of the bits, a link leaves one as it is: so each part leads a trie
    of its own, and a link lies under one node below that part. All that is under a node meets in one task and is joined with itself. A node
    of more than LEAF_ROWS is cut in the same way again, by the parts of the bits that are left; every fingerprint
    is sent budget + 1 times, and that many times again for each such cut. Tasks give spanning forests of their links, never all pairs.
    """
    parts = budget + 1
    rows, depth, done = fps.select("fp", F.lit(0).alias("path"), F.col("fp").alias("v")), 0, None
    while True:
        led = [_led_by(F.col("v"), depth, k, parts) for k in range(parts)]
        rows = rows.select("fp", F.explode(F.array(*(F.struct((F.col("path") * parts + k).alias("path"), v.alias("v")) for k, (v, _) in enumerate(led)))).alias("x")).select("fp", "x.*")
        depth += led[0][1]
        rows = rows.withColumn("node", F.col("v").bitwiseAND(_mask(depth)))
        large = saved(rows.groupBy("path", "node").count().where(F.col("count") > LEAF_ROWS).drop("count"), "large")
        last = 64 - depth < 2 * parts or large.isEmpty()
        small = rows if last else rows.join(large, ["path", "node"], "left_anti")
        found = _walked(small, depth, budget)
        done = found if done is None else done.union(found)
        if last:
            return done
        rows = rows.join(large, ["path", "node"], "left_semi").drop("node")


def _walked(rows: DataFrame, depth: int, budget: int) -> DataFrame:
    """Links within the nodes of ``rows`` (fp, path, v, node), which are the first ``depth`` bits of v."""

    def links(fp: np.ndarray, path: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        src = dst = np.zeros(0, np.uint64)
        cuts = np.flatnonzero(np.diff(path)) + 1
        for fps, values in zip(np.split(fp, cuts), np.split(v, cuts), strict=True):
            node = values >> np.uint64(64 - depth)
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            last = np.append(first[1:], len(node))
            many = last - first > 1
            for i, j in trie_links(values, first[many], last[many], depth, budget):
                if len(i):
                    src, dst = forest(np.concatenate([src, fps[i]]), np.concatenate([dst, fps[j]]))
        return pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], ["src", "dst"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("fp", "path", "v"), strict=True)]
            node = held[2].view(np.uint64) >> np.uint64(64 - depth)
            border = np.flatnonzero((held[1][1:] != held[1][:-1]) | (node[1:] != node[:-1])) + 1
            if len(border):  # the last node may go on in the next batch
                now, held = [h[: border[-1]] for h in held], [h[border[-1] :] for h in held]
                yield links(now[0].view(np.uint64), now[1], now[2].view(np.uint64))
        yield links(held[0].view(np.uint64), held[1], held[2].view(np.uint64))

    unsigned = F.col("v").bitwiseXOR(F.lit(-(1 << 63)))
    dealt = rows.repartition("path", "node").sortWithinPartitions("path", unsigned).select("fp", F.col("path").cast("long"), "v")
    return dealt.mapInArrow(walk, "src long, dst long")


def simhash_classes(docs: DataFrame, words: int = 3, budget: int = 3) -> DataFrame:
    """(doc_id, fingerprint, fp, text_hash, component_id), one row for each row of ``docs``.

    component_id is the smallest doc_id that links of up to ``budget`` differing bits reach, the
    row's own included. A null or blank text has fingerprint zero, linked like any other. Null
    doc_ids are never smallest (only nulls: null). Repeated rows stay. Other columns of ``docs``
    are left out.
    """
    rows = saved(fingerprints(docs, words), "fingerprints")
    fps = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = components(fingerprint_links(fps.select("fp"), budget))
    member = linked.join(fps, linked.node == fps.fp).select("fp", "root", "least")
    names = member.join(member.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    names = fps.join(saved(names, "names"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "fp", "text_hash", "component_id")


def text_hash():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
