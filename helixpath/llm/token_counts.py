"""Token counts without ids: pieces counted once for each distinct pre-token, joined to each document's frequencies."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import split
from .scratch import saved
from .textscan import slices

#: Pre-tokens that a task holds before it gives them out, and those sent to every task (their counts take 9 bytes each).
HELD = 400_000
FREQUENT = 1 << 18


@lru_cache(maxsize=2)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _specials(tokenizer) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())


def pretoken_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(pretoken long, n long, pieces int): every distinct pre-token of the texts by its 64-bit hash, how often it
    occurs, and the number of pieces the library makes of it. Written to the shared folder."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials, normalize = _specials(library(tokenizer)), library(tokenizer).normalizer.normalize_str
        keys, counts, texts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts), pa.array(texts, pa.string())], ["pretoken", "n", "text"])

        for batch in batches:
            for piece in slices(batch, "text"):
                found = split(piece.column("text"), specials, True, normalize)
                new, first, n = np.unique(found.hash, return_index=True, return_counts=True)
                at = np.searchsorted(keys, new)
                at[at == len(keys)] = 0
                have = keys[at] == new if len(keys) else np.zeros(len(new), bool)
                counts[at[have]] += n[have]
                fresh = np.array([found.text(i) for i in first[~have]], object)
                keys = np.concatenate([keys, new[~have]])
                order = np.argsort(keys, kind="stable")
                keys, counts, texts = keys[order], np.concatenate([counts, n[~have]])[order], np.concatenate([texts, fresh])[order]
                if len(keys) > HELD:
                    yield out()
                    keys, counts, texts = keys[:0], counts[:0], texts[:0]
        if len(keys):
            yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library(tokenizer).encode_batch_fast
        for batch in batches:
            pieces = [len(e) for e in encode(batch.column("text").to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column("pretoken"), batch.column("n"), pa.array(pieces, pa.int32())], ["pretoken", "n", "pieces"])

    once = docs.select(F.col("text").cast("string")).mapInArrow(distinct, "pretoken long, n long, text string")
    once = once.groupBy("pretoken").agg(F.sum("n").alias("n"), F.min("text").alias("text"))
    return saved(once.mapInArrow(count, "pretoken long, n long, pieces int"), "pretokens")


def _frequent(vocabulary: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The pre-tokens that occur at least some power of two times, FREQUENT at most: hashes, pieces, and that number."""
    sizes = vocabulary.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect()  # 64 rows at most
    total, least = 0, 64
    for power, n in sorted(((r["power"], r["count"]) for r in sizes), reverse=True):
        if total + n > FREQUENT:
            break
        total, least = total + n, power
    rows = vocabulary.where(F.col("n") >= F.lit(float(2**least))).select("pretoken", "pieces").toArrow()
    keys = rows.column("pretoken").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows.column("pieces").to_numpy()[order].astype(np.int64), least


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each row of ``docs``.

    The counts of the most frequent pre-tokens, a bounded number, go to every task and are summed
    there; the frequencies of all other pre-tokens are joined to their counts by a shuffle, so no
    frequent key is ever shuffled. A null text is empty and has 0 tokens. Repeated rows stay, each with a number of its own. Texts
    that hold a special token's string are counted by the library whole. Other columns of ``docs`` are left out.
    """
    vocabulary = pretoken_counts(docs, tokenizer)
    keys, pieces, least = _frequent(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((keys, pieces))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer_ = library(tokenizer)
        specials, normalize = _specials(tokenizer_), tokenizer_.normalizer.normalize_str
        keys, pieces = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts = pc.fill_null(part.column("text"), "")
                found = split(texts, specials, True, normalize)
                at = np.searchsorted(keys, found.hash)
                at[at == len(keys)] = 0
                have = keys[at] == found.hash if len(keys) else np.zeros(len(found.hash), bool)
                known = np.bincount(found.doc[have], weights=pieces[at[have]], minlength=len(texts)).astype(np.int64)
                for d in np.flatnonzero(~found.plain).tolist():
                    known[d] = len(tokenizer_.encode(texts[d].as_py(), add_special_tokens=False))
                doc, rare = found.doc[~have], found.hash[~have]
                order = np.lexsort((rare, doc))
                doc, rare = doc[order], rare[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (rare[1:] != rare[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(doc))).astype(np.int32)
                ends = np.searchsorted(doc[first], np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("row"), part.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(known),
                    pa.ListArray.from_arrays(ends, pa.array(rare[first].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times)),
                ], ["row", "doc_id", "n_bytes", "known", "pretokens", "times"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = saved(rows.mapInArrow(frequencies, "row long, doc_id long, n_bytes long, known long, pretokens array<long>, times array<int>"), "frequencies")
    rare = rows.select("row", F.explode(F.arrays_zip("pretokens", "times")).alias("x")).select("row", F.col("x.pretokens").alias("pretoken"), "x.times")
    counted = rare.join(vocabulary.where(F.col("n") < F.lit(float(2**least))).select("pretoken", "pieces"), "pretoken")
    sums = counted.groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("rare"))
    out = rows.select("row", "doc_id", "n_bytes", "known").join(sums, "row", "left")
    out = out.select("doc_id", "n_bytes", (F.col("known") + F.coalesce("rare", F.lit(0))).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
