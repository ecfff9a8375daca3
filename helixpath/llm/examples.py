"""A bounded sample of labelled texts, the terms that tell its classes apart, and calibrated scores: shared by both classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import saved
from .textscan import slices

#: Labelled rows of each class that are learnt from, at most: a sample by a hash of doc_id (the documented bound).
PER_CLASS = 2_000
FOLDS = 5

#: A batch's texts to (text index, 64-bit term) of every occurrence.
Terms = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from. A null id has no label and is not held out."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


@dataclass
class Sample:
    texts: DataFrame  # doc_id, label, text; at most 2 * PER_CLASS rows, in the shared folder
    weights: tuple[float, float]  # labelled rows that a sampled one of each class stands for


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS) -> Sample:
    """Labelled rows outside the held-out fold. Of repeated labels of an id the greatest counts, of repeated texts the least; nulls are left out."""
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    ids = None
    for k in (0, 1):
        some = known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = some if ids is None else ids.union(some)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(ids), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return Sample(saved(texts, "sample"), tuple(totals.get(k, 0) / max(1, min(per_class, totals.get(k, 0))) for k in (0, 1)))


def select_terms(s: Sample, terms: Terms, most: int, least_chi2: float) -> np.ndarray:
    """The terms by which the classes differ most by chi-squared over texts, sorted. At most ``most``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                doc, term = terms(part.column("text"))
                label = part.column("label").to_numpy(zero_copy_only=False)
                order = np.lexsort((doc, term))
                doc, term = doc[order], term[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
                doc, term = doc[new], term[new]
                if len(term):
                    ids, where = np.unique(term, return_inverse=True)
                    n1 = np.bincount(where, weights=label[doc]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(np.bincount(where) - n1), pa.array(n1)], ["term", "n0", "n1"])

    sizes = {r["label"]: r["count"] for r in s.texts.groupBy("label").count().collect()}
    a, b = float(sizes.get(0, 0)), float(sizes.get(1, 0))
    counts = s.texts.mapInArrow(count, "term long, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    both = F.col("n0") + F.col("n1")
    chi2 = (a + b) * (F.col("n0") * b - F.col("n1") * a) ** 2 / (F.lit(a * b) * both * (F.lit(a + b) - both))
    best = counts.where(both >= 3).where(both < a + b).withColumn("chi2", chi2).where(F.col("chi2") >= least_chi2)
    return np.sort(best.orderBy(F.desc("chi2"), "term").limit(most).select("term").toArrow().column("term").to_numpy().view(np.uint64))


def frequencies(terms: Terms, vocabulary: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term of the vocabulary, number of times), by text and term."""
    doc, term = terms(texts)
    if not len(vocabulary) or not len(term):
        return (np.zeros(0, np.int64),) * 3
    at = np.searchsorted(vocabulary, term)
    at[at == len(vocabulary)] = 0
    hit = vocabulary[at] == term
    pairs, n = np.unique(doc[hit].astype(np.int64) * len(vocabulary) + at[hit], return_counts=True)
    return pairs // len(vocabulary), pairs % len(vocabulary), n


def document_frequencies(docs: DataFrame, terms: Terms, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each term of the vocabulary is, and how many documents there are. A task gives one row for each term it met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, texts = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            texts += batch.num_rows
            for part in slices(batch, "text"):
                n += np.bincount(frequencies(terms, vocabulary, part.column("text"))[1], minlength=len(vocabulary))
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1)), pa.array(np.append(n[met], texts))], ["term", "n"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    by_term = dict(zip(counts.column("term").to_pylist(), counts.column("n").to_pylist(), strict=True))
    return np.array([by_term.get(t, 0) for t in range(len(vocabulary))], np.int64), by_term.get(-1, 0)


@dataclass
class Examples:
    """The sampled texts, in an order that the content alone decides."""

    names: np.ndarray
    labels: np.ndarray
    terms: list[np.ndarray]
    times: list[np.ndarray]


def collect_examples(s: Sample, terms: Terms, vocabulary: np.ndarray) -> Examples:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                doc, term, n = frequencies(terms, vocabulary, part.column("text"))
                ends = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, n)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), *lists], ["doc_id", "label", "terms", "times"])

    found = s.texts.mapInArrow(rows, "doc_id long, label int, terms array<int>, times array<int>").orderBy("label", "terms", "times", "doc_id").toArrow()
    arrays = [[np.array(x, np.int64) for x in found.column(c).to_pylist()] for c in ("terms", "times")]
    return Examples(found.column("doc_id").to_numpy(), found.column("label").to_numpy(), *arrays)


def inverse_frequency(n: np.ndarray, texts: int) -> np.ndarray:
    return np.log((1 + texts) / (1 + n)) + 1


@dataclass
class Calibration:
    """A step-free monotone map from votes to probabilities: isotonic regression on votes whose own example had no part."""

    votes: np.ndarray
    probabilities: np.ndarray

    @classmethod
    def fit(cls, votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Calibration:
        """Blocks of the sorted votes are merged while a later one has a lower mean; one pseudo-example at the mean of all keeps
        probabilities off 0 and 1 in blocks of few."""
        if not len(votes):
            return cls(np.array([0.0, 1.0]), np.array([0.5, 0.5]))
        x, where = np.unique(votes, return_inverse=True)
        w = np.bincount(where, weights=weights)
        y = np.bincount(where, weights=weights * labels) / w
        blocks: list[list[float]] = []  # mean, weight, first and last vote
        for xi, yi, wi in zip(x.tolist(), y.tolist(), w.tolist(), strict=True):
            blocks.append([yi, wi, xi, xi])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                m, n, _, last = blocks.pop()
                p = blocks[-1]
                blocks[-1] = [(p[0] * p[1] + m * n) / (p[1] + n), p[1] + n, p[2], last]
        prior = float((weights * labels).sum() / weights.sum())
        points = [(v, (m * n + prior) / (n + 1)) for m, n, low, high in blocks for v in dict.fromkeys((low, high))]
        values = np.array([p for _, p in points])
        return cls(np.array([v for v, _ in points]), np.maximum.accumulate(values))

    def __call__(self, votes: np.ndarray) -> np.ndarray:
        return np.interp(votes, self.votes, self.probabilities)


def vote(similarity: np.ndarray, labels: np.ndarray, weights: tuple[float, float], prior: float, power: int) -> np.ndarray:
    """Votes of neighbours (last axis) weighted by similarity^power and by what each stands for; the prior weighs as a neighbour of similarity 0.1."""
    w = np.maximum(similarity, 0) ** power * np.where(labels == 1, weights[1], weights[0])
    base = 0.1**power
    return ((w * labels).sum(-1) + base * prior) / (w.sum(-1) + base)
