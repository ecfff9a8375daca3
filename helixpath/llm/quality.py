"""Quality by neighbour votes in a latent semantic space: labelled vectors are broadcast, every text meets all of them.

Terms describe how a text is written: each token, its last two bytes, its kinds of characters, its length, and whether it repeats
the token before. Their weights are square roots of shares times inverse document frequencies; the latent space is that
of the labelled sample's greatest singular values. Cosines of all texts of a batch with all examples are one
matrix product for each block of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .examples import Calibration, Examples, collect_examples, document_frequencies, frequencies, held_out, inverse_frequency, sample, select_terms, vote
from .textscan import SpanHasher, mix, slices, spans, table, utf8

K = 25
VOCABULARY = 1_024
LEAST_CHI2 = 20.0
DIMENSIONS = 48
THRESHOLD = 0.3
POWER = 4
BLOCK_TEXTS = 256

_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 8  # punctuation, unless one of the next
_KIND[0x30:0x3A] = 4
_KIND[0x41:0x5B] = 1
_KIND[0x61:0x7B] = 2
_KIND[0x80:] = 16


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(texts)
    start, end, doc = spans(table("space")[data], offsets)
    if not len(start):
        return doc, np.zeros(0, np.uint64)
    hasher = SpanHasher(data)
    token = hasher(start, end)
    tail = hasher(np.maximum(end - 2, start), end)
    kinds = np.bitwise_or.reduceat(np.where(table("space")[data], _KIND[data], 0), start).astype(np.uint64)
    sizes = np.minimum(end - start, 30).astype(np.uint64) // np.uint64(3)
    again = np.zeros(len(token), np.uint64)
    again[1:] = (token[1:] == token[:-1]) & (doc[1:] == doc[:-1])
    tagged = [mix(x * np.uint64(0xA24BAED4963EE407) + np.uint64(k)) for k, x in enumerate((token, tail, kinds, sizes, again))]
    return np.tile(doc, len(tagged)), np.concatenate(tagged)


@dataclass
class Space:
    vocabulary: np.ndarray
    idf: np.ndarray
    axes: np.ndarray  # term x dimension
    examples: np.ndarray  # example x dimension, unit length
    labels: np.ndarray
    weights: tuple[float, float]
    prior: float
    calibration: Calibration | None = None

    @classmethod
    def build(cls, vocabulary: np.ndarray, idf: np.ndarray, e: Examples, weights: tuple[float, float]) -> Space:
        labels, size, v = e.labels, len(e.labels), len(vocabulary)
        x = np.zeros((size, v))
        for i, (t, c) in enumerate(zip(e.terms, e.times, strict=True)):
            x[i, t] = _weights(c, np.array([c.sum()]), idf[t])
        # the right singular vectors, by the smaller symmetric matrix
        values, vectors = np.linalg.eigh(x.T @ x) if v else (np.zeros(0), np.zeros((0, 0)))
        axes = vectors[:, np.argsort(-values, kind="stable")[:DIMENSIONS]]
        axes = axes * np.where(axes.sum(0) < 0, -1, 1)
        total = np.where(labels == 1, weights[1], weights[0])
        prior = float((total * labels).sum() / total.sum()) if size else 0.5
        made = cls(vocabulary, idf, axes, _unit(x @ axes), labels, weights, prior)
        votes = np.concatenate([made.votes(made.examples[i : i + BLOCK_TEXTS], without=i) for i in range(0, size, BLOCK_TEXTS)]) if size else np.zeros(0)
        made.calibration = Calibration.fit(votes, labels, total)
        return made

    def votes(self, latent: np.ndarray, without: int = -1) -> np.ndarray:
        """Votes of the K examples nearest to each row; ``without``: row r is example without + r, which has no part in its own."""
        cosine = latent @ self.examples.T
        if without >= 0:
            r = np.arange(len(latent))
            cosine[r, without + r] = -1
        k = min(K, cosine.shape[1])
        if not k:
            return np.full(len(latent), self.prior)
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        return vote(np.take_along_axis(cosine, near, 1), self.labels[near], self.weights, self.prior, POWER)

    def judge(self, texts: pa.Array) -> np.ndarray:
        doc, term, times = frequencies(terms, self.vocabulary, texts)
        latent = np.zeros((len(texts), self.axes.shape[1]))
        if len(doc):
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            share = np.repeat(np.add.reduceat(times, first), np.diff(np.append(first, len(doc))))
            weight = _weights(times, share, self.idf[term])
            for a in range(0, len(first), BLOCK_TEXTS):  # the gathered axes of so many texts at a time
                low, high = first[a], first[a + BLOCK_TEXTS] if a + BLOCK_TEXTS < len(first) else len(doc)
                latent[doc[first[a : a + BLOCK_TEXTS]]] = np.add.reduceat(weight[low:high, None] * self.axes[term[low:high]], first[a : a + BLOCK_TEXTS] - low)
        latent = _unit(latent)
        votes = np.concatenate([self.votes(latent[i : i + BLOCK_TEXTS]) for i in range(0, len(texts), BLOCK_TEXTS)] or [np.zeros(0)])
        found = np.clip(self.calibration(votes), 0.0, 1.0)
        return np.where(latent.any(axis=1), found, self.prior)


def _weights(times: np.ndarray, total: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return np.sqrt(times / total) * idf


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(-1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Broadcast:
    """The latent space and vectors of the labelled sample, of a bounded size, sent to every task."""
    s = sample(docs, labels, label)
    vocabulary = select_terms(s, terms, VOCABULARY, LEAST_CHI2)
    idf = inverse_frequency(*document_frequencies(docs, terms, vocabulary))
    return docs.sparkSession.sparkContext.broadcast(Space.build(vocabulary, idf, collect_examples(s, terms, vocabulary), s.weights))


def scores(docs: DataFrame, space: Broadcast) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs``.

    A null, an empty text or one without a known term has a zero vector, to which all examples are equally far: it gets the
    share of label 1. Repeated rows stay; other columns are left out.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(space.value.judge(part.column("text")))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
