"""Toxicity by the nearest labelled examples: exact TF-IDF cosine on a block-max inverted index.

Terms are words and their first 4 and 5 bytes (lower-cased), of which chi-squared selects a bounded vocabulary on the labelled sample;
their document frequencies are counted over all documents. The index holds the distinct vectors of the examples in blocks of BLOCK: for
each block the postings of the terms it has, and for each block and term the greatest weight. A batch of texts visits a block with those
texts only whose upper bound reaches their K-th best so far, so the neighbours are exact. Weights are whole numbers on a
grid of 1 / GRID: sums of their products are exact in any order, and equal texts have equal scores wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .examples import Calibration, Examples, collect_examples, document_frequencies, frequencies, held_out, inverse_frequency, sample, select_terms
from .textscan import Words, mix, slices

K = 15
BLOCK = 64
VOCABULARY = 4_096
LEAST_CHI2 = 15.0
THRESHOLD = 0.5
POWER = 2
PREFIXES = (4, 5)
#: Steps of a weight: 23 bits, so that a cosine's sum has 46 and a bound's 52 at most, which doubles hold exactly.
GRID = 1 << 23
#: Texts that visit the blocks together.
TEXTS = 256


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = Words(pc.utf8_lower(pc.fill_null(texts, "")))
    docs, found = [w.doc], [w.hash]
    for n in PREFIXES:
        long = w.end - w.start > n
        start = w.start[long]
        docs.append(w.doc[long])
        found.append(mix(w.hasher(start, start + n) + np.uint64(n)))
    return np.concatenate(docs), np.concatenate(found)


@dataclass
class Index:
    vocabulary: np.ndarray
    idf: np.ndarray
    weights: tuple[float, float]
    prior: float
    counts: np.ndarray  # vector x class: the examples that have it
    names: np.ndarray  # the least doc_id of those
    block_max: np.ndarray  # term x block
    posted: list[np.ndarray] = field(default_factory=list)  # of each block, the terms it has
    postings: list[np.ndarray] = field(default_factory=list)  # of each block, weights: term of ``posted`` x vector
    calibration: Calibration | None = None

    @classmethod
    def build(cls, vocabulary: np.ndarray, idf: np.ndarray, e: Examples, weights: tuple[float, float]) -> Index:
        size, v = len(e.labels), len(vocabulary)
        same: dict[tuple[bytes, bytes], list[int]] = {}
        for i, (t, c) in enumerate(zip(e.terms, e.times, strict=True)):
            if len(t):
                same.setdefault((t.tobytes(), c.tobytes()), []).append(i)
        members = list(same.values())
        rows = [unit(e.terms[m[0]], e.times[m[0]], idf) for m in members]
        # vectors with the same heaviest terms stand together, which makes the bounds of blocks tight
        lead = [e.terms[m[0]][np.lexsort((e.terms[m[0]], -r))].tolist() for m, r in zip(members, rows, strict=True)]
        order = sorted(range(len(members)), key=lambda g: (lead[g], e.times[members[g][0]].tolist()))
        members, rows = [members[g] for g in order], [rows[g] for g in order]
        counts = np.array([np.bincount(e.labels[m], minlength=2) for m in members], float).reshape(-1, 2)
        names = np.array([e.names[m].min() for m in members], np.int64)
        total = np.where(e.labels == 1, weights[1], weights[0])
        prior = float((total * e.labels).sum() / total.sum()) if size else 0.0
        blocks = max(1, -(-len(members) // BLOCK))
        made = cls(vocabulary, idf, weights, prior, counts, names, np.zeros((v, blocks)))
        for b in range(blocks):
            dense = np.zeros((v, min(BLOCK, len(members) - b * BLOCK)))
            for k in range(dense.shape[1]):
                dense[e.terms[members[b * BLOCK + k][0]], k] = rows[b * BLOCK + k]
            made.block_max[:, b] = dense.max(axis=1, initial=0)
            made.posted.append(np.flatnonzero(made.block_max[:, b]))
            made.postings.append(dense[made.posted[b]])
        made.calibration = Calibration.fit(*made._left_out(e, members, rows, total))
        return made

    def _left_out(self, e: Examples, members: list[list[int]], rows: list[np.ndarray], total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Votes on every example without itself, its label and weight."""
        votes = np.full(len(e.labels), self.vote(*(np.zeros((1, 1)),) * 3)[0])
        for a in range(0, len(members), TEXTS):
            some = members[a : a + TEXTS]
            who, similarity = self.nearest(self._dense([e.terms[m[0]] for m in some], rows[a : a + TEXTS]), K + 1)
            own = who == np.arange(a, a + len(some))[:, None]
            for label in (0, 1):
                n = [self.counts[who, k] * (who >= 0) - own * (k == label) for k in (0, 1)]
                voted = self.vote(similarity, np.maximum(n[0], 0), np.maximum(n[1], 0))
                for m, x in zip(some, voted, strict=True):
                    votes[[i for i in m if e.labels[i] == label]] = x
        return votes, e.labels, total

    def _dense(self, term: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
        dense = np.zeros((len(term), len(self.vocabulary)))
        for k, (t, r) in enumerate(zip(term, rows, strict=True)):
            dense[k, t] = r
        return dense

    def nearest(self, texts: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of weights, the ``k`` distinct vectors of the greatest cosine above 0 (ties: the earlier one) in that order, and
        their cosines; -1 and 0 where there are fewer."""
        step = 1 << max(1, len(self.names).bit_length())
        best = np.full((len(texts), k), -1, np.int64)  # cosine, then place: one whole number
        bound = texts @ self.block_max
        lead = bound.argmax(axis=1)
        for first in (True, False):
            for b, (posted, postings) in enumerate(zip(self.posted, self.postings, strict=True)):
                some = np.flatnonzero((lead == b) == first)
                some = some[(bound[some, b] > 0) & (bound[some, b] >= best[some, 0] // step)]
                if len(some):
                    cosine = (texts[np.ix_(some, posted)] @ postings).astype(np.int64)
                    place = step - 1 - (b * BLOCK + np.arange(cosine.shape[1]))
                    found = np.where(cosine > 0, cosine * step + place, -1)
                    best[some] = np.partition(np.concatenate([best[some], found], axis=1), -k, axis=1)[:, -k:]
        best = -np.sort(-best, axis=1)
        return np.where(best < 0, -1, step - 1 - best % step), np.where(best < 0, 0, best // step) / GRID**2

    def vote(self, similarity: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
        """Votes of the K nearest examples, weighted by similarity^POWER and by what each label stands for. Vectors come from near to far with the
        number of examples that have them; the last one's share what is left of K. The prior weighs as an example of similarity 0.1."""
        n = n0 + n1
        part = np.clip(K - (np.cumsum(n, axis=1) - n), 0, n) / np.maximum(n, 1) * similarity**POWER
        toxic, clean = (part * n1).sum(1) * self.weights[1], (part * n0).sum(1) * self.weights[0]
        base = 0.1**POWER
        return (toxic + base * self.prior) / (toxic + clean + base)

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of texts, and the nearest vectors and similarities that made them."""
        doc, term, times = frequencies(terms, self.vocabulary, texts)
        who, similarity = np.full((len(texts), K), -1), np.zeros((len(texts), K))
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
        ends = np.append(first, len(doc))
        for a in range(0, len(first), TEXTS):
            some, low, high = doc[first[a : a + TEXTS]], ends[a], ends[min(a + TEXTS, len(first))]
            weight = (1 + np.log(times[low:high])) * self.idf[term[low:high]]
            row = np.repeat(np.arange(len(some)), np.diff(ends[a : a + len(some) + 1]))
            size = np.sqrt(np.add.reduceat(weight * weight, first[a : a + TEXTS] - low))
            dense = np.zeros((len(some), len(self.vocabulary)))
            dense[row, term[low:high]] = np.rint(weight / size[row] * GRID)
            who[some], similarity[some] = self.nearest(dense)
        n = [self.counts[who, k] * (who >= 0) if len(self.counts) else np.zeros(who.shape) for k in (0, 1)]
        return np.clip(self.calibration(self.vote(similarity, *n)), 0.0, 1.0), who, similarity


def unit(term: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(times)) * idf[term]
    return np.rint(x / np.sqrt(np.add.reduceat(x * x, [0])) * GRID) if len(x) else x


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Broadcast:
    """The index of the labelled sample, of a bounded size, sent to every task."""
    s = sample(docs, labels, label)
    vocabulary = select_terms(s, terms, VOCABULARY, LEAST_CHI2)
    idf = inverse_frequency(*document_frequencies(docs, terms, vocabulary))
    return docs.sparkSession.sparkContext.broadcast(Index.build(vocabulary, idf, collect_examples(s, terms, vocabulary), s.weights))


EVIDENCE = 3


def scores(docs: DataFrame, index: Broadcast) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence), one row for each row of ``docs``.

    score: the calibrated vote of the K nearest examples; evidence: up to EVIDENCE of the nearest vectors, with the least doc_id of the examples that have them,
    how many those are and how many of them are toxic. A null, an empty text or one without a known term has no neighbour and gets the calibrated prior.
    Without labelled rows every score is the same. Repeated rows stay; other columns are left out.
    """
    kind = pa.struct([("doc_id", pa.int64()), ("examples", pa.int32()), ("toxic", pa.int32()), ("similarity", pa.float64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found, who, similarity = index.value.judge(part.column("text"))
                who, similarity = who[:, :EVIDENCE], similarity[:, :EVIDENCE]
                there = who >= 0
                ends = np.r_[0, np.cumsum(there.sum(1))].astype(np.int32)
                n = index.value.counts[who[there]].astype(np.int32)
                near = pa.StructArray.from_arrays([pa.array(x) for x in (index.value.names[who[there]], n.sum(1, dtype=np.int32), n[:, 1], similarity[there])], fields=list(kind))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found), pa.ListArray.from_arrays(ends, near)], ["doc_id", "score", "evidence"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = out.mapInArrow(rows, "doc_id long, score double, evidence array<struct<doc_id:long,examples:int,toxic:int,similarity:double>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, index: Broadcast, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns; no row moves to another task.

    Null and empty texts have the calibrated prior as their score, as in ``scores``; repeated rows stay or go together.
    """

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(index.value.judge(part.column("text"))[0] < threshold))

    return docs.mapInArrow(clean, docs.schema)
