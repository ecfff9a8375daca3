"""The pipeline's near-copy stage against brute-force Jaccard classes."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixpath.llm import near_copies

DIR = "/root/testdata/sf0.01"


def plain_set(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain_kept(rows):
    """Smallest doc_ids of the classes that pairs with a Jaccard similarity of 0.8 or more connect."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            low, high = sorted((len(sets[i]), len(sets[j])))
            if low >= 0.8 * high and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted(least.values())


@pytest.mark.parametrize("block", [near_copies.BLOCK, 7])
def test_classes_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(4)
    texts = ["", None, " \n", "one", "ONE", "one two", "Äpfel und Birnen", "ÄPFEL UND BIRNEN"]
    for _ in range(12):
        base = [f"v{rng.randrange(500)}" for _ in range(rng.choice((30, 80, 200)))]
        for _ in range(6):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
            texts.append(" ".join(words))
    rows = list(enumerate(texts)) + [(3, "one"), (50, texts[50])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == plain_kept(rows)


def test_a_large_group_is_not_compared_with_itself(spark, monkeypatch):
    """One class of 200 texts, and texts that are candidates of it: only the first round and the rest's meetings are dealt."""
    monkeypatch.setattr(near_copies, "BLOCK", 10)
    groups = spark.createDataFrame([(k, 0) for k in range(200)], "node long, root long")
    large = groups.withColumn("blocks", F.lit(20))
    first = near_copies._with_first_block(large)
    assert 200 < first.count() < 450 and {r["a"] for r in first.collect()} == {0}
    linked = spark.createDataFrame([(k, 0) for k in range(1, 195)], "src long, dst long")
    rows = near_copies._main_classes(groups, large, linked)
    assert {r["node"] for r in rows.where("not main").collect()} == set(range(195, 200))
    dealt = [(r["a"], r["b"], r["text_hash"]) for r in near_copies._with_others(rows).collect()]
    together = {}
    for a, b, node in dealt:
        together.setdefault((a, b), set()).add(node)
    met = {frozenset((x, y)) for t in together.values() for x in t for y in t if x != y}
    assert all(frozenset((x, y)) in met for x in range(195, 200) for y in range(200) if x != y) and len(dealt) < 320
    whole = spark.createDataFrame([(k, 0) for k in range(1, 200)], "src long, dst long")
    assert near_copies._with_others(near_copies._main_classes(groups, large, whole)).count() == 0


def test_stage_on_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash"](spark, docs, DIR).collect()) == plain_kept(rows)
    assert near_copies.keep_one(docs.where("false")).count() == 0


def test_bands_meet_pairs_at_the_bound():
    rng = random.Random(9)
    missed = 0
    for _ in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(94)]  # 90 runs; two inner edits leave 80 of 100
        other = list(words)
        for at in (20, 60):
            other[at] = "edit"
        keys = near_copies.band_keys(*near_copies.shingles(pa.array([" ".join(words), " ".join(other)])))
        missed += not np.any(keys[0] == keys[1])
    assert missed == 0


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(None, base), (None, base), (None, base + " end"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None), (None, ""), (7, "only"), (7, "only"), (8, "ONLY")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(1) for c in ("text_hash", "root", "a", "b", "doc", "id", "fp", "key", "main", "best", "count")}).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], (r["text"] or "").lower()) for r in kept.collect()]
    assert len(got) == 4 and {(5, "a b c d e f"), (7, "only"), (None, "")} < set(got)
    assert [t for i, t in got if i is None and t][0] in (base, base + " end")
