"""Decontamination where a plain reading of the words would lose items."""

import random
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pytest

from helixpath.llm import decontam
from helixpath.llm.textscan import Words


def block(items, frequency=None, seed=0):
    """The items with a rarity of seeds that is drawn at random: no choice of the rarest may lose a match."""
    made = decontam.Items.of(list(range(len(items))), [1] * len(items), [Words(pa.array([" ".join(x)])).hash for x in items], decontam.LEAST)
    made.keep_rarest(np.random.default_rng(seed).integers(1, 5, len(made.seeds)))
    return made


def reaches(item, text):
    return decontam.align(Words(pa.array([" ".join(item)])).hash, Words(pa.array([" ".join(text)])).hash)[0] >= decontam.LEAST * len(item) - 1e-9


@pytest.mark.parametrize("size", range(1, 13))
def test_short_items_with_any_edits(size):
    """All ways to insert a word at up to four places, and to replace or leave out up to two words."""
    item = [f"w{i}" for i in range(size)]
    texts = []
    for k in range(min(4, size) + 1):
        for places in combinations(range(size), k):
            texts.append([x for i, w in enumerate(item) for x in ([w, "new"] if i in places else [w])])
    for k in (1, 2):
        for places in combinations(range(size), min(k, size)):
            for forms in product(([], ["other"]), repeat=len(places)):
                edit = dict(zip(places, forms, strict=True))
                texts.append(["before"] * 3 + [x for i, w in enumerate(item) for x in edit.get(i, [w])] + ["after"] * 3)
    texts = [t for t in texts if t]
    for seed in range(3):
        found = {m[0] for m in decontam.matches(block([item], seed=seed), pa.array([" ".join(t) for t in texts]))}
        assert found == {d for d, t in enumerate(texts) if reaches(item, t)}
    assert found


def test_random_short_items_of_few_words():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5)]
    for seed in range(150):
        items = [[rng.choice(words) for _ in range(rng.randint(1, 11))] for _ in range(4)]
        texts = [[rng.choice(words) for _ in range(rng.randint(1, 25))] for _ in range(6)]
        found = {m[:2] for m in decontam.matches(block(items, seed=seed), pa.array([" ".join(t) for t in texts]))}
        assert found == {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if reaches(x, t)}


def test_repeated_items_match_once_for_each_row(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 10)
    items = [(1, "one two three four five six")] * 3 + [(2, "seven eight nine ten"), (1, "ten eleven twelve"), (None, "one two three four five six"), (4, "!"), (5, None)]
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "a seven eight nine ten eleven twelve"), (2, "a seven eight nine ten eleven twelve"), (3, None), (None, "")], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"] or 0) for r in decontam.contamination(docs, benchmark).collect()))
    assert got == [(1, 0), (1, 1), (1, 1), (1, 1), (2, 1), (2, 1), (2, 2), (2, 2)]
    assert len(list(decontam.item_blocks(benchmark, 0.6))) > 1
    assert sorted(str(r["doc_id"]) for r in decontam.without_leaks(docs, benchmark).collect()) == ["3", "None"]


def test_case_of_any_script_does_not_hide_items(spark):
    items = [(1, "cionmiïrr élan straße garçon über naïve"), (2, "ο λόγος της οδός είναι καλός"), (3, "это проверка регистра всех букв")]
    docs = [(k, f"before {t.upper()} after") for k, t in items] + [(10 + k, f"before {t.title()} after") for k, t in items] + [(20, None), (21, "before after")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["score"], r["first_word"]) for r in decontam.contamination(docs, benchmark).collect())
    assert got == sorted((k + more, k, 1.0, 1) for k, _ in items for more in (0, 10))
    assert sorted(r["doc_id"] for r in decontam.without_leaks(docs, benchmark).collect()) == [20, 21]
