"""Top-k search, filter audit and tokenizer alignment against plain versions, on odd rows: nulls, empty and very long texts, ties, repetitions, clashing columns."""

import hashlib
import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from helixpath.llm import alignment, filter_audit, queries, topk

SMALL = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def clashing(df):
    """``df`` with columns whose names could clash with those the operators make."""
    names = [n for n in ("query_id", "rank", "score", "id", "vector", "part", "good", "A", "digest", "row", "pairs") if n not in df.columns]
    return df.withColumns({n: F.lit("x") for n in names} | {"an odd name": F.create_map(F.lit("k"), F.lit(1))})


# Top-k search


def plain_top(rows, k):
    good = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(1024 * x) for x in v):
            good.append((i, [math.floor(1024 * x) for x in v]))
    out = []
    for q, x in good:
        if q is None or q % 100:
            continue
        scored = [(sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in good if i != q]
        scored = [(min(max(s, -(2**63)), 2**63 - 1), i) for s, i in scored]
        scored.sort(key=lambda t: (-t[0], t[1] is None, t[1] or 0))
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def found_top(df):
    return sorted([tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()], key=str)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_search(spark, parts, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_TILE", 64)
    monkeypatch.setattr(topk, "QUERY_TILE", 3)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 600)
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(0, 1_500, 3)]
    rows += [(i, [1.0] * 8) for i in range(2_001, 2_300)]  # one very common vector, and ties
    rows += [(None, [1.0] * 8), (4, None), (5, []), (6, [None] * 8), (7, [float("nan")] * 8), (8, [float("inf")] + [0.0] * 7), (9, [9.0]), (300, [1.0] * 8), (2_001, [1.0] * 8), (400, []), (500, None), (-100, [0.5] * 9), (11, [1e306] * 8)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).repartition(parts)
    assert found_top(topk.search(df, F.col("vec_id") % 100 == 0)) == plain_top(rows, 10)


def test_search_in_every_precision(spark):
    for size in (1.0, 3e3, 1e9):
        rng = np.random.default_rng(6)
        rows = [(i, (rng.standard_normal(5) * size).tolist()) for i in range(150)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert found_top(topk.search(df, F.col("vec_id") % 100 == 0, k=3)) == plain_top(rows, 3), size


def test_search_of_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert found_top(topk.search(df, F.col("vec_id") % 100 == 0)) == [(0, 1, 1, 1024 * 2048)]
    assert topk.search(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.search(df, F.lit(None).cast("boolean")).count() == 0


def test_search_of_the_table(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    assert found_top(queries.op11_topk(spark, SMALL)) == plain_top([(r["vec_id"], r["embedding"]) for r in table.collect()], 10)


# Filter audit


def plain_audit(docs, labels):
    docs = [(i, t or "", g or "") for i, t, g in docs]
    mark = lambda k: {r[0] for r in labels if r[k] == 1}
    good, toxic = mark(1), mark(2)
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t] = min(smallest.get(t, i), i)
    counted = Counter()
    for i, t, g in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and smallest[t] < i}
        counted[g, frozenset(f for f in fails if fails[f]), i is not None and i in good, i is not None and i in toxic] += 1
    out = {}
    for g in {k[0] for k in counted}:
        rows, shares = [], Counter()
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                kept = removed = redundant = unique = lost_good = lost_toxic = 0
                for (part, fails, is_good, is_toxic), n in counted.items():
                    if part != g:
                        continue
                    before = fails & set(order[:step])
                    kept += n * (not before and f not in fails)
                    removed += n * (not before and f in fails)
                    redundant += n * (bool(before) and f in fails)
                    unique += n * (fails == {f})
                    lost_good += n * (not before and f in fails and is_good)
                    lost_toxic += n * (not before and f in fails and is_toxic)
                shares[f] += removed
                rows.append(("".join(order), step + 1, kept, removed, redundant, unique, lost_good, lost_toxic))
        for r in rows:
            out[g, r[0], r[1]] = (*r[2:], shares[r[0][r[1] - 1]])
    return out


def found_audit(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


def test_filter_audit(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()]
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = table + [(None, None, None), (None, "null id", "en"), (None, "null id", "en"), (-3, "", "en"), (-2, " \t\n\x0b\f\r", None), (-1, long, "en"), (900, "Same Text", "fr"), (900, "Same Text", "fr"), (901, "Same Text", ""), (902, "É" * 300 + " #", "xx"), (903, None, "xx")]
    marks = [tuple(r) for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality", "toxic").collect()] + [(900, 1, 1), (900, 0, 1), (None, 1, 1), (901, None, 1)]
    docs, labels = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string")), clashing(spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    run = lambda d, x: filter_audit.audit(filter_audit.joint_failures(filter_audit.flags(d, x)))
    assert found_audit(run(docs, labels)) == plain_audit(rows, marks)
    assert run(docs.where("false"), labels).count() == 0
    assert found_audit(run(docs, labels.where("false"))) == plain_audit(rows, [])


# Alignment


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    texts = []
    for i, text in rows:
        groups = []
        if text:
            ids_a, ids_b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
            spell_a = [bytes(byte[c] for c in one.id_to_token(x)) for x in ids_a]
            spell_b = [bytes([int(two.id_to_piece(x)[3:5], 16)]) if two.is_byte(x) else two.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
            if b"".join(spell_a) == b"".join(spell_b) == (" " + text).encode():
                at = lambda spelled: np.cumsum([len(s) for s in spelled]).tolist()
                ends_a, ends_b = at(spell_a), at(spell_b)
                place_a, place_b = ({e: i + 1 for i, e in enumerate(ends)} for ends in (ends_a, ends_b))
                low_a = low_b = 0
                for cut in sorted(set(ends_a) & set(ends_b)):
                    high_a, high_b = place_a[cut], place_b[cut]
                    groups.append((ids_a[low_a:high_a], ids_b[low_b:high_b]))
                    low_a, low_b = high_a, high_b
        texts.append((i, groups))
    held = [Counter((x, y) for a, b in groups for x in a for y in b) for _, groups in texts]
    count = Counter(p for h in held for p in h)
    highest = {}
    for (x, _), n in count.items():
        highest[x] = max(highest.get(x, 0), n)
    out = []
    for (i, groups), h in zip(texts, held, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(n for p, n in h.items() if count[p] == highest[p[0]])
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(h.values()), best, sum(n * count[p] for p, n in h.items()), hashlib.sha256(text.encode()).hexdigest() if groups else "", text))
    return out


ODD = [
    (None, None), (None, "null id"), (-3, ""), (-2, " \t\n"), (-1, " ".join(f"w{i % 977}" for i in range(30_000))), (700, "same text here"), (700, "same text here"), (701, "same text here"), (702, "a▁b"), (703, "▁"),
    (704, "Ünïcode Ωmega 日本語 İ <|endoftext|> <s>x</s> <0x41> it's 'LL"), (705, "é" * 3_000), (706, " " * 5_000 + "x" + " " * 77), (707, " 　﻿ á \U0001f600\U0001f468‍\U0001f469"), (708, "0123456789" * 700),
    (709, "x"), (710, "\x00\x01 a  b   c    "), (711, "aGVsbG8gd29ybGQ" * 90), (712, "￿\U0010ffff ຂ້ອຍ ᚠᚢᚦ 𐍈 𓀀"), (713, "\r\n\r\n\t\t  \n x"),
]


@pytest.mark.parametrize("frequent", [1 << 20, 40, 0])
def test_alignment(spark, frequent):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()] + ODD
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    found = alignment.alignment_counts(docs, A, B, frequent).select(*names).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str(r[:-1]) for r in plain_alignment(rows))
    assert alignment.alignment_counts(docs.where("false"), A, B, frequent).count() == 0


def test_alignment_groups(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    assert sorted(map(str, map(tuple, alignment.aligned(docs, A, B, groups=True).select("doc_id", "groups").collect()))) == sorted(str((r[0], r[-1])) for r in plain_alignment(ODD))


def test_pairs_of_large_groups_by_distinct_ids(monkeypatch):
    texts = pa.array([t for _, t in ODD])
    one, two = alignment.byte_level(A), alignment.pieces(B)
    results = []
    for large in (0, 3, 1 << 40):
        monkeypatch.setattr(alignment, "LARGE", large)
        results.append([x.tolist() for x in alignment.Aligned(texts, one, two).pairs()])
    assert results[0] == results[1] == results[2]


def test_memory_of_ids_is_bounded(monkeypatch):
    one = alignment.ByteLevel(A)
    one.memo.most = 50
    texts = pa.array([f" word{i} other{i * 7}" for i in range(60)])
    for low in range(0, 60, 10):
        part = texts.slice(low, 10)
        ids, n = one(part)
        want = [e.ids for e in one.library.encode_batch_fast(part.to_pylist(), add_special_tokens=False)]
        assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]
        one.memo.most = 50
