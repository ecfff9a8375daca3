"""Each operator against a plain version, an exact round trip or held-out labels, on odd rows: nulls, empty and very long texts, ties, repetitions, extra columns."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from helixpath.llm import components, decontam, examples, licenses, mixing, ogg, pretokens, quality, queries, simhash, token_counts, token_files, toxicity, url_rules
from helixpath.llm.textscan import Words, slices

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [
    (None, None, None, None, None), (None, "null id", "en", "b", 7), (-3, "", "en", "a", 0), (-2, " \t\n", "en", "a", 3), (-1, LONG, "en", "a", len(LONG)), (7, "same text here", "en", "b", 14), (7, "same text here", "en", "b", 14),
    (8, "same text here", "fr", None, 14), (9, "SAME Text\there", "en", "c", 14), (10, "Ünïcode Ωmega 日本語 \u0130 <|endoftext|> it's 'LL 've", "de", "c", 40), (11, "é" * 3_000, "fr", "c", 3_000), (12, "x", "en", "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows = [(r[0] + 100, *r[1:]) for r in rows] + ODD
    # columns whose names could clash with those the operators make
    return spark.createDataFrame(rows, COLUMNS).withColumns({"score": F.lit(1), "fp": F.lit("x"), "size": F.lit(2), "bucket": F.lit(3), "label": F.lit(4)}).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def plain_rows(docs):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect()]


def by_id(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


# SimHash


def plain_fingerprint(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_classes(docs, none):
    rows = [(i, plain_fingerprint(t)) for i, t, _ in plain_rows(docs)]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = [(i, f"{fp:016x}", least.get(find(k))) for k, (i, fp) in enumerate(rows)]
    got = [tuple(r) for r in simhash.simhash_classes(docs).select("doc_id", "fingerprint", "component_id").collect()]
    assert by_id(got) == by_id(want)
    assert simhash.simhash_classes(none).count() == 0


def test_trie_links_are_all_links(monkeypatch):
    monkeypatch.setattr(simhash, "OPEN_PAIRS", 64)
    monkeypatch.setattr(simhash, "COMPARED", 100)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    near = [base ^ sum(np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64) for _ in range(k)) for k in (1, 2, 3, 4)]
    x = np.unique(np.concatenate([base, *near, [np.uint64(0), np.uint64(2**64 - 1)]]))
    for budget in (0, 3):
        for level in (0, 5, 64):
            node = [int(v) >> (64 - level) for v in x]
            first = np.array([k for k in range(len(x)) if not k or node[k] != node[k - 1]])
            got = [(i, j) for p, q in simhash.trie_links(x, first, np.append(first[1:], len(x)), level, budget) for i, j in zip(p.tolist(), q.tolist(), strict=True)]
            assert len(got) == len(set(got))
            assert set(got) == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if node[i] == node[j] and (int(x[i]) ^ int(x[j])).bit_count() <= budget}


def test_a_part_of_the_bits_leads(spark):
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(20)] + [0, 2**64 - 1, 2**63]
    rows = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "v long")
    for depth in (0, 16, 28, 37, 43):
        wide = (64 - depth) // 4
        for k in range(4):
            moved, n = simhash._led_by(F.col("v"), depth, k, 4)
            assert n == wide
            for r in rows.select("v", moved.alias("m")).collect():
                bits = f"{r['v'] % 2**64:064b}"
                part = slice(depth + k * wide, depth + (k + 1) * wide)
                assert f"{r['m'] % 2**64:064b}" == bits[:depth] + bits[part] + bits[depth : part.start] + bits[part.stop :]


@pytest.mark.parametrize("leaf", [2, 20, 10_000])
def test_trie_is_cut_where_nodes_are_large(spark, monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF_ROWS", leaf)
    rng = np.random.default_rng(5)
    hot = (np.uint64(0xABCDEF) << np.uint64(40)) | rng.integers(0, 2**20, 400, dtype=np.uint64)  # one prefix holds most
    x = np.unique(np.concatenate([hot, rng.integers(0, 2**63, 100, dtype=np.uint64)]))
    fps = spark.createDataFrame([(int(v) - 2**64 if v >= 2**63 else int(v),) for v in x], "fp long")
    got = {r["node"]: r["root"] for r in components.components(simhash.fingerprint_links(fps)).collect()}
    a, b = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3, 1))
    want = dict(zip(*(v.view(np.int64).tolist() for v in components.forest(x[a], x[b])), strict=True))
    groups = lambda m: sorted(sorted([k, *(n for n in m if m[n] == k and n != k)]) for k in set(m.values()))
    assert groups(got) == groups(want)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + k) for k in range(1, 60)] + [(5, 5), (2000, 2000), (None, 3), (3, 2), (3, 2)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + k: 1000 for k in range(60)}, 2000: 2000}
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0


# Tokens


SCRIPTS = ["Ελληνικά Σίσυφος ", "Кириллица, ещё ", "汉字漢字かな交じり文。", "한국어 조합 \u1112\u1161\u11ab ", "हिन्दी भाषा ", "ภาษาไทย ", "עברית שָׁלוֹם ", "العربية مَرْحَبًا ", "“quotes” — dash… ’s ", "e\u0301 a\u0323\u0302 \u212b ", "İstanbul ıI ", "😀🏽‍👍 ", "\u3000\u2003\u200b ", "Ⅻ ½ ٣٤ ४५ ", "𝒳𝟘 𐐀 ", "ﬁﬂ ǅ ", "\U00032000\U000e0041 "]


@pytest.mark.parametrize(("name", "words"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_pretokens_are_the_librarys(name, words):
    encoder = token_files.Encoder(public_tokenizers.path(name))
    normalize = encoder.library.normalizer.normalize_str if words else str
    rng = random.Random(7)
    parts = [*"aBsTrvmLdE'' \n\t.,!9é½²́_-—ÖñЖΣ\x1c\x85\xa0", "'s", "'re", "'ll", " 've", "  ", "'LL"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1_500)] + ["", None, *(t for _, t, *_ in ODD)]
    texts += ["".join(rng.choice(SCRIPTS)[rng.randint(0, 3) :] for _ in range(rng.randint(1, 9))) for _ in range(600)]
    found = pretokens.split(pa.array(texts), encoder.specials, words, normalize)
    pieces = [[] for _ in texts]
    for k in range(len(found.start)):
        pieces[found.doc[k]].append(found.text(k))
    encode = lambda t: encoder.library.encode(t, add_special_tokens=False).ids
    assert all(found.plain[d] for d, t in enumerate(texts) if not any(s in (t or "") for s in encoder.specials))
    for d, t in enumerate(texts):
        if found.plain[d]:
            assert [i for p in pieces[d] for i in encode(p)] == encode(t or ""), t


@pytest.mark.parametrize(("name", "words"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_every_character_is_split_as_the_library_does(name, words):
    """Each character between letters, after an apostrophe and after a mark that may join it, in texts of 64 characters."""
    encoder = token_files.Encoder(public_tokenizers.path(name))
    normalize = encoder.library.normalizer.normalize_str if words else str
    points = [c for c in range(0x40000) if not 0xD800 <= c < 0xE000] + list(range(0x40000, 0x110000, 997))
    texts = ["".join(f"a{chr(c)}b '{chr(c)} " for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    want = encoder.library.encode_batch_fast(texts, add_special_tokens=False)
    found = pretokens.split(pa.array(texts), encoder.specials, words, normalize)
    assert found.plain.all()
    ids = encoder.library.encode_batch_fast([found.text(k) for k in range(len(found.start))], add_special_tokens=False)
    got = [[] for _ in texts]
    for d, e in zip(found.doc.tolist(), ids, strict=True):
        got[d] += e.ids
    assert [k for k in range(len(texts)) if got[k] != want[k].ids] == []


def test_token_counts(docs, none, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = token_counts.library(path)
    monkeypatch.setattr(token_counts, "FREQUENT", 200)  # most pre-tokens go through the join
    want = [(i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False)), n > 2048) for i, t, _ in plain_rows(docs)]
    got = [tuple(r) for r in token_counts.token_counts(docs, path).collect()]
    assert by_id(got) == by_id(want) and any(r[3] for r in got)
    assert token_counts.token_counts(none, path).count() == 0


def test_token_files(spark, docs, none, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = token_counts.library(path)
    got = [tuple(r) for r in token_files.read_ids(spark, token_files.write_ids(docs, path, 2)).orderBy("start").collect()]
    texts = {}
    for i, t, _ in plain_rows(docs):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        texts.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    seen, at = {}, 0
    for i, start, n, crc in got:
        assert start == at
        at += n
        seen.setdefault(i, []).append((n, crc))
    assert {i: sorted(x) for i, x in seen.items()} == {i: sorted(x) for i, x in texts.items()}
    ids = [r[0] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 500)
    out = token_files.write_ids(docs, path, 2)
    assert spark.read.parquet(out).count() > 8
    every = token_files.read_range(spark, out, 0, at)
    assert len(every) == at and all(zlib.crc32(every[start : start + n].astype("<u4").tobytes()) == crc for _, start, n, crc in got)
    for a, b in ((0, 1), (499, 502), (at - 3, at + 10), (5, 5), (at, at + 1), (at // 3, 2 * at // 3)):
        assert np.array_equal(token_files.read_range(spark, out, a, b), every[a:b])
    assert token_files.read_ids(spark, token_files.write_ids(none, path, 2)).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 32])
def test_packed_ids(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, token_files.BLOCK_IDS, 3 * token_files.BLOCK_IDS + 5):
        ids = rng.integers(0, 2**bits, n, dtype=np.uint32)
        s = token_files.Segment(token_files.write_segment([None, 5], np.array([n // 2, n - n // 2]), ids, bits))
        assert s.doc_ids == [None, 5] and s.doc_end.tolist() == [n // 2, n]
        assert np.array_equal(s.ids(0, n), ids)
        for _ in range(5):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert np.array_equal(s.ids(a, b), ids[a:b])
    with pytest.raises(ValueError):
        token_files.Segment(b"x" * 100)


# Ogg


def test_ogg_column(docs, none):
    out = {(r["doc_id"], r["n_bytes"], bytes(r["payload"])): r for r in ogg.decode_column(ogg.encode_column(docs)).collect()}
    for i, t, _ in plain_rows(docs):
        want = ogg.payload_of(t.encode())
        assert len(want) % 576 == 0 and want
        r = out[i, len(t.encode()), want]
        assert r["payload_bytes"] == len(want) and r["tail_crc32"] == zlib.crc32(want[-32:]) and r["streams"] == 2 and r["seconds"] == len(want) / ogg.RATE
        assert not r["bad_checksums"] and not r["missing_pages"] and not r["broken_packets"]
    assert ogg.decode_column(ogg.encode_column(none)).count() == 0


def test_ogg_checksum_is_the_polynomials():
    def slow(data):
        r = 0
        for x in data:
            r ^= x << 24
            for _ in range(8):
                r = (r << 1 ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
        return r

    for n in (0, 1, 5, 300):
        data = random.Random(n).randbytes(n)
        assert ogg.checksum(data) == slow(data)


def test_ogg_packets_and_damage():
    packets = [b"head", b"a" * 254, b"b" * 255, b"", b"c" * 70_000, b"d" * 65_025, b"e"]
    pages = ogg.pages_of(9, packets, list(range(len(packets))))
    s = ogg.demux(b"".join(pages)).streams[9]
    assert s.packets == packets and s.ended and s.last_granule == 6
    other = ogg.pages_of(8, [b"x", b"y" * 1_000], [0, 1])
    mixed = ogg.demux(b"junk" + pages[0] + other[0] + b"".join(pages[1:]) + b"".join(other[1:]))
    assert mixed.streams[9].packets == packets and mixed.streams[8].packets[1] == b"y" * 1_000 and mixed.skipped_bytes == 4
    lost = ogg.demux(b"".join(pages[:2] + pages[3:])).streams[9]
    assert lost.missing_pages == 1 and lost.broken_packets >= 1 and b"c" * 70_000 not in lost.packets and lost.packets[-1] == b"e"
    broken = bytearray(b"".join(pages))
    broken[len(pages[0]) + 500] ^= 1
    assert ogg.demux(bytes(broken)).bad_checksums == 1
    assert ogg.demux(b"").streams == {} and ogg.demux(b"OggS").skipped_bytes == 4


# URL rules


def plain_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, "allow"))


def test_url_rules(spark):
    rules = [*url_rules.RULES, ("example.com", "/", "allow"), ("example.com", "/en/a", "allow"), ("a.b.example.com", "/", "block"), ("com", "/\x01", "block"), ("com\x01", "/", "block")]
    urls = [None, "", "none", "http://", "x://COM/", "http://com", "http://a.com/", "http://ecom/", "http://m.Example.com/en/x?y", "https://www.example.com/en/", "http://example.com/en/abc#f", "http://x.a.b.example.com/en/ab", "http://net/es/", "ftp://q.net/fr/1", "http://a..com/", "http://example.com/\n/x",
            "http://net/es/\U0010ffffx", "http://net/es/\U0010ffff", "http://a\x01com/", "http://com\x01/", "http://com\x02/", "http://com\x03/\x02/en/", "http://\x01.com/\x01", "http://net\x02/es/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(3, "http://a.com/"), (3, "http://a.com/"), (None, "http://a.com/")] + [(50, "http://hot.example.com/en/1")] * 300
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("key", F.lit(1))
    got = [tuple(r) for r in url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), parts=5).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert by_id(got) == by_id([(i, *plain_verdict(u, rules)) for i, u in rows])
    assert url_rules.judge(pages.where("false"), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert {r["verdict"] for r in url_rules.judge(pages, spark.createDataFrame([], "host string, path string, verdict string")).collect()} == {"allow"}


def test_url_rules_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SMALL}/pages.parquet')")
    result = con.execute(queries.ORACLE_SQL["op3_url_rules"])
    names = [d[0] for d in result.description]
    want = [tuple(dict(zip(names, r, strict=True))[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in result.fetchall()]
    df = queries.op3_url_rules(spark, SMALL)
    assert by_id(tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict").collect()) == by_id(want)
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", df._jdf.queryExecution().toString())


# Mixing


def plain_targets(sizes, share=1.5, most=2.0):
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        rate = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if rate * weights[s] > most * sizes[s]]
        if not full:
            return out | {s: rate * weights[s] for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def test_mixing(docs, none, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_SLOTS", 16)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes = {}
    for _, t, s in plain_rows(docs):
        sizes[s] = sizes.get(s, 0) + count(t)
    got = mixing.mix(docs).collect()
    assert by_id((r["doc_id"], r["size"], r["source"] or "") for r in got) == by_id((i, count(t), s or "") for i, t, s in plain_rows(docs))
    targets, taken = plain_targets(sizes), {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    again = mixing.mix(docs.repartition(7)).collect()
    assert by_id((r["doc_id"], r["size"], r["taken"]) for r in got) == by_id((r["doc_id"], r["size"], r["taken"]) for r in again)
    assert mixing.mix(none).count() == 0 and mixing.mix(docs.where("text = ''")).first()["taken"] == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    odd = docs.withColumns({c: F.lit(1) for c in ("doc", "copies", "text_hash", "__part", "row", "__id", "upto")})
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd).count() == mixed.count() and mixing.mixed(none).count() == 0
    assert abs(sum(count(r["text"] or "") for r in mixed.collect()) / sum(targets.values()) - 1) < 0.25


def test_slots_spread_evenly(spark):
    targets = spark.createDataFrame([("a", 60_000, 1, 60_000.0, 0), ("b", 30_000, 1, 30_000.0, 60_000), (None, 10, 1, 20.0, 90_000)], "source string, source_size long, weight long, target double, before long")
    slots = mixing.schedule(spark, targets, 100).orderBy("slot").collect()
    assert len({s["slot"] for s in slots}) == len(slots) and sum(s["take"] for s in slots) == 90_020
    first = [s["source"] for s in slots[:300]]
    assert abs(first.count("a") - 200) <= 4 and [s["block"] for s in slots if s["source"] == "a"][:5] == [0, 1, 2, 3, 4]


# Licenses


def test_license_base(docs, none):
    for r in licenses.scan(docs.unionByName(extra_licenses(docs))).collect():
        text = TEXTS.get(r["doc_id"])
        if text is None:
            continue
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert licenses.scan(none).count() == 0


TEXTS = {
    -100: "Licensed under CC BY-NC 4.0.\nAll rights\n reserved; ALL RIGHTS RESERVED", -101: "GNU Lesser General Public License v2.1 or any later version", -102: "ccby cc-by accby cc by", -103: "é cc\u00a0by", -104: "", -105: "GENERAL public LICENSE " * 50,
}


def extra_licenses(docs):
    spark = docs.sparkSession
    return spark.createDataFrame([(i, t, None, None, None) for i, t in TEXTS.items()], COLUMNS).withColumns({"score": F.lit(1), "fp": F.lit("x"), "size": F.lit(2), "bucket": F.lit(3), "label": F.lit(4)})


@pytest.mark.parametrize(("text", "labels"), [
    ("Released under the MIT License.", "mit"), ("under the Apache License, Version 2.0", "apache-2.0"), ("CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa-4.0"), ("GNU General Public License, version 3 or any later version", "gpl,gpl-3-or-later"),
    ("GNU Lesser General Public License v2.1 or any later version", "gpl,lgpl-2.1-or-later"), ("permission is hereby granted, free of charge, to any person obtaining a copy", "mit"), ("nothing to see", ""),
])
def test_license_rules(text, labels):
    assert licenses.scan_text(text.encode())[5] == labels


def test_license_priority_and_containment():
    assert len(licenses.scanner().rules) > 200
    R = licenses.Rule
    s = licenses.Scanner([R("long", "a", r"\ba b c\b", 1, 0.5), R("inner", "b", r"\bb\b", 1, 0.5), R("better", "c", r"\bc\b", 0, 0.5), R("same", "a", r"\ba b c\b", 1, 0.5), R("over", "c", r"\bc d\b", 1, 0.5)])
    assert [s.rules[i].label for _, _, i in s.detections("a b c d")] == ["long", "better", "over"] or [s.rules[i].label for _, _, i in s.detections("a b c d")] == ["long", "over", "better"]


# Decontamination


def plain_score(item, text):
    row, best = [0] * (len(text) + 1), 0
    for w in item:
        new = [0]
        for j, x in enumerate(text):
            new.append(max(0, row[j] + (1 if w == x else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment():
    rng = np.random.default_rng(1)
    for _ in range(150):
        a, b = (rng.integers(0, 4, n) for n in (rng.integers(1, 12), rng.integers(1, 30)))
        score, first, last = decontam.align(a, b)
        assert score == plain_score(a.tolist(), b.tolist())
        assert not score or plain_score(a.tolist(), b[first : last + 1].tolist()) == score


def test_contamination_finds_all_edited_copies(spark, none):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(120)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((2, 4, 9, 20, 45))))) for k in range(25)] + [(90, ""), (91, None), (None, "one two three four five")]
    texts = []
    for _, t in items * 3:
        words = (t or "").split()
        for _ in range(rng.randint(0, max(1, len(words) // 3))):
            if words:
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
        texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) + ". " + ", ".join(words).upper() + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))))
    rows = [(i, t) for i, t in enumerate([*texts, "", None])] + [(0, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(5))
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    norm = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    want = [(d, i) for d, t in rows for i, x in items if norm(x) and plain_score(norm(x), norm(t)) >= 0.6 * len(norm(x)) - 1e-9]
    got = [(r["doc_id"], r["item_id"]) for r in decontam.contamination(docs, benchmark).collect()]
    assert by_id(got) == by_id(want) and len(want) > 30
    kept = decontam.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert decontam.contamination(none, benchmark).count() == 0 and decontam.contamination(docs, benchmark.where("false")).count() == 0


# Classifiers


def random_examples(rng, v, n):
    terms = [np.sort(rng.choice(v, rng.integers(0, 8), replace=False)) for _ in range(n)]
    return examples.Examples(np.arange(n) + 10, rng.integers(0, 2, n), terms, [rng.integers(1, 4, len(t)) for t in terms])


def plain_cosines(e, idf):
    x = np.zeros((len(e.labels), len(idf)))
    for k, (t, c) in enumerate(zip(e.terms, e.times, strict=True)):
        x[k, t] = (1 + np.log(c)) * idf[t]
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    return x @ x.T


def plain_vote(similarity, labels, weights, prior):
    """K nearest one by one; examples as near as the last share its place. Equal vectors stand together, others of one similarity by chance."""
    w = np.where(labels == 1, *weights[::-1]) * similarity**toxicity.POWER
    base = 0.1**toxicity.POWER
    return ((w * labels).sum() + base * prior) / (w.sum() + base)


def test_index_gives_exact_neighbours_and_votes():
    rng = np.random.default_rng(2)
    v, n = 60, 500
    e = random_examples(rng, v, n)
    idf = rng.uniform(1, 4, v)
    index = toxicity.Index.build(np.arange(v, dtype=np.uint64), idf, e, (2.0, 1.0))
    cosine = plain_cosines(e, idf)
    dense = index._dense(e.terms, [toxicity.unit(t, c, idf) for t, c in zip(e.terms, e.times, strict=True)])
    who, similarity = index.nearest(dense)
    assert len(index.posted) > 5
    for k in range(n):
        distinct = {(tuple(t), tuple(c)): cosine[k, i] for i, (t, c) in enumerate(zip(e.terms, e.times, strict=True))}
        want = sorted((x for x in distinct.values() if x > 1e-12), reverse=True)[: toxicity.K]
        assert np.allclose(similarity[k][who[k] >= 0], want, atol=1e-5) and (who[k] >= 0).sum() == len(want)
        near = np.argsort(-cosine[k], kind="stable")
        near = near[cosine[k, near] > 1e-12]
        cut = cosine[k, near[toxicity.K - 1]] if len(near) >= toxicity.K else 0
        if len(near) < toxicity.K or (len(near) > toxicity.K and cosine[k, near[toxicity.K]] < cut - 1e-6):  # no tie at the last place
            near = near[: toxicity.K]
            voted = index.vote(similarity[k : k + 1], *(index.counts[who[k : k + 1], c] * (who[k : k + 1] >= 0) for c in (0, 1)))
            assert abs(voted[0] - plain_vote(cosine[k, near], e.labels[near], (2.0, 1.0), index.prior)) < 1e-4
    left_out, labels, _ = index._left_out(e, [np.flatnonzero([t.tolist() == e.terms[i].tolist() and c.tolist() == e.times[i].tolist() for t, c in zip(e.terms, e.times, strict=True)]).tolist() for i in index.names - 10], [toxicity.unit(e.terms[i], e.times[i], idf) for i in index.names - 10], np.ones(n))
    for k in range(0, n, 7):
        others = np.where(np.arange(n) == k, -1, cosine[k])
        near = np.argsort(-others, kind="stable")[: toxicity.K + 1]
        if len(e.terms[k]) and others[near[-1]] < others[near[-2]] - 1e-6:
            near = near[:-1][others[near[:-1]] > 1e-12]
            assert abs(left_out[k] - plain_vote(others[near], labels[near], (2.0, 1.0), index.prior)) < 1e-4


def test_quality_votes_are_those_of_plain_cosines():
    rng = np.random.default_rng(6)
    v, n = 40, 300
    e = random_examples(rng, v, n)
    idf = rng.uniform(1, 3, v)
    space = quality.Space.build(np.arange(v, dtype=np.uint64), idf, e, (1.0, 3.0))
    x = np.zeros((n, v))
    for k, (t, c) in enumerate(zip(e.terms, e.times, strict=True)):
        x[k, t] = np.sqrt(c / max(1, c.sum())) * idf[t]
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    latent = x @ axes[: quality.DIMENSIONS].T
    latent /= np.maximum(np.sqrt((latent * latent).sum(1, keepdims=True)), 1e-300)
    votes = space.votes(space.examples)
    for k in range(n):
        cosine = latent @ latent[k]
        near = np.argsort(-cosine, kind="stable")
        if cosine[near[quality.K]] < cosine[near[quality.K - 1]] - 1e-6:
            near = near[: quality.K]
            w = np.maximum(cosine[near], 0) ** quality.POWER * np.where(e.labels[near] == 1, 3.0, 1.0)
            base = 0.1**quality.POWER
            assert abs(votes[k] - ((w * e.labels[near]).sum() + base * space.prior) / (w.sum() + base)) < 1e-6


def test_document_frequencies_cover_all_documents(spark, docs, none):
    texts = [r["text"] for r in docs.select("text").collect()]
    words = sorted({w for t in texts for w in re.findall("[a-z]+", (t or "").lower())})[:40]
    vocabulary = np.sort(np.array([h for w in words for h in Words(pa.array([w])).hash], np.uint64))
    n, size = examples.document_frequencies(docs.repartition(3), toxicity.terms, vocabulary)
    want = {}
    for t in texts:
        for h in set(toxicity.terms(pa.array([t], pa.string()))[1].tolist()) & set(vocabulary.tolist()):
            want[h] = want.get(h, 0) + 1
    assert size == len(texts) and {h: c for h, c in zip(vocabulary.tolist(), n.tolist(), strict=True) if c} == want
    assert examples.document_frequencies(none, toxicity.terms, vocabulary)[1] == 0


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.7), (quality, "quality", 0.9)])
def test_classifiers_on_held_out_labels(spark, docs, none, module, label, least):
    where = "/root/testdata/sf0.1"
    data, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    model = module.train(data, labels)
    rows = module.scores(data, model).join(labels, "doc_id").where("held_out").select("predicted", label, "score").collect()
    assert len(rows) > 500 and sum(r["predicted"] == r[label] for r in rows) / len(rows) > 0.93
    for value in (0, 1):
        some = [r for r in rows if r[label] == value]
        assert sum(r["predicted"] == value for r in some) / len(some) > least  # some labels of these tables are noise
    odd = module.scores(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["held_out"] for r in odd if r["doc_id"] is None} == {False}
    for r in odd[:50]:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    same = {r["score"] for r in odd if r["doc_id"] in (7, 8)}
    assert len(same) == 1
    assert module.scores(none, model).count() == 0
    if module is toxicity:
        near = toxicity.scores(data, model).join(labels, "doc_id").where("toxic = 1 and size(evidence) > 0").selectExpr("evidence[0] x").select("x.*").collect()
        assert near and all(0 < r["similarity"] <= 1.000001 and 0 <= r["toxic"] <= r["examples"] and r["doc_id"] is not None for r in near)
        clean = toxicity.without_toxic(docs, model)
        assert clean.columns == docs.columns
        assert by_id((r["doc_id"],) for r in clean.collect()) == by_id((r["doc_id"],) for r in odd if not r["predicted"])
        assert toxicity.without_toxic(none, model).count() == 0
    blank = module.train(docs, labels.where("false"))
    assert len({r["score"] for r in module.scores(docs, blank).collect()}) == 1


def test_calibration_is_monotone():
    rng = np.random.default_rng(4)
    votes = rng.random(300)
    fit = examples.Calibration.fit(votes, (rng.random(300) < votes).astype(int), np.ones(300))
    out = fit(np.linspace(0, 1, 101))
    assert (np.diff(out) >= 0).all() and out[0] < 0.3 and out[-1] > 0.7


# Shared


def test_words_and_slices():
    texts = pa.array(["Ab  cd,EF", None, "", " é1 ", "x"])
    w = Words(texts)
    assert np.diff(w.first).tolist() == [3, 0, 0, 1, 1]
    assert w.hash[0] == Words(pa.array(["aB"])).hash[0]
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 600_000] * 4 + [None])], ["text"])
    assert [s.num_rows for s in slices(batch, "text")] == [1, 1, 1, 2]
