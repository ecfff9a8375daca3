"""Near copies by the Jaccard similarity of word runs: SimHash links and MinHash bands give candidates, exact similarities decide.

Two texts are linked where their sets of runs of WORDS words have a Jaccard similarity of LEAST or more; classes are what links connect.
Fingerprints of such pairs differ in 4 to 14 of 64 bits, and a trie's self-join that far would open nearly all pairs. So its links of up to 3 bits are
joined by those of MinHash bands: a pair at 0.8 exactly shares no band with a probability of (1 - 0.8^ROWS)^BANDS, about 3 in a
million. No candidate is dropped by its band's size, and no pair is linked unless its exact similarity says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .scratch import saved
from .simhash import fingerprint_links, fingerprints, text_hash
from .textscan import Words, gram_hash, mix, ranges, slices

WORDS = 5
LEAST = 0.8
BANDS = 24
ROWS = 4
#: Candidates that are compared with each other in one task. Of more, each block is compared with the first one, and then those outside
#: the group's largest class with all others, a pair of blocks in a task.
BLOCK = 1_024
#: Links that one task holds before it reduces them to a spanning forest.
HELD = 1_000_000

_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``words`` words (lower-cased, between white space), and where those of each text start.

    A shorter text is one run of all its words; texts without words share one, so that they are copies of each other.
    """
    w = Words(pc.utf8_lower(pc.fill_null(texts, "")), "space")
    found, at = w.grams(words)
    hashes, docs = [found], [w.doc[at]]
    count = np.diff(w.first)
    for n in range(words):
        short = np.flatnonzero(count == n)
        hashes.append(gram_hash([w.hash[w.first[short] + k] for k in range(n)]) if n else np.zeros(len(short), np.uint64))
        docs.append(short)
    doc = np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    return np.concatenate(hashes)[order], np.searchsorted(doc[order], np.arange(len(texts) + 1))


def band_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row for each text and a column for each band: hashes of ROWS minima each."""
    keys = np.empty((len(first) - 1, BANDS), np.uint64)
    for b in range(BANDS):
        least = []
        for k in range(b * ROWS, (b + 1) * ROWS):
            least.append(np.minimum.reduceat((hashes ^ _SEEDS[2 * k]) * (_SEEDS[2 * k + 1] | np.uint64(1)), first[:-1]))
        keys[:, b] = gram_hash([np.full(len(first) - 1, b, np.uint64), *least])
    return keys


def exact_links(hashes: np.ndarray, first: np.ndarray, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Edges between texts, by index, that connect exactly what pairs of a similarity of ``least`` or more connect."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    names, which = np.unique(hashes, return_inverse=True)
    posting = np.unique(which * n + doc)
    which, doc = posting // n, posting % n
    begin = np.searchsorted(which, np.arange(len(names) + 1))
    size = np.bincount(doc, minlength=n)
    own = which[np.argsort(doc, kind="stable")]
    ends = np.cumsum(size)
    src = dst = np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    for d in range(n - 1):
        mine = own[ends[d] - size[d] : ends[d]]
        both = np.bincount(doc[ranges(begin[mine], begin[mine + 1] - begin[mine])], minlength=n)
        other = d + 1 + np.flatnonzero((both >= least * (size + size[d] - both) - 1e-9)[d + 1 :])
        if len(other):
            held.append((np.full(len(other), d), other))
            count += len(other)
        if held and (count > HELD or d == n - 2):
            src, dst = forest(np.concatenate([src, *(x for x, _ in held)]), np.concatenate([dst, *(x for _, x in held)]))
            held, count = [], 0
    if held:
        src, dst = forest(np.concatenate([src, *(x for x, _ in held)]), np.concatenate([dst, *(x for _, x in held)]))
    return src, dst


def copy_links(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(src, dst): edges between the text hashes of ``docs`` that connect exactly the candidates of a similarity of ``least`` or more."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keys = band_keys(*shingles(part.column("text"))).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("text_hash"), lists], ["text_hash", "keys"])

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        names = group.column("text_hash").to_numpy()
        src, dst = exact_links(*shingles(group.column("text").combine_chunks()), least)
        return pa.table({"src": names[src], "dst": names[dst]})

    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), text_hash().alias("text_hash"))
    once = texts.mapInArrow(scan, "text_hash long, keys array<long>").dropDuplicates(["text_hash"])
    bands = saved(once, "bands").select("text_hash", F.explode("keys").alias("key"))
    shared = saved(bands.groupBy("key").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high")).where("low < high").select("key", "low"), "shared")
    near = bands.join(shared, "key").where("text_hash <> low").select(F.col("text_hash").alias("src"), F.col("low").alias("dst"))
    groups = saved(components(near.union(fingerprint_copies(docs)).distinct()), "candidates")
    members = saved(_first_texts(docs, groups), "members")
    compared = lambda dealt: dealt.join(members, "text_hash").select("root", "a", "b", "text_hash", "text").groupBy("root", "a", "b").applyInArrow(compare, "src long, dst long")
    large = groups.join(groups.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "root")
    if large.isEmpty():
        return compared(_with_others(groups.withColumn("main", F.lit(False))))
    links = saved(compared(_with_first_block(large)), "links")
    return links.union(compared(_with_others(_main_classes(groups, large, links))))


def _first_texts(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(text_hash, text) once for each node of ``groups``: the text of the smallest doc_id that has it. Rows are joined by text and doc_id, so that a text
    which a third of all rows hold is no hot key."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), text_hash().alias("text_hash"))
    first = rows.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id")).join(groups.select(F.col("node").alias("text_hash")), "text_hash", "left_semi")
    this = (F.col("r.text_hash") == F.col("f.text_hash")) & F.col("r.doc_id").eqNullSafe(F.col("f.doc_id"))
    return rows.alias("r").join(first.alias("f"), this, "left_semi").select("text_hash", "text").dropDuplicates(["text_hash"])


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(1)), blocks).cast("int")


def _with_first_block(large: DataFrame) -> DataFrame:
    """(root, a, b, text_hash): each block of a large group of candidates, with the group's first one."""
    rows = large.withColumn("b", _block(F.col("blocks")))
    others = F.when(F.col("b") == 0, F.sequence(F.lit(1), F.col("blocks") - 1)).otherwise(F.array("b"))
    return rows.select("root", F.lit(0).alias("a"), F.explode(others).alias("b"), F.col("node").alias("text_hash"))


def _main_classes(groups: DataFrame, large: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root, main): main for what is in its large group's largest class by ``links``."""
    classes = large.join(components(links).select("node", F.col("root").alias("class")), "node", "left").select("node", "root", F.coalesce("class", "node").alias("class"))
    most = classes.groupBy("root", "class").count().groupBy("root").agg(F.max_by("class", F.struct("count", "class")).alias("class"))
    main = classes.join(most, ["root", "class"], "left_semi").select("node", F.lit(True).alias("main"))
    return saved(groups.join(main, "node", "left").select("node", "root", F.coalesce("main", F.lit(False)).alias("main")), "classes")


def _with_others(rows: DataFrame) -> DataFrame:
    """(root, a, b, text_hash): pairs of blocks whose texts may still need a link. What is main in its group meets only the rest of it; the rest meets all."""
    number = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = rows.groupBy("root").agg(number(F.count_if(~F.col("main"))).alias("rest"), number(F.count_if("main")).alias("same")).where("rest > 0")
    rows = rows.join(sizes, "root")
    met = F.sequence(F.lit(0), F.col("rest") - 1 + F.when(F.col("main"), 0).otherwise(F.col("same")))
    block = F.when(F.col("main"), F.col("rest") + _block(F.greatest("same", F.lit(1)))).otherwise(_block(F.col("rest")))
    rows = rows.select("root", "node", block.alias("block"), F.explode(met).alias("other"))
    return rows.select("root", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), F.col("node").alias("text_hash"))


def fingerprint_copies(docs: DataFrame) -> DataFrame:
    """(src, dst): edges between text hashes that connect the texts whose SimHash fingerprints are linked."""
    texts = saved(fingerprints(docs, WORDS).select("fp", "text_hash").distinct(), "fingerprints")
    first = saved(texts.groupBy("fp").agg(F.min("text_hash").alias("first")), "firsts")
    same = texts.join(first, "fp").where("text_hash <> first").select(F.col("text_hash").alias("src"), F.col("first").alias("dst"))
    links = fingerprint_links(first.select("fp"))
    for end in ("src", "dst"):
        links = links.join(first.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_text")), end)
    return same.union(links.select("src_text", "dst_text"))


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` with one row of each class of near copies: that of the smallest doc_id.

    Of several rows with this doc_id, one stays: that of the least text hash, and of full repetitions the least by the JSON of
    all columns. Null doc_ids come last. Null and blank texts are one class.
    """
    linked = components(copy_links(docs, least)).select(F.col("node").alias("text_hash"), "root")
    same = docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash")).groupBy("doc_id", "text_hash").count()
    # the first row of each text before that of its class: a text which a third of all rows hold is one row when it is joined
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "text_hash", "count"))
    first = same.groupBy("text_hash").agg(least_row.alias("x")).join(linked, "text_hash", "left")
    best = first.groupBy(F.coalesce("root", "text_hash").alias("class")).agg(F.min("x").alias("x"))
    best = saved(best.select("x.doc_id", "x.text_hash", "x.count"), "kept").alias("best")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    hashed = F.xxhash64(F.coalesce(F.col("doc.text").cast("string"), F.lit("")))
    this = F.col("doc.doc_id").cast("long").eqNullSafe(F.col("best.doc_id")) & (hashed == F.col("best.text_hash"))
    once = whole.join(best.where("count = 1"), this, "left_semi")
    often = whole.join(best.where("count > 1"), this, "left_semi")
    often = often.groupBy("doc.doc_id", hashed.alias("text_hash")).agg(F.min_by("doc", F.to_json("doc")).alias("doc")).select("doc")
    return once.union(often).select("doc.*")
