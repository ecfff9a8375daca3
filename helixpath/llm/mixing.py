"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import saved

#: A word: a run of characters that are not ASCII white space (fixed pattern).
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 256
#: The golden ratio's fraction in so many decimal digits: with the digits of a slot's number, their product is an exact 38-digit decimal.
DIGITS = 26
GOLDEN = (math.isqrt(5 * 10 ** (2 * DIGITS)) - 10**DIGITS) // 2
#: Slots are numbered within chunks of so many.
CHUNK_SLOTS = 1 << 16


def running_sums(rows: DataFrame, order: list[str | Column], sums: dict[str, str]) -> DataFrame:
    """``rows`` with, for each name of ``sums``, the sum of that column over all rows before in ``order``.

    Rows are dealt out by ranges of the order and summed within each range; one row for each range gives what lies before it. So no key or
    source is ordered in one task. Written to the shared folder.
    """
    dealt = saved(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy("__part").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", *(F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in sums))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in sums.items())).join(F.broadcast(parts), "__part")
    return dealt.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__part", *(f"__{n}" for n in sums))


def by_source() -> list[str | Column]:
    """By code point, null last."""
    return [F.col("source").isNull(), "source"]


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, weight, target, before) from (source, source_size): one row each; before: the words of the sources before it.

    Sources by code point, null last, take the weights in turn and share ``share`` times all
    words by them; none gets more than ``most`` times its size, and what that leaves is shared
    again. With the sources by size for weight, those up to some point get their most, and the others one
    rate for each unit of weight: the point is the last one at which that rate is still above their own.
    """
    w = running_sums(sizes.withColumn("one", F.lit(1)), by_source(), {"nth": "one", "before": "source_size"})
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("long"))
    w = w.withColumn("ratio", F.col("source_size") / F.col("weight"))
    w = running_sums(w, ["ratio", *by_source()], {"size_before": "source_size", "weight_before": "weight"})
    total, all_weight = w.agg(F.sum("source_size"), F.sum("weight")).first()
    rate = (F.lit((total or 0) * share) - F.col("size_before") * F.lit(most)) / (F.lit(all_weight or 0) - F.col("weight_before"))
    w = w.withColumn("rate", rate).withColumn("full", F.col("source_size") * F.lit(most) <= F.col("rate") * F.col("weight"))
    level = w.where("not full").agg(F.max("rate")).first()[0]
    every = F.col("source_size") * F.lit(most)
    target = every if level is None else F.when(F.col("full"), every).otherwise(F.lit(level) * F.col("weight"))
    return w.select("source", "source_size", "weight", target.cast("double").alias("target"), "before")


def sized(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, text_hash, size): the words of each whole text (null: 0), and a number for each row. Written to the shared folder,
    so texts are read once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64(text).alias("text_hash"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    return saved(rows, "sized")


def _lines(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with ``upto``: how many words stand before each document on the line of all sources, each with its documents shuffled by a hash.

    Only full repetitions of a row are ordered by their numbers, and those are alike.
    """
    rows = rows.withColumn("place", F.xxhash64("doc_id", "text_hash", F.lit(seed)))
    return running_sums(rows, [*by_source(), "place", "doc_id", "text_hash", "row"], {"upto": "size"}).drop("place")


def schedule(spark, targets: DataFrame, block: int) -> DataFrame:
    """(slot, source, pass, block, take): which block of words each slot of the mix takes, and how many words of it.

    Slot i's golden-ratio point falls in one source's part of the unit interval; a source's r-th slot takes its
    block r, around again at the end. A source takes round(target) words: slots past that are left out, and the few that the
    points leave short are put at the end. Sources without words get no slot.
    """
    q = targets.where("source_size > 0").withColumn("words", F.round("target").cast("long"))
    q = q.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(float(block))).cast("long"))
    q = q.withColumn("passes", F.floor(F.col("words") / F.col("source_size")).cast("long"))
    q = q.withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
    q = q.withColumn("quota", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / F.lit(float(block))).cast("long"))
    q = running_sums(q, by_source(), {"low": "quota"}).withColumn("high", F.col("low") + F.col("quota"))
    q = saved(q, "quotas")
    total = q.agg(F.sum("quota")).first()[0] or 0
    # in decimals: a double's fraction of slot * ratio loses a bit with each doubling of the slots
    turns = F.col("slot").cast("decimal(12,0)") * F.lit(str(GOLDEN)).cast(f"decimal({DIGITS},0)")
    point = (turns % F.lit(str(10**DIGITS)).cast(f"decimal({DIGITS + 1},0)")).cast("double") / F.lit(float(10**DIGITS)) * F.lit(float(total))
    # The sources cut [0, total) into whole numbers: each slot meets the source that holds its
    # point by a join on the part of a grid, to which a source belongs wherever it reaches; there are as many parts as sources at least.
    cells = max(4096, 4 * q.count())
    width = F.lit(max(float(total), 1.0) / cells)
    slots = spark.range(total).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("cell", F.floor(F.col("point") / width))
    reach = q.select("source", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))).alias("cell"))
    slots = slots.join(reach, "cell").where("point >= low and point < high").select("slot", "source")
    slots = slots.withColumn("chunk", F.floor(F.col("slot") / CHUNK_SLOTS))
    counts = slots.groupBy("source", "chunk").count()
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    ranked = slots.withColumn("r", rank).join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    ranked = ranked.select("slot", "source", (F.col("base") + F.col("r")).alias("rank"))
    have = counts.groupBy(F.col("source").alias("s")).agg(F.sum("count").alias("have"))
    short = q.join(have, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < quota")
    short = short.select((F.lit(total) + F.col("low")).alias("slot"), "source", F.explode(F.sequence("have", F.col("quota") - 1)).alias("rank"))
    short = short.withColumn("slot", F.col("slot") + F.col("rank"))
    limits = q.select(F.col("source").alias("s"), "source_size", "blocks", "passes", "rest", "quota")
    out = ranked.union(short.select("slot", "source", "rank")).join(limits, F.col("source").eqNullSafe(F.col("s"))).where("rank < quota")
    out = out.withColumn("pass", F.floor(F.col("rank") / F.col("blocks")).cast("long")).withColumn("block", F.col("rank") % F.col("blocks"))
    end = F.when(F.col("pass") < F.col("passes"), F.col("source_size")).otherwise(F.col("rest"))
    take = F.least(F.lit(block), end - F.col("block") * block)
    return out.select("slot", "source", "pass", "block", take.alias("take"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, taken), one row for each row of ``docs``.

    taken: the words that the mix takes of the document, repeats counted; at most ``most`` times its
    size. A null text has no words; null sources are one source, the last; repeated rows are
    documents of their own. Other columns are left out. The rows alone decide the result, so
    reruns agree.
    """
    rows = sized(docs)
    targets = saved(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    t = targets.select(F.col("source").alias("t"), "source_size", "target", "before")
    lines = _lines(rows, seed).join(t, F.col("source").eqNullSafe(F.col("t"))).drop("t")
    rows = saved(lines.withColumn("start", F.col("upto") - F.col("before")).drop("upto", "before"), "lines")
    slots = schedule(docs.sparkSession, targets, block)
    some = rows.where("size > 0").select("row", "source", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    taken = slots.groupBy("source", "block", "take").count().select(F.col("source").alias("s"), F.col("block").alias("b"), "take", "count")
    met = some.join(taken, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    overlap = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("take")) - F.greatest("start", F.col("block") * block)
    met = met.groupBy("row").agg(F.sum(F.greatest(overlap, F.lit(0)) * F.col("count")).alias("taken"))
    out = rows.join(met, "row", "left")
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, with all their columns: each row as many times as the mix takes its words, to the nearest whole
    number (half: up). A document without words costs the mix nothing and stays once. Fully repeated rows share alike. Null ids, sources and
    texts are values like others."""
    taken = mix(docs, **how).groupBy("doc_id", "source", "text_hash").agg(F.sum("taken").alias("t"), F.sum("size").alias("n"))
    copies = F.when(F.col("n") == 0, F.lit(1)).otherwise(F.floor(F.col("t") / F.col("n") + 0.5)).cast("int")
    taken = saved(taken.select("doc_id", "source", "text_hash", copies.alias("copies")), "copies").where("copies > 0").alias("taken")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    text = F.xxhash64(F.coalesce(F.col("doc.text").cast("string"), F.lit("")))
    same = F.col("doc.doc_id").cast("long").eqNullSafe(F.col("taken.doc_id")) & F.col("doc.source").cast("string").eqNullSafe(F.col("taken.source")) & (text == F.col("taken.text_hash"))
    rows = whole.join(taken, same)
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
