"""How filters interact: joint failures of all subsets of five filters, and by inclusion and exclusion everything that any order of them removes.

One row of counts for each part holds, for each of the 32 subsets, how many documents fail all of its filters, as sums of products of flags. Möbius
inversion of these counts gives the survivors of any set of filters, and with them what each step of each order removes; the Harsanyi dividends of
"removed by a set" are the same counts with alternating signs, and shared out equally they are the Shapley values.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import saved

FILTERS = "ABCDE"
_SETS = range(1 << len(FILTERS))
_SPACE = " \t\n\x0b\f\r"


def _bits(s: int) -> list[int]:
    return [i for i in range(len(FILTERS)) if s >> i & 1]


def text_flags(text: Column) -> dict[str, Column]:
    """The failures of filters A to D, which a text alone decides."""
    plain = F.btrim(text, F.lit(_SPACE))
    words = F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, r"[\x20\x09-\x0D]+"))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 100,
        "B": 100 * distinct.cast("long") < 80 * n.cast("long"),
        "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, good, toxic, A, B, C, D, E), one row for each row of ``docs``: what fails which filter.

    A null text is empty, a null lang the part ''. E: another row of a smaller doc_id, anywhere in the table, has the same text (known by its SHA-256); a null
    doc_id is neither smaller nor greater than another, so rows without one never fail E and make none fail it. Rows of one doc_id do not make each other fail.
    Of several labels of a doc_id any 1 counts; documents without one are neither good nor toxic. Other columns are not read. Written to the shared folder.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(f.alias(name) for name, f in text_flags(F.col("text")).items()))
    rows = saved(rows, "flags")
    named = rows.where("doc_id is not null")
    # of the copies of a text one is the first, so the join's keys are as distinct as the documents, whatever the number of copies
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    out = named.join(firsts, ["digest", "doc_id"], "left").join(known, "doc_id", "left").select("doc_id", "part", yes("good"), yes("toxic"), *"ABCD", F.col("first").isNull().alias("E"))
    no = F.lit(False)
    return out.union(rows.where("doc_id is null").select("doc_id", "part", no.alias("good"), no.alias("toxic"), *"ABCD", no.alias("E")))


def joint_failures(found: DataFrame) -> DataFrame:
    """(part, docs, good, toxic): of all documents, the good and the toxic ones, how many fail all filters of each of the 32 subsets, the filter of FILTERS[i] being bit i."""
    ones = found.select("part", *(F.col(c).cast("int").alias(c) for c in ("good", "toxic", *FILTERS)))
    product = lambda s, w: reduce(lambda a, b: a * b, [F.col(FILTERS[i]) for i in _bits(s)], w)
    sums = {name: [F.sum(product(s, w)) for s in _SETS] for name, w in (("docs", F.lit(1)), ("good", F.col("good")), ("toxic", F.col("toxic")))}
    return ones.groupBy("part").agg(*(F.array(*x).alias(name) for name, x in sums.items()))


def _over_subsets(joint: str, weight: Callable[[Column, Column], Column]) -> Column:
    """For each set r the sum of the counts of all sets t, times their weights for r."""
    sets, zero = F.lit(list(_SETS)), F.lit(0).cast("long")
    term = lambda r, t: F.get(F.col(joint), t) * weight(r, t) * F.when(F.bit_count(t) % 2 == 0, 1).otherwise(-1)
    return F.transform(sets, lambda r: F.aggregate(sets, zero, lambda total, t: (total + term(r, t)).cast("long")))


def _survivors(joint: str) -> Column:
    """How many fail none of each set's filters: inclusion and exclusion over its subsets."""
    return _over_subsets(joint, lambda r, t: (t.bitwiseAND(r) == t).cast("int"))


def _shapley() -> Column:
    """For each set of one filter that filter's share of all removals, summed over all orders: each set's dividend in equal parts among its filters."""
    return _over_subsets("docs", lambda r, t: F.when(t.bitwiseAND(r) == r, (F.lit(-factorial(len(FILTERS))) / F.nullif(F.bit_count(t), F.lit(0))).cast("int")).otherwise(0))


def audit(joint: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, all exact.

    An empty table has no parts and gives no rows. The input has a row for each part, so what is done here does not grow with the documents.
    """
    every = (1 << len(FILTERS)) - 1
    steps = [("".join(o), k + 1, 1 << FILTERS.index(o[k]), sum(1 << FILTERS.index(x) for x in o[:k])) for o in permutations(FILTERS) for k in range(len(FILTERS))]
    parts = joint.select("part", F.col("docs"), _shapley().alias("shapley"), *(_survivors(c).alias(f"{c}_left") for c in ("docs", "good", "toxic")))
    grid = F.explode(F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "own", "before"), x, strict=True)) for x in steps])), "array<struct<filter_order: string, step: int, own: int, before: int>>"))
    at = lambda c, i: F.get(F.col(c), i)
    rows = parts.select("*", grid.alias("x")).select("*", "x.*", (F.col("x.before") + F.col("x.own")).alias("after"))
    lost = lambda c: at(f"{c}_left", F.col("before")) - at(f"{c}_left", F.col("after"))
    return rows.select(
        "part", "filter_order", "step", at("docs_left", F.col("after")).alias("kept"), lost("docs").alias("removed"), (at("docs", F.col("own")) - lost("docs")).alias("redundant"),
        (at("docs_left", F.lit(every) - F.col("own")) - at("docs_left", F.lit(every))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), at("shapley", F.col("own")).alias("shapley"),
    )
