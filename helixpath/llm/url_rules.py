"""URL rules by a sorted sweep over reversed-host keys, with DataFrame functions only.

A rule (host, path) holds for its host and all subdomains where the url's path starts with the rule's. Its key is
the host's labels in reverse order, each ended by a character below all others, then a mark and the path;
everything with that prefix lies in one interval of the sorted keys, as a mark within labels and paths is escaped. A url is a point for each of its
host's suffixes: the suffix's key with the url's path. Prefix intervals are nested or apart, so
while points and interval borders pass in order, the active rules form a stack; a border carries the stack's top
after it (the rule itself where it begins, the rule around it where it ends) and each point takes the last border's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import saved

#: Ends a label in a key; ends the host; stands before one of these marks that is a character itself; follows every key that starts with a rule's.
LABEL, HOST, ESCAPE, AFTER = "\x01", "\x02", "\x03", "\U0010ffff"

#: The rules of the registered query (fixed values): host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased. Path: from there up to ``?``,
    ``#`` or the end. Both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _escaped(x: Column) -> Column:
    return F.regexp_replace(x, f"[{LABEL}{HOST}{ESCAPE}{AFTER}]", f"{ESCAPE}$0")


def _key(labels: Column, path: Column) -> Column:
    """``labels``: those of a host, last first."""
    return F.concat(F.concat_ws("", F.transform(labels, lambda x: F.concat(x, F.lit(LABEL)))), F.lit(HOST), path)


def _labels(host: Column) -> Column:
    return F.reverse(F.split(_escaped(host), r"\."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A table of (host, path, verdict) from a list, as literals."""
    rows = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(r, ("host", "path", "verdict"), strict=True))) for r in rules))
    return spark.range(1).select(F.inline(rows))


def rule_intervals(rules: DataFrame) -> DataFrame:
    """(low, high, rule, verdict, length, outer): the interval of each rule and the rule next around it.

    Of rules with the same host and path the least verdict holds. Rules with a null are left out. What lies around a rule
    is the longest of the other rules' keys that start its own: its key's prefixes are joined to the keys.
    """
    r = rules.where("host is not null and path is not null and verdict is not null")
    r = r.withColumn("host", F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    r = r.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    r = r.withColumn("key", _key(_labels(F.col("host")), _escaped(F.col("path"))))
    r = r.select("key", F.struct(F.length(F.concat("host", "path")).alias("length"), F.concat("host", "path").alias("rule"), "verdict").alias("top"))
    inner = r.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key") - 1), lambda n: F.substring("key", F.lit(1), n))).alias("prefix"))
    around = inner.join(r.select(F.col("key").alias("prefix"), F.col("top").alias("around")), "prefix")
    around = around.groupBy("key").agg(F.max_by("around", F.length("prefix")).alias("outer"))
    return r.join(around, "key", "left").select(F.col("key").alias("low"), F.concat("key", F.lit(AFTER)).alias("high"), "top", "outer")


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", parts: int | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict), one row for each row of ``pages`` (page_id, url; others left out).

    The longest of the fitting rules holds (host and path counted in characters); without one, rule is null and the
    verdict ``otherwise``. Null urls have an empty host and path and fit no rule but one of an empty host and path. Repeated rows stay.

    Borders and points are dealt out by ranges of (key, page_id), so that a frequent url or host fills
    as many tasks as it needs; the top left by the parts before comes from one row for each part.
    """
    spark = pages.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).withColumns({"host": host, "path": path})
    labels = _labels(F.col("host"))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: _key(F.slice(labels, F.lit(1), n), _escaped(F.col("path"))))
    points = urls.select("page_id", "url", F.posexplode(suffixes).alias("nth", "key"))
    intervals = rule_intervals(rules)
    none = F.lit(None)
    top_type = "struct<length:int,rule:string,verdict:string>"
    # at equal keys a rule's begin comes before points, and an end stands before no point of its interval
    border = lambda at, kind, top: intervals.select(
        F.col(at).alias("key"), F.lit(kind).alias("kind"), none.cast("long").alias("page_id"), none.cast("string").alias("url"), none.cast("int").alias("nth"), F.struct(F.col(top).cast(top_type).alias("top")).alias("border"))
    events = border("low", 0, "top").union(border("high", 2, "outer")).union(
        points.select("key", F.lit(1), "page_id", "url", "nth", none.cast(f"struct<top:{top_type}>"))
    )
    dealt = events.repartitionByRange(parts, "key", "kind", "page_id", F.xxhash64("url", "nth")).withColumn("part", F.spark_partition_id())
    dealt = saved(dealt, "sweep")
    order = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("last", F.last("border", ignorenulls=True).over(order))
    left = dealt.where("border is not null").groupBy("part").agg(F.max_by("border", F.struct("key", "kind")).alias("border"))
    ids = spark.range(parts).select(F.col("id").cast("int").alias("part"))
    left = ids.join(left, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.select("part", F.last("border", ignorenulls=True).over(before).alias("carried"))
    found = swept.where("kind = 1").join(F.broadcast(carried), "part")
    top = F.coalesce("last", "carried").getField("top")
    best = found.groupBy("page_id", "url").agg(F.max(top).alias("top"), F.count_if(F.col("nth") == 0).alias("copies"))
    rows = best.select("page_id", "url", "top", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return rows.select("page_id", "url", host.alias("host"), path.alias("path"), F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(otherwise)).alias("verdict"))
