"""Validation of documents against schema tables, as a DataFrame of issues.

Objects are walked level by level, with one write of each level's values, from which its issues and the next level are made. What a type's part of the schema says of its children (their names and typed forms, what must
be there) is one row for each (type, prefix), and goes to every task: the schema does not grow with the documents, and its size is checked. So a
level is one pass without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compiler import Compiler, boolean, with_steps
from ..plans.shared import materialized
from ..plans.syntax import PathError, parse
from ..plans.values import of_column
from ..sources.documents import schema_of
from .graph import Targets, owner_path

ISSUES = "path string, element_path string, severity string, category string, message string, rule string, hint string"
#: Each rule's category and message; {0} and {1} are what the rule fills in. Repairs go by the rule.
RULES = {
    "unknown_type": ("unknown", 'unknown resource type "{0}"'),
    "missing": ("cardinality", 'required element "{0}" is missing'),
    "two_forms": ("choice", 'only one form of "{0}" is allowed (found {1})'),
    "unknown": ("unknown", '"{0}" is not an element of {1}'),
    "bare_choice": ("choice", '"{0}" takes a typed form (e.g. "{1}")'),
    "no_array": ("cardinality", "did not expect an array (the element does not repeat)"),
    "empty": ("cardinality", "arrays must not be empty"),
    "array": ("cardinality", "expected an array (the element repeats)"),
    "null": ("type", "null is not allowed here"),
    "object": ("type", "expected an object"),
    "resource": ("type", "expected a resource (resourceType is missing)"),
    "boolean": ("type", "expected true or false"),
    "integer": ("type", "expected an integer"),
    "positive": ("type", "expected a positive integer"),
    "not_negative": ("type", "expected a non-negative integer"),
    "number": ("type", "expected a number"),
    "string": ("type", "expected a string"),
    "format": ("format", "does not match the {0} format"),
}
#: Rows of the elements table that are sent to every task at most; all of R4 has under 10,000.
MOST_ELEMENTS = 100_000


def _specification(tables: dict[str, DataFrame]) -> DataFrame:
    """One row for each (type, prefix): ``fields`` by key, ``required`` elements and ``choices``, each with the keys that stand for them."""
    elements = tables["elements"]
    if elements.count() > MOST_ELEMENTS:
        raise ValueError(f"more than {MOST_ELEMENTS} schema elements")
    e = elements.withColumns({"prefix": F.regexp_replace("path", r"\.?[^.]+$", ""), "name": F.regexp_extract("path", r"([^.]+)$", 1)})
    form = lambda t: F.concat("name", F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))
    field = lambda key, type_, bare: F.struct(key.alias("key"), F.struct("path", type_.alias("type"), "max_many", F.lit(bare).alias("bare"), form(F.coalesce(F.get("types", F.lit(0)), F.lit(""))).alias("hint")).alias("value"))
    plain = F.array(field(F.col("name"), F.get("types", F.lit(0)), False))
    typed = F.concat(F.array(field(F.col("name"), F.lit(None).cast("string"), True)), F.transform("types", lambda t: field(form(t), t, False)))
    keys = F.when(F.col("choice"), F.concat(F.array("name"), F.transform("types", form))).otherwise(F.array("name"))
    e = e.select("type", "prefix", "name", "min", "choice", keys.alias("keys"), F.when(F.col("choice"), typed).otherwise(plain).alias("entries"))
    out = e.groupBy("type", "prefix").agg(
        F.flatten(F.collect_list("entries")).alias("entries"),
        F.collect_list(F.when(F.col("min") > 0, F.struct("name", "keys"))).alias("required"),
        F.collect_list(F.when(F.col("choice"), F.struct("name", F.slice("keys", F.lit(2), F.size("keys")).alias("keys")))).alias("choices"),
    )
    # of equal keys the first by path counts, as a plain element does before another's typed form
    entries = F.array_distinct(F.transform("entries", lambda x: x["key"]))
    fields = F.transform(entries, lambda k: F.struct(k.alias("key"), F.get(F.filter("entries", lambda x: x["key"] == k), F.lit(0))["value"].alias("value")))
    return out.select("type", "prefix", F.map_from_entries(fields).alias("fields"), "required", "choices")


def _worded(found: DataFrame) -> DataFrame:
    """ISSUES of (path, element_path, rule, first, second): what is found is carried as its rule, and worded once, here."""
    pick = lambda k: F.element_at(F.create_map(*(F.lit(x) for name, r in RULES.items() for x in (name, r[k]))), F.col("rule"))
    message = F.replace(F.replace(pick(1), F.lit("{1}"), F.coalesce("second", F.lit(""))), F.lit("{0}"), F.coalesce("first", F.lit("")))
    return found.select("path", "element_path", F.lit("error").alias("severity"), pick(0).alias("category"), message.alias("message"), "rule", F.when(F.col("rule") == "bare_choice", F.col("second")).alias("hint"))


def _kind(v: Column) -> Column:
    s = F.schema_of_variant(v)
    return F.when(v.isNull(), "VOID").when(s.startswith("OBJECT"), "OBJECT").when(s.startswith("ARRAY"), "ARRAY").otherwise(F.regexp_replace(s, r"\(.*$", ""))


def validate(docs: DataFrame, tables: dict[str, DataFrame], invariants: bool = True, targets: Targets | None = None) -> DataFrame:
    """ISSUES of the documents that ``sources.documents.checked`` gives; those with a doc_error have none.

    Structural rules are errors; invariants bring their own severity. An expression that can't be evaluated, or is not false, gives no issue. ``targets``: where
    resolve() in an invariant finds what references name; without it, it finds nothing.
    """
    spec = materialized(_specification(tables), "specification")
    kinds = tables["types"].select(F.col("name").alias("t_name"), F.col("kind").alias("t_kind"))
    patterns = tables["patterns"].select(F.col("type").alias("p_name"), "pattern")
    primitive = kinds.join(patterns, F.col("t_name") == F.col("p_name"), "left").drop("p_name")
    # parsed once: the issues of the first level, its values and what invariants see are made from it
    docs = materialized(docs.where("doc_error is null").select("path", "resource_type", "v"), "parsed")
    nodes = docs.select("path", F.col("resource_type").alias("element_path"), F.col("resource_type").alias("type"), F.lit("").alias("prefix"), "v", F.lit(True).alias("named"))
    issues, walked = [], []
    while True:  # ends with the deepest document, which is no deeper than documents.DEEPEST
        level = nodes.join(F.broadcast(kinds), F.col("type") == F.col("t_name"), "left").drop("t_name")
        issues.append(level.where("named and t_kind is null").select("path", "element_path", F.lit("unknown_type").alias("rule"), F.col("type").alias("first"), F.lit(None).cast("string").alias("second")))
        objects = level.where("t_kind is not null").drop("t_kind", "named")
        walked.append(objects)
        values, found = _children(objects, spec)
        values = materialized(values, "values")
        issues += [found, values.where("rule is not null").select("path", "element_path", "rule", "first", "second")]
        if values.where("type is not null").isEmpty():
            break
        nodes, found = _descend(values.where("type is not null"), primitive)
        issues.append(found)
    out = _worded(reduce(DataFrame.unionByName, issues))
    if invariants and walked:
        for part in _invariants(reduce(DataFrame.unionByName, walked), tables["constraints"], targets):
            out = out.unionByName(part)
    return out


def _children(objects: DataFrame, spec: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The values under known keys, with the issues of their keys and shapes; and the issues of what is missing or doubled."""
    rows = objects.join(F.broadcast(spec), ["type", "prefix"], "left")
    entries = F.map_entries(F.col("v").try_cast("map<string,variant>"))
    rows = rows.withColumn("entries", F.filter(entries, lambda e: ~((F.col("prefix") == "") & (e["key"] == "resourceType"))))
    keys = F.transform("entries", lambda e: F.regexp_replace(e["key"], "^_", ""))
    real = F.filter(F.transform("entries", lambda e: e["key"]), lambda k: ~k.startswith("_"))
    rows = rows.withColumns({"keys": keys, "real": real})
    missing = F.transform(
        F.filter(F.coalesce("required", F.array()), lambda r: ~F.arrays_overlap(r["keys"], F.col("keys"))),
        lambda r: F.struct(F.concat("element_path", F.lit("."), r["name"]).alias("element_path"), F.lit("missing").alias("rule"), r["name"].alias("first"), F.lit(None).cast("string").alias("second")),
    )
    doubled = F.transform(
        F.filter(F.transform(F.coalesce("choices", F.array()), lambda c: F.struct(c["name"].alias("name"), F.array_sort(F.array_intersect(c["keys"], F.col("real"))).alias("keys"))), lambda c: F.size(c["keys"]) > 1),
        lambda c: F.struct(F.concat("element_path", F.lit("."), c["name"]).alias("element_path"), F.lit("two_forms").alias("rule"), c["name"].alias("first"), F.array_join(c["keys"], ", ").alias("second")),
    )
    found = rows.select("path", F.explode(F.concat(missing, doubled)).alias("x")).select("path", "x.*")
    each = rows.select("path", "element_path", "type", "prefix", "fields", F.explode("entries").alias("e"))
    base = F.regexp_replace("e.key", "^_", "")
    each = each.withColumns({"key": F.col("e.key"), "value": F.col("e.value"), "field": F.try_element_at("fields", base)})
    scope = F.when(F.col("prefix") == "", F.col("type")).otherwise(F.concat("type", F.lit("."), "prefix"))
    kind = _kind(F.col("value"))
    companion = F.col("key").startswith("_")
    empty = F.size(F.col("value").try_cast("array<variant>")) == 0
    rule = (
        F.when(F.col("field").isNull(), "unknown").when(companion, None).when(F.col("field.bare"), "bare_choice")
        .when((kind == "ARRAY") & ~F.col("field.max_many"), "no_array").when((kind == "ARRAY") & empty, "empty").when((kind != "ARRAY") & F.col("field.max_many"), "array")
    )
    walk = F.col("field").isNotNull() & ~companion & ~F.col("field.bare")
    values = each.select(
        "path", F.concat("element_path", F.lit("."), "key").alias("element_path"), F.col("type").alias("owner"), F.col("field.path").alias("rel"),
        F.when(walk, F.col("field.type")).alias("type"), F.col("value").alias("v"), rule.alias("rule"),
        F.col("key").alias("first"), F.coalesce("field.hint", scope).alias("second"),
    )
    return values, found


def _descend(values: DataFrame, primitive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The objects of the next level, and the issues of single values."""
    many = F.col("v").try_cast("array<variant>")
    one = F.array(F.struct(F.lit(None).cast("int").alias("n"), F.col("v").alias("v")))
    parts = F.when(_kind(F.col("v")) == "ARRAY", F.transform(many, lambda x, n: F.struct(n.alias("n"), x.alias("v")))).otherwise(one)
    each = values.select("path", "element_path", "owner", "rel", "type", F.explode(parts).alias("x"))
    at = F.when(F.col("x.n").isNull(), F.col("element_path")).otherwise(F.concat("element_path", F.lit("["), F.col("x.n"), F.lit("]")))
    each = each.select("path", at.alias("element_path"), "owner", "rel", "type", F.col("x.v").alias("v"), _kind(F.col("x.v")).alias("shape"))
    each = each.join(F.broadcast(primitive), F.col("type") == F.col("t_name"), "left")
    text, number = F.col("v").try_cast("string"), F.col("v").try_cast("bigint")
    again, backbone, nested = F.col("type").startswith("#"), F.col("type").isin("BackboneElement", "Element"), F.col("type") == "Resource"
    plain = F.coalesce(F.col("t_kind") == "primitive-type", F.lit(False))
    inner = F.when(F.schema_of_variant(F.try_variant_get("v", "$.resourceType", "variant")) == "STRING", F.try_variant_get("v", "$.resourceType", "string"))
    is_object = F.col("shape") == "OBJECT"
    known = again | backbone | nested | F.col("t_kind").isNotNull()
    integer = F.col("type").isin("integer", "positiveInt", "unsignedInt")
    numbers = F.col("shape").isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    rule = (
        F.when(F.col("shape") == "VOID", "null")
        .when(~known, None)
        .when(~plain & ~is_object, "object")
        .when(nested & inner.isNull(), "resource")
        .when(~plain, None)
        .when(F.col("type") == "boolean", F.when(F.col("shape") != "BOOLEAN", "boolean"))
        .when(integer & (F.col("shape") != "BIGINT"), "integer")
        .when((F.col("type") == "positiveInt") & (number < 1), "positive")
        .when((F.col("type") == "unsignedInt") & (number < 0), "not_negative")
        .when(integer, None)
        .when(F.col("type") == "decimal", F.when(~numbers, "number"))
        .when(F.col("shape") != "STRING", "string")
        .when(F.col("pattern").isNotNull() & ~F.regexp_like(text, F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")$"))), "format")
    )
    found = each.select("path", "element_path", rule.alias("rule"), F.col("type").alias("first"), F.lit(None).cast("string").alias("second")).where("rule is not null")
    down = each.where(is_object & F.coalesce(known, F.lit(False)) & ~plain & (~nested | inner.isNotNull()))
    target = F.when(again | backbone, F.col("owner")).when(nested, inner).otherwise(F.col("type"))
    prefix = F.when(again, F.regexp_replace("type", r"^#[^.]*\.?", "")).when(backbone, F.col("rel")).otherwise("")
    return down.select("path", "element_path", target.alias("type"), prefix.alias("prefix"), "v", nested.alias("named")), found


def _invariants(walked: DataFrame, constraints: DataFrame, targets: Targets | None) -> list[DataFrame]:
    """Issues of the constraints declared on (type, prefix), for objects walked as that. Objects of such places are written once, in a folder for each
    place; each is typed by what its objects hold, and all its expressions are evaluated in one pass over that folder."""
    places: dict[tuple[str, str], list] = {}
    for r in constraints.collect():  # a part of the schema, of a checked size
        places.setdefault((r["type"], r["path"]), []).append(r)
    order = sorted(places)
    number = F.map_from_arrays(F.array(*(F.lit(f"{t} {p}") for t, p in order)), F.array(*(F.lit(k) for k in range(len(order)))))
    some = walked.withColumn("place", F.try_element_at(number, F.concat("type", F.lit(" "), "prefix"))).where("place is not null")
    some = materialized(some.select("path", "element_path", "v", "place"), "places", by="place")
    held = {r["place"]: r["s"] for r in some.groupBy("place").agg(F.schema_of_variant_agg("v").alias("s")).collect()}
    out = []
    for place, (type_, prefix) in enumerate(order):
        if place not in held:
            continue
        schema = schema_of(held[place])
        schema = schema if schema.fields else T.StructType([T.StructField("id", T.StringType())])  # of objects that are all empty
        checks, steps = [], []
        resolver, target = targets.resolver(owner="owner") if targets else (None, None)
        for r in places[type_, prefix]:
            failed = _fails(F.col("x"), schema, r["expression"], steps, target)
            if failed is not None:
                parts = (("severity", r["severity"]), ("category", "invariant"), ("message", f"{r['key']}: {r['human']}"), ("rule", "invariant"), ("hint", r["key"]))
                checks.append(F.when(failed, F.struct(*(F.lit(x).alias(n) for n, x in parts))))
        if checks:
            typed = some.where(F.col("place") == place).select("path", "element_path", owner_path(F.col("element_path")).alias("owner"), F.from_json(F.to_json("v"), schema).alias("x"))
            typed, _ = with_steps(typed, steps, resolver)
            out.append(typed.select("path", "element_path", F.explode(F.array_compact(F.array(*checks))).alias("i")).select("path", "element_path", "i.*"))
    return out


def _fails(x: Column, schema: T.StructType, expression: str, steps: list, target: T.StructType | None) -> Column | None:
    """True where the expression is a single false, of ``steps`` that it adds. None where it can't be compiled: a gap of the engine must not invent issues."""
    own: list = []
    compiler = Compiler(own, target)
    try:
        value, error = boolean(compiler.bound(compiler.eval(parse(expression), of_column(x, schema))))
    except PathError:
        return None
    steps += own
    return F.coalesce(~value, F.lit(False)) & (F.lit(True) if error is None else ~F.coalesce(error, F.lit(False)))


def summary(issues: DataFrame) -> DataFrame:
    """(severity, category, issues, documents, first): counts, and the first place by path."""
    return issues.groupBy("severity", "category").agg(
        F.count("*").alias("issues"), F.count_distinct("path").alias("documents"), F.min_by("element_path", F.struct("path", "element_path")).alias("first")
    )


def clean_rate(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: resources, those without an error, and their share."""
    bad = issues.where("severity = 'error'").select("path").distinct()
    rows = docs.where("doc_error is null").select("path").join(bad.withColumn("bad", F.lit(True)), "path", "left")
    return rows.agg(F.count("*").alias("resources"), F.count_if(F.col("bad").isNull()).alias("clean")).withColumn("rate", F.col("clean") / F.nullif("resources", F.lit(0)))


def invariant_counts(issues: DataFrame) -> DataFrame:
    """(key, severity, issues, documents, first): how often each invariant failed, and the first place by path."""
    found = issues.where("category = 'invariant'").withColumn("key", F.substring_index("message", ":", 1))
    return found.groupBy("key", "severity").agg(
        F.count("*").alias("issues"), F.count_distinct("path").alias("documents"), F.min_by("element_path", F.struct("path", "element_path")).alias("first")
    )
