"""Registered queries over documents made from the base tables: files, definitions, references, validation and repair, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import library
from ..operators import graph, positions, repair, validate
from ..sources import definitions, index
from ..sources.documents import checked, inferred_schema, read_files, skipped, typed
from ..streaming import documents as streaming
from . import resources as R
from .compiler import evaluate_json, fhirpath
from .shared import deleted_at_end, materialized, new_path, spread
from .syntax import is_expression
from .values import items, scalar


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# Files and streams: a file for each supplier, which Spark's tasks write


_FOLDERS = ("node_modules", "a", "b", "c", "c/d")
#: Files that one task writes of a folder, about.
_FILES_PER_TASK = 250


#: Hadoop's settings for a folder of small files: tasks move their own files into place, where version 1 of the committer leaves that to the driver, one by one; and
#: local files have no second file of checksums.
_SMALL_FILES = {"mapreduce.fileoutputcommitter.algorithm.version": "2", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def _one_each(texts: DataFrame, root: str, rows: int) -> None:
    """Appends a file for each of about ``rows`` rows to a folder. A file costs milliseconds, so tasks grow with the files."""
    dealt = texts.repartition(rows // _FILES_PER_TASK + 1, texts.columns[0])
    dealt.write.mode("append").options(**_SMALL_FILES).option("maxRecordsPerFile", 1).text(root)


def _files(spark: SparkSession, sf_dir: str, folders: tuple[int, ...] = (0, 1, 2, 3, 4), root: str | None = None) -> str:
    """A folder with a file for each supplier: by key, in an ignored folder, without a type, broken, or an Organization."""
    root = root or deleted_at_end(spark, new_path(spark, "files"))
    key, suppliers = F.col("s_suppkey"), _table(spark, sf_dir, "supplier")
    rows = suppliers.count() // len(_FOLDERS)
    for n in folders:
        text = (_text('{"resourceType":"Patient","id":"', key, '"}'), _text('{"title":', key, "}"), _text('{"resourceType":', key), *(_text('{"resourceType":"Organization","id":"', key, '","partOf":{"reference":"Organization/', key - 1, '"}}'),) * 2)[n]
        _one_each(suppliers.where(key % 5 == n).select(text.alias("value")), f"{root}/{_FOLDERS[n]}", rows)
    return root


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.regexp_extract("json", r"([0-9]+)", 1).cast("long").alias("key"), "resource_type", "doc_error")


def fhir_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a folder, what they are, or why they are none."""
    return _numbered(checked(read_files(spark, _files(spark, sf_dir), pattern="*.txt")[0]))


def fhir_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files scans take: all, bounded, changed after a time, and how many documents are no resources."""
    root = _files(spark, sf_dir, (0, 1, 2, 3))
    before = read_files(spark, root, ignore=(), pattern="*.txt")[0].agg(F.max("modified")).first()[0]
    _files(spark, sf_dir, (4,), root)
    files, _ = read_files(spark, root, pattern="*.txt")
    some, clipped = read_files(spark, root, most=7, pattern="*.txt")
    later, _ = read_files(spark, root, since=str(before), pattern="*.txt")
    every, _ = read_files(spark, root, ignore=(), pattern="*.txt")
    counts = [("all", files), ("bounded" if clipped else "not bounded", some), ("later", later), ("without ignored folders", every)]
    rows = [df.agg(F.count("*").alias("files")).select(F.lit(name).alias("scan"), "files") for name, df in counts]
    rows.append(skipped(checked(files)).select(F.lit("skipped").alias("scan"), F.col("skipped").alias("files")))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def fhir_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index after files were added and deleted: what a rescan takes over, reads and removes, and the references it holds then."""
    root = _files(spark, sf_dir, (2, 3))
    first = index.rescan(spark, root, pattern="*.txt")
    _files(spark, sf_dir, (4,), root)  # new files
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{_FOLDERS[2]}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)  # the broken ones go
    more = _table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 3").select(_text('{"resourceType":"Organization","id":"', F.col("s_suppkey"), '","partOf":{"reference":"Organization/none"}}').alias("value"))
    _one_each(more, f"{root}/{_FOLDERS[3]}-new", more.count())  # others of the same resources
    second = index.rescan(spark, root, first, pattern="*.txt")
    refs = second.table(spark, "references").groupBy(F.when(F.col("raw") == "Organization/none", "none").otherwise("other").alias("what")).agg(F.count("*").alias("n"))
    counts = spark.createDataFrame([("kept", second.kept), ("read", second.read), ("removed", second.removed)], "what string, n long")
    return counts.union(refs)


#: The least files of a batch of the stream, and the batches that more files make.
_FILES_PER_BATCH, _BATCHES = 500, 10


def fhir_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same folder as a stream, written as it comes and read back. What a batch costs beside its files, logs of all batches among them, is paid a bounded number of times."""
    out, seen = deleted_at_end(spark, new_path(spark, "streamed")), deleted_at_end(spark, new_path(spark, "stream-state"))
    most = max(_FILES_PER_BATCH, -(-_table(spark, sf_dir, "supplier").count() // _BATCHES))
    rows = _numbered(streaming.read_stream(spark, _files(spark, sf_dir), files_per_batch=most, pattern="*.txt", ignore=()))
    with streaming.listed_in_few_tasks(spark):
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key long, resource_type string, doc_error string").parquet(out)


# Definitions


def _definitions(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """A bundle of definitions: a type for each region, an element for each of its nations. The first is abstract, the second a profile."""
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    types = F.array(F.struct(F.lit("http://hl7.org/fhirpath/System.String").alias("code")), F.struct(F.lit("Quantity").alias("code")))
    element = F.struct(
        F.concat("r_name", F.lit("."), "n_name", F.when(key % 2 == 0, "[x]").otherwise("")).alias("path"), (key % 2).cast("int").alias("min"), F.when(key % 3 == 0, "*").otherwise("1").alias("max"),
        F.when(key % 5 == 4, F.concat(F.lit("#"), "r_name")).alias("contentReference"), types.alias("type"),
        F.when(key % 4 == 0, F.array(F.struct(F.concat(F.lit("n-"), key).alias("key"), F.lit("error").alias("severity"), F.col("n_name").alias("human"), F.lit("a.exists()").alias("expression")))).alias("constraint"),
    )
    regex = F.array(F.struct(F.lit("http://hl7.org/fhir/StructureDefinition/regex").alias("url"), F.concat(F.lit("[a-z]{"), "r_regionkey", F.lit("}")).alias("valueString")))
    value = F.struct(F.concat("r_name", F.lit(".value")).alias("path"), F.array(F.struct(F.lit("string").alias("code"), regex.alias("extension"))).alias("type"))
    elements = F.collect_list(element) if kind == "resource" else F.array(F.first(value))
    d = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(elements.alias("element"))
    d = d.select(F.struct(F.struct(
        F.lit("StructureDefinition").alias("resourceType"), F.col("r_name").alias("name"), F.col("r_name").alias("type"), F.lit(kind).alias("kind"), (F.col("r_regionkey") == 0).alias("abstract"),
        F.when(F.col("r_regionkey") == 1, "constraint").alias("derivation"), F.struct("element").alias("snapshot")).alias("resource")).alias("e"))
    return d.agg(F.to_json(F.struct(F.lit("Bundle").alias("resourceType"), F.collect_list("e").alias("entry"))).alias("json"))


def _reloaded(spark: SparkSession, sf_dir: str, kind: str) -> dict[str, DataFrame]:
    path = deleted_at_end(spark, new_path(spark, "schema"))
    definitions.save(definitions.load(_definitions(spark, sf_dir, kind)), path)
    return definitions.saved(spark, path)


def fhir_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _reloaded(spark, sf_dir, "resource")["elements"]
    return e.select("type", "path", F.col("min").cast("long").alias("min"), "max_many", "choice", F.array_join("types", ",").alias("types"))


def fhir_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reloaded(spark, sf_dir, "resource")["constraints"].select("type", "path", "key", "severity", "human")


def fhir_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reloaded(spark, sf_dir, "primitive-type")["patterns"]


# References


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle for each region: its nations in order, the first once more at the end under the same identity. Each refers by urn, type and id, absolute url, and within itself."""
    n, key = _table(spark, sf_dir, "nation").withColumn("last", F.lit(0)), F.col("n_nationkey")
    first = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("lowest"))
    n = n.join(first, "n_regionkey")
    n = n.union(n.where("n_nationkey = lowest").withColumn("last", F.lit(1)))
    ref = lambda *parts: F.struct(_text(*parts).alias("reference"))
    organization = F.struct(
        F.lit("Organization").alias("resourceType"), key.cast("string").alias("id"), F.col("n_name").alias("name"), ref("urn:uuid:n", F.col("lowest")).alias("partOf"),
        F.array(ref("#e0"), ref("Organization/", (key + 7) % 25), ref("http://x.example/fhir/Organization/", key + 1)).alias("endpoint"), F.array(F.struct(F.lit("Endpoint").alias("resourceType"), _text("e", key % 3).alias("id"))).alias("contained"),
    )
    entry = F.struct(F.col("last"), key, F.struct(_text("urn:uuid:n", key).alias("fullUrl"), organization.alias("resource")).alias("e"))
    entries = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"])
    b = n.groupBy("n_regionkey").agg(entries.alias("entry"))
    b = b.select(_text("R", F.col("n_regionkey")).alias("path"), F.to_json(F.struct(F.lit("Bundle").alias("resourceType"), _text("b", F.col("n_regionkey")).alias("id"), F.lit("collection").alias("type"), "entry")).alias("json"))
    return materialized(checked(b).select("path", "v", "resource_type", "doc_error"), "bundles")


def fhir_resolve_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each kind of reference leads: the own bundle, another one, a contained resource, or nowhere."""
    docs = _bundles(spark, sf_dir)
    found = graph.resources(docs)
    resolved = graph.resolve(graph.references(found), graph.identities(docs, found), graph.contained(found))
    return resolved.select("path", F.col("owner_path").alias("owner"), F.regexp_replace("element_path", r"^.*\.resource\.", "").alias("place"), "raw", "flavor", "target_path", "target_element", "candidates")


def fhir_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of resources; of one name in a bundle the last resource stays."""
    return graph.identities(_bundles(spark, sf_dir)).select("identity", "path", "element_path")


def fhir_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.contained(graph.resources(_bundles(spark, sf_dir))).select("path", "owner_path", "contained_id", "element_path")


def fhir_usages_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each resource is referred to, from its own bundle and from others."""
    docs = _bundles(spark, sf_dir)
    found = materialized(graph.resources(docs), "found")
    ids = graph.identities(docs, found)
    used = graph.usages(graph.resolve(graph.references(found), ids, graph.contained(found)), found, ids)
    return used.groupBy("target_path", "target_element").agg(F.count_if(F.col("path") == F.col("target_path")).alias("near"), F.count_if(F.col("path") != F.col("target_path")).alias("far"))


def fhir_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to documents of which some are there twice, and some have a copy in another folder: the lowest path wins."""
    key = F.col("n_nationkey")
    n = _table(spark, sf_dir, "nation")
    text = lambda id_, ref: F.to_json(F.struct(F.lit("Organization").alias("resourceType"), id_.cast("string").alias("id"), F.struct(ref.alias("reference")).alias("partOf")))
    docs = n.select(_text("m/", key).alias("path"), text(key, _text("Organization/", (key + 1) % 30)).alias("json"))
    docs = docs.union(n.where(key % 2 == 0).select(_text("b/", key), text(key, F.lit(None).cast("string")))).union(n.where(key % 3 == 0).select(_text("z/", key), text(key, F.lit(None).cast("string"))))
    docs = materialized(checked(docs).select("path", "v", "resource_type", "doc_error"), "documents")
    found = graph.resources(docs)
    resolved = graph.resolve(graph.references(found), graph.identities(docs, found), graph.contained(found))
    return resolved.select("path", "raw", "target_path", "candidates")


def fhir_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in bundles: the deepest part that is there, its value, and the resource that owns it."""
    n = _table(spark, sf_dir, "nation")
    order = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    leaf = F.when(F.col("n_nationkey") % 2 == 0, ".name").otherwise(".telecom[0].value")
    places = n.select(_text("R", F.col("n_regionkey")).alias("path"), _text("Bundle.entry[", order, "].resource", leaf).alias("element_path"), F.col("n_nationkey").alias("key"))
    rows = graph.locate(places, _bundles(spark, sf_dir))
    return rows.select("key", "found_path", "exact", F.try_variant_get("node", F.when(F.col("exact"), "$").otherwise("$.name"), "string").alias("text"), graph.owner_path(F.col("element_path")).alias("owner"))


# Validation and repair

#: Documents by the customer's key, and the issue that each has: element path, category and rule; %s is the key. Without one: null.
_DEFECTS: list[tuple[str, tuple[str, str, str] | None]] = [
    ('{"resourceType":"Spaceship","id":"%s"}', ("Spaceship", "unknown", "unknown_type")),
    ('{"resourceType":"Patient","deceasedBoolean":true,"deceasedDateTime":"2020"}', ("Patient.deceased", "choice", "two_forms")),
    ('{"resourceType":"Observation","code":{"text":"%s"}}', ("Observation.status", "cardinality", "missing")),
    ('{"resourceType":"Patient","birthDate":null}', ("Patient.birthDate", "type", "null")),
    ('{"resourceType":"Questionnaire","status":"draft","item":[{"linkId":"1","type":"group","item":[{"type":"group"}]}]}', ("Questionnaire.item[0].item[0].linkId", "cardinality", "missing")),
    ('{"resourceType":"Patient","contact":["%s"]}', ("Patient.contact[0]", "type", "object")),
    ('{"resourceType":', None),
    ('{"resourceType":"Patient","_birthDate":{},"_shoe":{}}', ("Patient._shoe", "unknown", "unknown")),
    ('{"resourceType":"Patient","multipleBirthInteger":2,"deceasedDateTime":"2020-02"}', None),
    ('{"resourceType":"Observation","status":"final","code":{"text":"x"},"valueQuantity":{"value":1.50,"code":"mg"}}', ("Observation.valueQuantity", "invariant", "invariant")),
    ('{"resourceType":"Bundle","type":"batch","entry":[{"resource":{"id":"%s"}}]}', ("Bundle.entry[0].resource", "type", "resource")),
    ('{"resourceType":"Patient","name":[]}', ("Patient.name", "cardinality", "empty")),
    ('{"resourceType":"Patient","birthDate":"17 May %s"}', ("Patient.birthDate", "format", "format")),
]


def _by_key(spark: SparkSession, sf_dir: str, texts: list[str]) -> DataFrame:
    key = F.col("c_custkey")
    text = F.element_at(F.array(*map(F.lit, texts)), (key % len(texts) + 1).cast("int"))
    texts = spread(_table(spark, sf_dir, "customer"), "c_custkey").select(key.cast("string").alias("path"), F.replace(text, F.lit("%s"), key.cast("string")).alias("json"))
    return checked(materialized(texts, "texts"))  # written: filters on what is parsed would go below the exchange, back to one task


def fhir_validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error of documents with one defect, or none."""
    found = validate.validate(_by_key(spark, sf_dir, [t for t, _ in _DEFECTS]), definitions.bundled(spark))
    return found.where("severity = 'error'").select("path", "element_path", "category", "rule")


def fhir_clean_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many resources are without an error, beside the failures of each invariant."""
    docs = _by_key(spark, sf_dir, [t for t, _ in _DEFECTS])
    issues = materialized(validate.validate(docs, definitions.bundled(spark)), "issues")
    rate = validate.clean_rate(docs, issues).select(F.lit("clean").alias("what"), F.col("clean").alias("n"), F.col("resources").alias("documents"))
    counts = validate.invariant_counts(issues).where("severity = 'error'").select("key", "issues", "documents")
    return rate.union(counts)


#: What marks the place of each of these defects in its text, the first of it; None: the document itself, where an element is missing or none of its own.
_MARKS = [None, None, None, '"birthDate"', '{"type":"group"}', '"%s"', None, '"_shoe"', None, '"valueQuantity"', '"resource"', '"name"', '"birthDate"']


def _in_lines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(',"'), F.lit(',\n  "')), F.lit("[{"), F.lit("[\n{"))


def fhir_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors of documents with one defect and several lines, with their ranges in the texts, as a list of findings that was written and read back."""
    docs = checked(_by_key(spark, sf_dir, [t for t, _ in _DEFECTS]).select("path", _in_lines(F.col("json")).alias("json")))
    folder = deleted_at_end(spark, new_path(spark, "findings"))
    positions.save_findings(validate.validate(docs, definitions.bundled(spark)), docs, folder)
    return positions.findings(spark, folder).select("filename", "lnum", "col", "end_lnum", "end_col", "type", "element_path", "rule")


def fhir_owner_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in bundles of each customer's orders, an entry in a line: the entry that holds the point, or none."""
    o = _table(spark, sf_dir, "orders")
    line = _text('{"resource":{"resourceType":"Basic","id":"', F.col("o_orderkey"), '","status":"', F.col("o_orderstatus"), '"}}')
    lines = F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line"))))["line"]  # without lambdas, which take several times as long
    docs = o.groupBy("o_custkey").agg(_text('{"resourceType":"Bundle","entry":[\n', F.array_join(lines, ",\n"), "\n]}").alias("json"))
    docs = docs.select(F.col("o_custkey").cast("string").alias("path"), "json")
    row = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    points = o.select(F.col("o_custkey").cast("string").alias("path"), row.alias("row"), (F.col("o_orderkey") % 70).cast("long").alias("col"), F.col("o_orderkey").alias("key"))
    return positions.owner_at(points, checked(docs)).select("key", "row", "col", "element_path", "resource_type", "id")


#: Documents and what repairs make of them; %s is the key. White space goes only where something is repaired.
_REPAIRS = [
    ('{"resourceType":"Patient","shoe":1.50,"id":"%s"}', '{"resourceType":"Patient","id":"%s"}'),
    ('{"resourceType": "Observation", "code":{"text":"x"},"valueQuantity":{"value":0.10}}', '{"resourceType":"Observation","code":{"text":"x"},"valueQuantity":{"value":0.10},"status":""}'),
    ('{"resourceType":"Patient","name":{"family":"F%s"}}', '{"resourceType":"Patient","name":[{"family":"F%s"}]}'),
    ('{"resourceType":"Patient","gender":["male"],"id":"%s"}', '{"resourceType":"Patient","gender":"male","id":"%s"}'),
    ('{"resourceType":"Patient","photo":[],"id":"%s"}', '{"resourceType":"Patient","id":"%s"}'),
    ('{"resourceType":"Patient","deceased":true,"id":"%s"}', '{"resourceType":"Patient","deceasedBoolean":true,"id":"%s"}'),
    ('{ "resourceType": "Patient", "multipleBirthInteger": 2, "id": "%s" }', '{ "resourceType": "Patient", "multipleBirthInteger": 2, "id": "%s" }'),
]


def fhir_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _by_key(spark, sf_dir, [t for t, _ in _REPAIRS])
    issues = validate.validate(docs, definitions.bundled(spark), invariants=False)
    return repair.repair(docs, issues).select("path", "repaired")


# Texts, errors and functions


def fhir_decimal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals of documents keep the digits they were written with."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), _text('{"resourceType":"Basic","amount":', F.col("c_acctbal").cast("decimal(18,2)"), ',"note":"1.0, \\"2.50\\""}').alias("json"))
    return evaluate_json(c, "amount").select("key", "result")


def fhir_parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a table's texts are expressions."""

    def valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([is_expression(t) for t in batch.column("text").to_pylist()], pa.bool_())], ["key", "valid"])

    name = F.translate("c_name", "#", "")
    forms = [_text(name, ".count()"), _text(name, "..x"), _text("(", name), _text(name, " and"), _text(name, "[0].x = 1 'mg'")]
    texts = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.get(F.array(*forms), (F.col("c_custkey") % 5).cast("int")).alias("text"))
    return texts.mapInArrow(valid, "key long, valid boolean")


def fhir_mixed_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part that is a number, a text, an object or a list by its document: each document gives what it gives alone."""
    k, total = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    values = [k.cast("string"), _text('"', F.col("o_orderpriority"), '"'), total.cast("string"), _text('{"value":', total, ',"code":"USD"}'), _text("[", k, ',"', F.col("o_orderstatus"), '"]')]
    orders = _table(spark, sf_dir, "orders").select(k.alias("key"), _text('{"resourceType":"Basic","total":', F.get(F.array(*values), (k % 5).cast("int")), "}").alias("json"))
    out = typed(orders, inferred_schema(orders)).select("key", "resource")
    for name, path in (("whole", "total"), ("sum", "total.ofType(integer).first() + 1"), ("price", "total.value"), ("texts", "total.where($this is string).count()"), ("more", "total.first() > 5")):
        out = fhirpath(out, "resource", path, output=name, errors=f"{name}_error", render=True)
    return out.select("key", "whole", "sum", "price", "texts", "more", "more_error")


def fhir_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function added to the library, for this query."""
    library.register("initials", 0, lambda compiler, c, args, focus: scalar(F.array_join(F.transform(items(c), lambda x: F.substring(x, 1, 1)), ""), "String", c.error))
    try:
        return fhirpath(R.patients(spark, sf_dir), "resource", "name.given.initials()", errors=None).select("key", "result")
    finally:
        library.unregister("initials", 0)


def _with_error(make: Callable, path: str, kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fhirpath(make(spark, sf_dir), "resource", path).select("key", F.col("result").cast(kind).alias("result"), "error")

    return run


def _cases(column: str, pairs: list[str | None], n: int) -> str:
    value = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return f"CASE c_custkey % {n} " + " ".join(f"WHEN {k} THEN {value(x)}" for k, x in enumerate(pairs)) + f" END AS {column}"


def _issue_sql() -> str:
    parts = [_cases(name, [d and d[k] for _, d in _DEFECTS], len(_DEFECTS)) for k, name in enumerate(("element_path", "category", "rule"))]
    return f"SELECT * FROM (SELECT CAST(c_custkey AS VARCHAR) AS path, {', '.join(parts)} FROM customer) WHERE rule IS NOT NULL"


def _findings_sql() -> str:
    """Start and end of a mark are the lengths of what stands before them; its line and column follow from the ends of lines in that."""
    texts = _cases("t", [x for x, _ in _DEFECTS], len(_DEFECTS))
    parts = [_cases(name, [d and d[k] for _, d in _DEFECTS], len(_DEFECTS)) for k, name in ((0, "element_path"), (2, "rule"))]
    lined = lambda x: f"replace(replace(replace({x}, '%s', CAST(c_custkey AS VARCHAR)), ',\"', ',' || chr(10) || '  \"'), '[{{', '[' || chr(10) || '{{')"
    line = lambda x: f"1 + length({x}) - length(replace({x}, chr(10), ''))"
    column = lambda x: f"CASE WHEN strpos({x}, chr(10)) = 0 THEN length({x}) + 1 ELSE strpos(reverse({x}), chr(10)) END"
    return f"""WITH d AS (SELECT CAST(c_custkey AS VARCHAR) AS filename, {texts}, {_cases("m", _MARKS, len(_MARKS))}, {", ".join(parts)}, c_custkey FROM customer),
      e AS (SELECT filename, element_path, rule, {lined("t")} AS t, {lined("m")} AS m FROM d WHERE rule IS NOT NULL),
      f AS (SELECT *, CASE WHEN m IS NULL THEN '' ELSE substr(t, 1, strpos(t, m) - 1) END AS a, CASE WHEN m IS NULL THEN t ELSE substr(t, 1, strpos(t, m) - 1 + length(m)) END AS b FROM e)
      SELECT filename, {line("a")} AS lnum, {column("a")} AS col, {line("b")} AS end_lnum, {column("b")} AS end_col, 'E' AS type, element_path, rule FROM f"""


def _repair_sql() -> str:
    return f"SELECT path, replace(t, '%s', path) AS repaired FROM (SELECT CAST(c_custkey AS VARCHAR) AS path, {_cases('t', [x for _, x in _REPAIRS], len(_REPAIRS))} FROM customer)"


#: The entries of the bundles: position p of nation k in region g; the first nation stands at the end once more.
_ENTRIES = """WITH n AS (SELECT n_nationkey AS k, n_regionkey AS g, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS p, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS low, count(*) OVER (PARTITION BY n_regionkey) AS m FROM nation),
  entry AS (SELECT k, g, name, p, low FROM n UNION ALL SELECT k, g, name, m, low FROM n WHERE k = low),
  named AS (SELECT k, g, max(p) AS p FROM entry GROUP BY k, g)"""
_RESOLVED = _ENTRIES + """,
  refs AS (SELECT k, g, p, 'partOf.reference' AS place, 'urn:uuid:n' || low AS raw, 'urn-uuid' AS flavor, low AS t FROM entry
    UNION ALL SELECT k, g, p, 'endpoint[1].reference', 'Organization/' || ((k + 7) % 25), 'relative', (k + 7) % 25 FROM entry
    UNION ALL SELECT k, g, p, 'endpoint[2].reference', 'http://x.example/fhir/Organization/' || (k + 1), 'absolute', k + 1 FROM entry),
  found AS (SELECT 'R' || r.g AS path, 'Bundle.entry[' || r.p || '].resource' AS owner, place, raw, flavor, 'R' || t.g AS target_path, 'Bundle.entry[' || t.p || '].resource' AS target_element, CAST(t.k IS NOT NULL AS BIGINT) AS candidates FROM refs r LEFT JOIN named t ON t.k = r.t
    UNION ALL SELECT 'R' || g, 'Bundle.entry[' || p || '].resource', 'endpoint[0].reference', '#e0', 'contained', CASE WHEN k % 3 = 0 THEN 'R' || g END, CASE WHEN k % 3 = 0 THEN 'Bundle.entry[' || p || '].resource.contained[0]' END, CAST(k % 3 = 0 AS BIGINT) FROM entry)"""
_FILE = "SELECT s_suppkey AS key, CASE WHEN s_suppkey % 5 = {0} THEN 'Patient' WHEN s_suppkey % 5 >= 3 THEN 'Organization' END AS resource_type, CASE s_suppkey % 5 WHEN 1 THEN 'no resourceType' WHEN 2 THEN 'not JSON' END AS doc_error FROM supplier"
_BALANCE = "CAST(c_acctbal AS DECIMAL(18,2))"

SCENARIOS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "fhir_files": (fhir_files, _FILE.format(-1) + " WHERE s_suppkey % 5 <> 0"),
    "fhir_scan": (fhir_scan, "SELECT 'all' AS scan, count(*) AS files FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT 'bounded', 7 UNION ALL SELECT 'later', count(*) FROM supplier WHERE s_suppkey % 5 = 4 UNION ALL SELECT 'without ignored folders', count(*) FROM supplier UNION ALL SELECT 'skipped', count(*) FROM supplier WHERE s_suppkey % 5 IN (1, 2)"),
    "fhir_rescan": (fhir_rescan, "SELECT 'kept' AS what, count(*) AS n FROM supplier WHERE s_suppkey % 5 = 3 UNION ALL SELECT 'read', count(*) FROM supplier WHERE s_suppkey % 5 >= 3 UNION ALL SELECT 'removed', count(*) FROM supplier WHERE s_suppkey % 5 = 2 UNION ALL SELECT 'none', count(*) FROM supplier WHERE s_suppkey % 5 = 3 UNION ALL SELECT 'other', count(*) FROM supplier WHERE s_suppkey % 5 >= 3"),
    "fhir_stream": (fhir_stream, _FILE.format(0)),
    "fhir_definitions": (fhir_definitions, "SELECT r_name AS type, n_name AS path, CAST(n_nationkey % 2 AS BIGINT) AS min, n_nationkey % 3 = 0 AS max_many, n_nationkey % 2 = 0 AS choice, CASE WHEN n_nationkey % 5 = 4 THEN '#' || r_name ELSE 'string,Quantity' END AS types FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey > 1"),
    "fhir_constraints": (fhir_constraints, "SELECT r_name AS type, n_name AS path, 'n-' || n_nationkey AS key, 'error' AS severity, n_name AS human FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey > 1 AND n_nationkey % 4 = 0"),
    "fhir_patterns": (fhir_patterns, "SELECT r_name AS type, '[a-z]{' || r_regionkey || '}' AS pattern FROM region WHERE r_regionkey > 1"),
    "fhir_resolve_local": (fhir_resolve_local, _RESOLVED + " SELECT * FROM found"),
    "fhir_identities": (fhir_identities, _ENTRIES + " SELECT 'Organization/' || k AS identity, 'R' || g AS path, 'Bundle.entry[' || p || '].resource' AS element_path FROM named UNION ALL SELECT 'urn:uuid:n' || k, 'R' || g, 'Bundle.entry[' || p || '].resource' FROM named UNION ALL SELECT 'Bundle/b' || r_regionkey, 'R' || r_regionkey, 'Bundle' FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)"),
    "fhir_contained": (fhir_contained, _ENTRIES + " SELECT 'R' || g AS path, 'Bundle.entry[' || p || '].resource' AS owner_path, 'e' || (k % 3) AS contained_id, 'Bundle.entry[' || p || '].resource.contained[0]' AS element_path FROM entry"),
    "fhir_usages_local": (fhir_usages_local, _RESOLVED + " SELECT target_path, target_element, count(*) FILTER (path = target_path) AS near, count(*) FILTER (path <> target_path) AS far FROM found WHERE flavor <> 'contained' AND target_path IS NOT NULL AND (path = target_path OR flavor <> 'absolute') GROUP BY target_path, target_element"),
    "fhir_ambiguous": (fhir_ambiguous, "SELECT 'm/' || n_nationkey AS path, 'Organization/' || t AS raw, CASE WHEN t > 24 THEN NULL WHEN t % 2 = 0 THEN 'b/' || t ELSE 'm/' || t END AS target_path, CASE WHEN t > 24 THEN 0 ELSE 1 + CAST(t % 2 = 0 AS BIGINT) + CAST(t % 3 = 0 AS BIGINT) END AS candidates FROM (SELECT n_nationkey, (n_nationkey + 1) % 30 AS t FROM nation)"),
    "fhir_locate": (fhir_locate, _ENTRIES + " SELECT k AS key, 'Bundle.entry[' || p || '].resource' || CASE WHEN k % 2 = 0 THEN '.name' ELSE '' END AS found_path, k % 2 = 0 AS exact, name AS text, 'Bundle.entry[' || p || '].resource' AS owner FROM n"),
    "fhir_validate_rules": (fhir_validate_rules, _issue_sql()),
    "fhir_findings": (fhir_findings, _findings_sql()),
    "fhir_owner_at": (fhir_owner_at, """WITH o AS (SELECT o_orderkey AS key, CAST(o_custkey AS VARCHAR) AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row, o_orderkey % 70 AS col, 57 + length(CAST(o_orderkey AS VARCHAR)) AS stop FROM orders),
      h AS (SELECT *, col >= 12 AND col < stop AS held FROM o)
      SELECT key, row, col, CASE WHEN held THEN 'Bundle.entry[' || (row - 1) || '].resource' END AS element_path, CASE WHEN held THEN 'Basic' END AS resource_type, CASE WHEN held THEN CAST(key AS VARCHAR) END AS id FROM h"""),
    "fhir_clean_rate": (fhir_clean_rate, "SELECT 'clean' AS what, count(*) FILTER (c_custkey % 13 = 8) AS n, count(*) AS documents FROM customer WHERE c_custkey % 13 <> 6 UNION ALL SELECT 'qty-3', count(*), count(*) FROM customer WHERE c_custkey % 13 = 9 HAVING count(*) > 0"),
    "fhir_repair": (fhir_repair, _repair_sql()),
    "fhir_decimal_text": (fhir_decimal_text, f"SELECT c_custkey AS key, '[' || CAST({_BALANCE} AS VARCHAR) || ']' AS result FROM customer"),
    "fhir_parse_errors": (fhir_parse_errors, "SELECT c_custkey AS key, c_custkey % 5 IN (0, 4) AS valid FROM customer"),
    "fhir_mixed_kinds": (fhir_mixed_kinds, """WITH o AS (SELECT o_orderkey AS key, o_orderkey % 5 AS k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total, '"' || o_orderpriority || '"' AS priority, '"' || o_orderstatus || '"' AS status FROM orders)
      SELECT key, '[' || CASE k WHEN 0 THEN CAST(key AS VARCHAR) WHEN 1 THEN priority WHEN 2 THEN total WHEN 3 THEN '{"code":"USD","value":' || total || '}' ELSE key || ',' || status END || ']' AS whole,
             CASE WHEN k IN (0, 4) THEN '[' || (key + 1) || ']' ELSE '[]' END AS sum, CASE WHEN k = 3 THEN '[' || total || ']' ELSE '[]' END AS price, CASE WHEN k IN (1, 4) THEN '[1]' ELSE '[0]' END AS texts,
             CASE WHEN k IN (0, 4) THEN CASE WHEN key > 5 THEN '[true]' ELSE '[false]' END WHEN k = 2 THEN CASE WHEN CAST(total AS DECIMAL(18,2)) > 5 THEN '[true]' ELSE '[false]' END END AS more, k IN (1, 3) AS more_error FROM o"""),
    "fhir_registered": (fhir_registered, "SELECT c_custkey AS key, 'A' || substr(c_mktsegment, 1, 1) AS result FROM customer"),
    "fhir_singleton": (_with_error(R.patients, "name.given.where($this = 'A' or $this = 'BUILDING').single().lower()", "string"), "SELECT c_custkey AS key, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'a' END AS result, c_mktsegment = 'BUILDING' AS error FROM customer"),
    "fhir_singleton_text": (_with_error(R.patients, "name.given.where($this = 'A' or $this = 'BUILDING').length()", "bigint"), "SELECT c_custkey AS key, CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(1 AS BIGINT) END AS result, c_mktsegment = 'BUILDING' AS error FROM customer"),
    "fhir_boolean_rule": (_with_error(R.patients, "active and name.given.where($this = 'BUILDING')", "boolean"), "SELECT c_custkey AS key, CASE WHEN c_mktsegment <> 'BUILDING' AND c_acctbal <= 0 THEN false END AS result, c_mktsegment = 'BUILDING' AS error FROM customer"),
    "fhir_bad_pattern": (_with_error(R.communications, "payload.content.first().matches(iif(id.toInteger() mod 2 = 0, '[', '[0-9]{3}'))", "boolean"), "SELECT doc_id AS key, CASE WHEN doc_id % 2 = 1 THEN regexp_matches(text, '[0-9]{3}') END AS result, doc_id % 2 = 0 AND text IS NOT NULL AS error FROM documents"),
    "fhir_overflow": (_with_error(R.patients, "iif(active, 99999999999999999999.5, 2.5) * iif(active, 99999999999999999999.5, 2.5)", "decimal(18,2)"), "SELECT c_custkey AS key, CASE WHEN c_acctbal <= 0 THEN CAST(6.25 AS DECIMAL(18,2)) END AS result, c_acctbal > 0 AS error FROM customer"),
}
