"""Documents: JSON texts from files or tables, checked and typed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders that a scan leaves out, and how many files an editor's scan takes at most (the default configuration, fixed values).
IGNORED = (".git", "node_modules", "target", ".tests")
MOST_FILES = 2_000
#: Levels of arrays and objects that a document has at most (fixed value); a deeper one is an error of that document.
DEEPEST = 127
#: Marks, in a field's metadata, texts that are the decimals of a document as they were written.
SOURCE_NUMBER = "source_number"
#: Stands before such a text where a document's parts are of mixed kinds, so that it is told from a text; JSON has no such character. A field's metadata say so.
NUMBER_MARK = "\x03"
MARKED = "marked"
#: Marks texts that are the JSON of an object which is not typed.
JSON_TEXT = "json_text"
_NONCE = "1f0c7be2d1"


def parse_json(text: Column) -> Column:
    """VARIANT of a text that is one JSON value and nothing else; null otherwise.

    Spark's parser stops after the first value, so the text is parsed as the first of two items of an array. Of repeated keys the last counts, which Spark has
    a setting for: it is set here, in the session, so that all that parse agree, in any order of calls.
    """
    _last_key_counts()
    return _only(text, _pair(text))


def _last_key_counts() -> None:
    SparkSession.active().conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def _pair(text: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_NONCE}"]')))


def _only(text: Column, pair: Column) -> Column:
    whole = F.try_variant_get(pair, "$[1]", "string") == _NONCE
    only = F.try_variant_get(pair, "$[2]", "variant").isNull()
    return F.when(whole & only & (F.trim(text) != ""), F.try_variant_get(pair, "$[0]", "variant"))


def is_object(v: Column) -> Column:
    """Whether a VARIANT is an object; null of null. One is a map of its members, whatever they are; its text or its schema would be put together of all its parts, which costs many times as much."""
    return F.when(v.isNotNull(), v.try_cast("map<string,variant>").isNotNull())


def _depth(text: Column) -> Column:
    """How deep arrays and objects nest; 0 where no more than DEEPEST are opened at all."""
    brackets = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    opened = 2 * F.octet_length(text) - F.octet_length(F.replace(text, F.lit("["), F.lit(""))) - F.octet_length(F.replace(text, F.lit("{"), F.lit("")))
    return F.when(opened > DEEPEST, F.aggregate(F.split(brackets, ""), start, step)["most"]).otherwise(0)


def checked(docs: DataFrame) -> DataFrame:
    """``docs`` (path, json, ...) with ``v``, ``resource_type`` and ``doc_error``: null for an object with a text resourceType, no deeper than DEEPEST."""
    _last_key_counts()
    # the pair is a column of its own: within one expression a text would be parsed each time that the pair is named
    out = docs.withColumn("_pair", F.when(_depth(F.col("json")) <= DEEPEST, _pair(F.col("json")))).withColumn("v", _only(F.col("json"), F.col("_pair"))).drop("_pair")
    is_one = F.ltrim(F.col("json"), F.lit(" \t\r\n")).startswith("{")  # what parsed is an object where it begins as one
    name = F.when(F.schema_of_variant(F.try_variant_get("v", "$.resourceType", "variant")) == "STRING", F.try_variant_get("v", "$.resourceType", "string"))
    error = F.when(F.col("v").isNull() & (_depth(F.col("json")) > DEEPEST), "nested too deep").when(F.col("v").isNull(), "not JSON").when(~is_one, "not an object").when(name.isNull(), "no resourceType")
    return out.withColumns({"resource_type": F.when(is_one, name), "doc_error": error})


def within(root: str, ignore: tuple[str, ...]) -> Column:
    """Whether a file's path below ``root`` goes through none of the ignored folders.

    One pattern and no lambda: Spark's driver applies this filter to the listed files, in several threads where a plan reads them more than once, and lambda
    variables are shared between those.
    """
    base = "file:" + root if "://" not in root and root.startswith("/") else root
    start = re.escape(base.rstrip("/")).replace("file:", "file:/*")
    return ~F.col("path").rlike(rf"(?s)^(?:{start})?+(?:.*/)?(?:{'|'.join(map(re.escape, ignore))})(?:/|\z)") if ignore else F.lit(True)


def listed(spark: SparkSession, root: str, ignore: tuple[str, ...] = IGNORED, pattern: str = "*.json") -> DataFrame:
    """(path, modified) of the files below ``root``, which are not read."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).format("binaryFile").load(root)
    return files.select("path", F.col("modificationTime").alias("modified")).where(within(root, ignore))


def read_files(spark: SparkSession, root: str, ignore: tuple[str, ...] = IGNORED, most: int | None = None, since: str | None = None, pattern: str = "*.json") -> tuple[DataFrame, bool]:
    """(path, modified, json) of all files below ``root`` whose names fit ``pattern``, and whether some were left out.

    Files below a folder named in ``ignore`` are left out; of more than ``most`` files the first by path stay (None: all; an editor's scan takes MOST_FILES). ``since``: only
    files changed after that time; ``sources.index`` keeps what was read before.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("json"))
    files = files.where(within(root, ignore))
    if since is not None:
        files = files.where(F.col("modified") > F.lit(since).cast("timestamp"))
    if most is None:
        return files, False
    clipped = files.select("path").limit(most + 1).count() > most
    return (files.orderBy("path").limit(most) if clipped else files), clipped


def skipped(docs: DataFrame) -> DataFrame:
    """One row: how many documents are no resources."""
    return docs.agg(F.count_if(F.col("doc_error").isNotNull()).alias("skipped"), F.count("*").alias("documents"))


def inferred_schema(docs: DataFrame, column: str = "json") -> T.StructType:
    """The schema that holds all documents, from one pass over them. Parts of mixed kinds stay variants, which paths take item by item."""
    return schema_of(docs.select(F.schema_of_variant_agg(parse_json(F.col(column))).alias("s")).first()["s"])


def schema_of(text: str | None) -> T.StructType:
    """The struct that the text of a variant's schema describes; one without fields where that is no object."""
    ddl = text or "OBJECT<>"
    for found, spark_type in (("OBJECT<", "STRUCT<"), ("VOID", "STRING")):  # only where a type stands, not in names
        ddl = re.sub(rf"(^|: |ARRAY<){found}", rf"\1{spark_type}", ddl)
    ddl = re.sub(r"([<,]\s*)([A-Za-z_][\w\-]*)\s*:", r"\1`\2`:", ddl)
    parsed = T._parse_datatype_string(ddl) if ddl.startswith("STRUCT<") and ddl != "STRUCT<>" else T.StructType()
    return _roomy(parsed, {SOURCE_NUMBER: True} | ({MARKED: True} if _mixed(parsed) else {}))


def _roomy(dtype: T.DataType, mark: dict[str, bool]) -> T.DataType:
    """Decimals as their source texts, which keep all digits and zeros."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _roomy(f.dataType, mark), True, mark if _decimals(f.dataType) else None) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_roomy(dtype.elementType, mark))
    return T.StringType() if _decimals(dtype) else dtype


def _mixed(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_mixed(f.dataType) for f in dtype.fields)
    return _mixed(dtype.elementType) if isinstance(dtype, T.ArrayType) else isinstance(dtype, T.VariantType)


def _decimals(dtype: T.DataType) -> bool:
    while isinstance(dtype, T.ArrayType):
        dtype = dtype.elementType
    return isinstance(dtype, T.DecimalType | T.DoubleType)


def as_written(schema: T.StructType) -> bool:
    """Whether documents of this type hold what must be read from their texts: decimals, or parts of mixed kinds."""
    return _mixed(schema) or SOURCE_NUMBER in schema.json()


def typed(docs: DataFrame, schema: T.StructType | str, column: str = "json", output: str = "resource") -> DataFrame:
    """``docs`` with the documents as a struct column, which paths read by fields: columns that no path needs are not parsed."""
    mixed, exact = (isinstance(schema, T.StructType) and told(schema) for told in (_mixed, as_written))
    return docs.withColumn(output, F.from_json(_with_texts(F.col(column), NUMBER_MARK if mixed else "") if exact else F.col(column), schema, {"mode": "PERMISSIVE", "allowUnquotedControlChars": "true"}))


def _with_texts(text: Column, mark: str = "") -> Column:
    """JSON whose numbers with a fraction or an exponent are texts, ``mark`` before each: the parser would read them as doubles.

    Between quotes stand, by turns, what is outside and inside of texts, once escaped quotes are out of the way: two control characters, which JSON
    has not, stand for them meanwhile.
    """
    slash, quote = "\x01", "\x02"
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit(slash)), F.lit('\\"'), F.lit(quote))
    number = r"(-?[0-9]+(?:\.[0-9]+(?:[eE][+-]?[0-9]+)?|[eE][+-]?[0-9]+))"
    parts = F.transform(F.split(plain, '"', -1), lambda x, i: F.when(i % 2 == 0, F.regexp_replace(x, number, f'"{mark}$1"')).otherwise(x))
    joined = F.array_join(parts, '"')
    return F.when(text.rlike(f"[{slash}{quote}]"), text).otherwise(F.replace(F.replace(joined, F.lit(quote), F.lit('\\"')), F.lit(slash), F.lit("\\\\")))
