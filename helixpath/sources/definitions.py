"""Schema tables: from StructureDefinition bundles, or from the R4 subset of ``r4``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import r4
from .documents import JSON_TEXT, SOURCE_NUMBER

_ELEMENT = """struct<path:string,min:int,max:string,contentReference:string,type:array<struct<code:string,extension:array<struct<url:string,valueString:string,valueUrl:string>>>>,
  constraint:array<struct<key:string,severity:string,human:string,expression:string>>>"""
_BUNDLE = f"struct<entry:array<struct<resource:struct<resourceType:string,name:string,type:string,kind:string,abstract:boolean,derivation:string,snapshot:struct<element:array<{_ELEMENT}>>>>>>"

TYPES = "name string, kind string"
ELEMENTS = "type string, path string, min int, max_many boolean, choice boolean, types array<string>"
CONSTRAINTS = "type string, path string, key string, severity string, human string, expression string"
PATTERNS = "type string, pattern string"


def load(bundles: DataFrame, column: str = "json") -> dict[str, DataFrame]:
    """types, elements, constraints and patterns of the definitions in bundles (one JSON text a row).

    Abstract types, profiles (derivation ``constraint``) and definitions without a snapshot are left out. The root element gives the constraints of
    the type. Elements keep their path below the type, without ``[x]``.
    """
    d = bundles.select(F.explode(F.from_json(column, _BUNDLE)["entry"]["resource"]).alias("d")).select("d.*")
    d = d.where("resourceType = 'StructureDefinition' and not coalesce(abstract, false) and coalesce(derivation, '') <> 'constraint' and snapshot is not null")
    d = d.withColumn("name", F.coalesce("type", "name"))
    e = d.select("name", "kind", F.explode("snapshot.element").alias("e")).select("name", "kind", "e.*")
    below = F.regexp_replace(F.regexp_replace("path", r"^[^.]+\.?", ""), r"\[x\]$", "")
    e = e.withColumns({"choice": F.col("path").endswith("[x]"), "rel": below})
    code = lambda t: F.when(t["code"].startswith("http://hl7.org/fhirpath/System."), F.lower(F.regexp_extract(t["code"], r"([^.]+)$", 1))).otherwise(t["code"])
    types = F.when(F.col("contentReference").isNotNull(), F.array("contentReference")).otherwise(F.coalesce(F.transform("type", code), F.array().cast("array<string>")))
    elements = e.where("rel <> ''").select(F.col("name").alias("type"), F.col("rel").alias("path"), F.coalesce("min", F.lit(0)).alias("min"), (F.col("max") == "*").alias("max_many"), "choice", types.alias("types"))
    constraints = e.select(F.col("name").alias("type"), F.col("rel").alias("path"), F.explode("constraint").alias("c")).select("type", "path", "c.key", "c.severity", "c.human", "c.expression")
    regex = F.filter(F.flatten(F.transform("type", lambda t: t["extension"])), lambda x: x["url"].endswith("/regex"))
    patterns = e.where("kind = 'primitive-type' and rel = 'value'").select(F.col("name").alias("type"), F.get(regex, F.lit(0))["valueString"].alias("pattern")).where("pattern is not null")
    return {"types": d.select("name", "kind").distinct(), "elements": elements, "constraints": constraints.where("expression is not null"), "patterns": patterns}


def bundled(spark: SparkSession) -> dict[str, DataFrame]:
    """The tables of the hand-written R4 subset."""
    types, elements, constraints, patterns = r4.tables()
    make = spark.createDataFrame
    return {"types": make(types, TYPES), "elements": make(elements, ELEMENTS), "constraints": make(constraints, CONSTRAINTS), "patterns": make(patterns, PATTERNS)}


def save(tables: dict[str, DataFrame], path: str) -> None:
    """Each table sorted, so that equal definitions give equal files."""
    order = {"types": ["name"], "elements": ["type", "path"], "constraints": ["type", "path", "key"], "patterns": ["type"]}
    for name, df in tables.items():
        df.coalesce(1).sortWithinPartitions(*order[name]).write.mode("overwrite").parquet(f"{path}/{name}")


def saved(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("types", "elements", "constraints", "patterns")}


#: Spark types of the primitive types that are no text (fixed values).
_NUMBERS = {"boolean": "boolean", "integer": "bigint", "positiveInt": "bigint", "unsignedInt": "bigint"}


def struct_of(tables: dict[str, DataFrame], type_name: str, depth: int = 4) -> T.StructType:
    """The struct that holds documents of a type, from the schema tables: no pass over the documents is needed to read them typed.

    Types contain each other (an extension holds extensions), so the objects below ``depth`` others, and resources within this one, are kept as texts of
    their JSON: nothing of a document is lost, and a path into such a text is an error when it is compiled (``sources.documents.JSON_TEXT``).
    """
    kinds = {r["name"]: r["kind"] for r in tables["types"].collect()}
    below: dict[tuple[str, str], list] = {}
    for r in tables["elements"].collect():
        prefix, _, name = r["path"].rpartition(".")
        below.setdefault((r["type"], prefix), []).append((name, r))

    def children(type_: str, prefix: str, left: int) -> T.StructType | None:
        fields = [T.StructField("resourceType", T.StringType())] if kinds.get(type_) == "resource" and not prefix else []
        for name, r in sorted(below.get((type_, prefix), []), key=lambda x: x[0]):
            for t in r["types"] if r["choice"] else r["types"][:1]:
                inner = one(type_, r["path"], t, left)
                if inner is not None:
                    mark = {SOURCE_NUMBER: True} if t == "decimal" else {JSON_TEXT: True} if isinstance(inner, T.StringType) and kinds.get(t) != "primitive-type" else None
                    fields.append(T.StructField(name + t[0].upper() + t[1:] if r["choice"] else name, T.ArrayType(inner) if r["max_many"] else inner, True, mark))
        return T.StructType(fields) if fields else None

    def one(owner: str, path: str, t: str, left: int) -> T.DataType | None:
        if t.startswith("#"):
            return children(owner, t.partition(".")[2], left - 1) if left else T.StringType()
        if t in ("BackboneElement", "Element"):
            return children(owner, path, left - 1) if left else T.StringType()
        if t == "Resource":
            return T.StringType()
        if kinds.get(t) == "primitive-type":
            return T._parse_datatype_string(_NUMBERS.get(t, "string"))
        return children(t, "", left - 1) if left else T.StringType()

    found = children(type_name, "", depth)
    if found is None:
        raise ValueError(f"no definition of {type_name}")
    return found
