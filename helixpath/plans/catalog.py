"""The registered path queries over derived resources, each beside its SQL on the base tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, validate
from ..sources import definitions
from ..sources.documents import checked
from . import resources as R
from .compiler import fhirpath
from .scenarios import SCENARIOS
from .shared import materialized, spread

#: name: (resources, path, SQL type of the result, its SQL). Each query returns (key, result); the SQL does, too.
PATHS: dict[str, tuple[Callable, str, str, str]] = {
    "fhir_path_member": (R.patients, "Patient.name.family.first()", "string", "SELECT c_custkey AS key, c_name AS result FROM customer"),
    "fhir_path_where": (R.patients, "name.where(family.endsWith('7') and use = 'official').family.first()", "string", "SELECT c_custkey AS key, CASE WHEN c_name LIKE '%7' THEN c_name END AS result FROM customer"),
    "fhir_given_family": (R.patients, "name.select(given.skip(1).first() & ' ' & family).join(', ')", "string", "SELECT c_custkey AS key, c_mktsegment || ' ' || c_name AS result FROM customer"),
    "fhir_extension": (R.patients, "extension('http://example.org/balance').value.first()", "decimal(18,2)", "SELECT c_custkey AS key, CAST(c_acctbal AS DECIMAL(18,2)) AS result FROM customer"),
    "fhir_choice_oftype": (R.patients, "extension.value.ofType(string).first()", "string", "SELECT c_custkey AS key, c_mktsegment AS result FROM customer"),
    "fhir_logic": (R.patients, "(active and name.exists()) xor (id.toInteger() mod 2 = 0)", "boolean", "SELECT c_custkey AS key, (c_acctbal > 0) <> (c_custkey % 2 = 0) AS result FROM customer"),
    "fhir_implies": (R.patients, "active implies id.toInteger() > 100", "boolean", "SELECT c_custkey AS key, NOT (c_acctbal > 0) OR c_custkey > 100 AS result FROM customer"),
    "fhir_div_mod": (R.patients, "(id.toInteger() div 7) * 1000 + id.toInteger() mod 7", "bigint", "SELECT c_custkey AS key, (c_custkey // 7) * 1000 + c_custkey % 7 AS result FROM customer"),
    "fhir_iif": (R.patients, "iif(active, 'yes', 'no')", "string", "SELECT c_custkey AS key, CASE WHEN c_acctbal > 0 THEN 'yes' ELSE 'no' END AS result FROM customer"),
    "fhir_membership": (R.patients, "'BUILDING' in name.given", "boolean", "SELECT c_custkey AS key, c_mktsegment = 'BUILDING' AS result FROM customer"),
    "fhir_descendants": (R.patients, "descendants().ofType(string).where($this = 'AUTOMOBILE').count()", "bigint", "SELECT c_custkey AS key, CAST(CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 2 ELSE 0 END AS BIGINT) AS result FROM customer"),
    "fhir_string_functions": (R.patients, "name.family.first().lower().replace('customer', 'c').substring(0, 6).length() + id.length()", "bigint", "SELECT c_custkey AS key, CAST(length(substr(replace(lower(c_name), 'customer', 'c'), 1, 6)) + length(CAST(c_custkey AS VARCHAR)) AS BIGINT) AS result FROM customer"),
    "fhir_round": (R.patients, "extension('http://example.org/balance').value.first().round(1)", "decimal(18,1)", "SELECT c_custkey AS key, CAST(round(CAST(c_acctbal AS DECIMAL(18,2)), 1) AS DECIMAL(18,1)) AS result FROM customer"),
    "fhir_where_count": (R.benefits, "item.where(quantity.value > 25).count()", "bigint", "SELECT o_orderkey AS key, count(*) FILTER (l_quantity > 25) AS result FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"),
    "fhir_exists_criteria": (R.benefits, "item.exists(net.value > 50000)", "boolean", "SELECT o_orderkey AS key, coalesce(bool_or(CAST(l_extendedprice AS DECIMAL(18,2)) > 50000), false) AS result FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"),
    "fhir_all_criteria": (R.benefits, "item.all(quantity.value >= 3)", "boolean", "SELECT o_orderkey AS key, coalesce(bool_and(CAST(l_quantity AS DECIMAL(18,2)) >= 3), true) AS result FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"),
    "fhir_distinct": (R.benefits, "item.select(productOrService.text).distinct().count()", "bigint", "SELECT o_orderkey AS key, count(DISTINCT l_partkey) AS result FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"),
    "fhir_union": (R.benefits, "(item.supplier | item.productOrService.text).count()", "bigint", "SELECT o_orderkey AS key, count(DISTINCT x) AS result FROM orders LEFT JOIN (SELECT l_orderkey, l_suppkey AS x FROM lineitem UNION ALL SELECT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey GROUP BY o_orderkey"),
    "fhir_subsetting": (R.benefits, "item.sequence.select($this.toString()).skip(1).take(2).join('-')", "string", "SELECT o_orderkey AS key, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), '-' ORDER BY l_linenumber) FILTER (r BETWEEN 2 AND 3), '') AS result FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem) ON l_orderkey = o_orderkey GROUP BY o_orderkey"),
    "fhir_index": (R.benefits, "item[0].sequence", "bigint", "SELECT o_orderkey AS key, CAST(min(l_linenumber) AS BIGINT) AS result FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"),
    "fhir_last_tail": (R.benefits, "item.tail().count() * 100 + item.sequence.last()", "bigint", "SELECT o_orderkey AS key, CAST((count(*) - 1) * 100 + max(l_linenumber) AS BIGINT) AS result FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
    "fhir_arithmetic": (R.benefits, "item.where(sequence = 1).first().quantity.value * 2 + 1", "decimal(18,2)", "SELECT o_orderkey AS key, CAST(min(CAST(l_quantity AS DECIMAL(18,2))) FILTER (l_linenumber = 1) * 2 + 1 AS DECIMAL(18,2)) AS result FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"),
    "fhir_date_add": (R.benefits, "(item.where(sequence = 1).first().serviced + 1 month).toString()", "string", "SELECT o_orderkey AS key, strftime(CAST(l_shipdate AS DATE) + INTERVAL 1 MONTH, '%Y-%m-%d') AS result FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_extendedprice, l_shipdate) AS r FROM lineitem WHERE l_linenumber = 1) ON l_orderkey = o_orderkey AND r = 1"),
    "fhir_date_compare": (R.benefits, "created < @1995-06-17", "boolean", "SELECT o_orderkey AS key, o_orderdate < TIMESTAMP '1995-06-17' AS result FROM orders"),
    "fhir_choice_quantity": (R.observations, "value.ofType(Quantity).value", "decimal(18,2)", "SELECT event_id AS key, CASE WHEN event_id % 2 = 0 THEN CAST(value AS DECIMAL(18,2)) END AS result FROM events"),
    "fhir_quantity_compare": (R.observations, "value > 50 'u'", "boolean", "SELECT event_id AS key, CASE WHEN event_id % 2 = 0 THEN CAST(value AS DECIMAL(18,2)) > 50 END AS result FROM events"),
    "fhir_type_test": (R.observations, "value is Quantity", "boolean", "SELECT event_id AS key, event_id % 2 = 0 AS result FROM events"),
    "fhir_equivalence": (R.observations, "(code.text.upper() & ' ') ~ 'click'", "boolean", "SELECT event_id AS key, lower(event_type) = 'click' AS result FROM events"),
    "fhir_datetime_add": (R.observations, "(effective + 90 minutes).toString()", "string", "SELECT event_id AS key, strftime(date_trunc('second', ts) + INTERVAL 90 MINUTE, '%Y-%m-%dT%H:%M:%S') AS result FROM events"),
    "fhir_matches": (R.communications, "payload.content.first().matches('[0-9]{3}')", "boolean", "SELECT doc_id AS key, regexp_matches(text, '[0-9]{3}') AS result FROM documents"),
    "fhir_split_count": (R.communications, "payload.content.first().split(' ').count()", "bigint", "SELECT doc_id AS key, CASE WHEN text IS NULL THEN 0 ELSE CAST(len(string_split(text, ' ')) AS BIGINT) END AS result FROM documents"),
    "fhir_substring_index": (R.communications, "payload.content.first().indexOf('the')", "bigint", "SELECT doc_id AS key, CAST(strpos(text, 'the') - 1 AS BIGINT) AS result FROM documents"),
}

#: Fixed names for what the paths below repeat.
_BALANCE, _SQL_BALANCE = "extension('http://example.org/balance').value.first()", "CAST(c_acctbal AS DECIMAL(18,2))"
_ACTIVE = "c_acctbal > 0"
_FIRST_LINE = "FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"

PATHS |= {
    "fhir_as": (R.patients, "(extension('http://example.org/segment').value.first() as string).first()", "string", "SELECT c_custkey AS key, c_mktsegment AS result FROM customer"),
    "fhir_not": (R.patients, "(id.toInteger() mod 3 = 0).not()", "boolean", "SELECT c_custkey AS key, c_custkey % 3 <> 0 AS result FROM customer"),
    "fhir_or": (R.patients, "active or id.toInteger() mod 2 = 0", "boolean", f"SELECT c_custkey AS key, {_ACTIVE} OR c_custkey % 2 = 0 AS result FROM customer"),
    "fhir_contains_operator": (R.patients, "name.given contains 'BUILDING'", "boolean", "SELECT c_custkey AS key, c_mktsegment = 'BUILDING' AS result FROM customer"),
    "fhir_empty": (R.patients, "name.given.where($this = 'BUILDING').empty()", "boolean", "SELECT c_custkey AS key, c_mktsegment <> 'BUILDING' AS result FROM customer"),
    "fhir_single": (R.patients, "name.given.where($this != 'A').single()", "string", "SELECT c_custkey AS key, c_mktsegment AS result FROM customer"),
    "fhir_divide": (R.patients, f"{_BALANCE} / 4", "decimal(18,4)", f"SELECT c_custkey AS key, CAST({_SQL_BALANCE} * 0.25 AS DECIMAL(18,4)) AS result FROM customer"),
    "fhir_reciprocal": (R.patients, "1 / id.toInteger()", "string", "SELECT c_custkey AS key, CASE WHEN c_custkey = 1 THEN '1' ELSE rtrim('0.' || lpad(CAST((CAST('10000000000000000000000000000' AS HUGEINT) + c_custkey // 2) // nullif(c_custkey, 0) AS VARCHAR), 28, '0'), '0') END AS result FROM customer"),
    "fhir_wide_sum": (R.patients, "99999999999999999999.50 + id.toInteger()", "string", "SELECT c_custkey AS key, CAST(CAST('99999999999999999999' AS HUGEINT) + c_custkey AS VARCHAR) || '.50' AS result FROM customer"),
    "fhir_string_plus": (R.patients, "name.family.first() + '/' + id", "string", "SELECT c_custkey AS key, c_name || '/' || c_custkey AS result FROM customer"),
    "fhir_unary": (R.patients, "-id.toInteger() + +5", "bigint", "SELECT c_custkey AS key, 5 - c_custkey AS result FROM customer"),
    "fhir_trim": (R.patients, "('  ' & name.family.first() & ' ').trim()", "string", "SELECT c_custkey AS key, c_name AS result FROM customer"),
    "fhir_starts_contains": (R.patients, "name.given.last().startsWith('B') or name.given.last().contains('HOLD')", "boolean", "SELECT c_custkey AS key, c_mktsegment LIKE 'B%' OR c_mktsegment LIKE '%HOLD%' AS result FROM customer"),
    "fhir_to_chars": (R.patients, "id.toChars().distinct().count()", "bigint", "SELECT c_custkey AS key, CAST(len(list_distinct(string_split(CAST(c_custkey AS VARCHAR), ''))) AS BIGINT) AS result FROM customer"),
    "fhir_replace_matches": (R.patients, "name.family.first().replaceMatches('0+([1-9])', '<$1>')", "string", r"SELECT c_custkey AS key, regexp_replace(c_name, '0+([1-9])', '<\1>', 'g') AS result FROM customer"),
    "fhir_abs": (R.patients, f"{_BALANCE}.abs()", "decimal(18,2)", f"SELECT c_custkey AS key, abs({_SQL_BALANCE}) AS result FROM customer"),
    "fhir_rounding": (R.patients, f"{_BALANCE}.ceiling() * 3 + {_BALANCE}.floor() * 2 + {_BALANCE}.truncate()", "bigint", f"SELECT c_custkey AS key, CAST(ceil({_SQL_BALANCE}) * 3 + floor({_SQL_BALANCE}) * 2 + trunc({_SQL_BALANCE}) AS BIGINT) AS result FROM customer"),
    "fhir_sqrt": (R.patients, "(id.toInteger() * id.toInteger()).sqrt()", "bigint", "SELECT c_custkey AS key, c_custkey AS result FROM customer"),
    "fhir_exp_ln": (R.patients, "(id.toInteger() + 1).ln().exp().round(3)", "decimal(18,3)", "SELECT c_custkey AS key, CAST(c_custkey + 1 AS DECIMAL(18,3)) AS result FROM customer"),
    "fhir_log": (R.patients, "(id.toInteger() + 1).log(10).round(6)", "decimal(18,6)", "SELECT c_custkey AS key, CAST(round(log10(c_custkey + 1), 6) AS DECIMAL(18,6)) AS result FROM customer"),
    "fhir_power": (R.patients, "id.toInteger().power(2) + 2.power(3)", "bigint", "SELECT c_custkey AS key, c_custkey * c_custkey + 8 AS result FROM customer"),
    "fhir_to_decimal": (R.patients, "(id & '.25').toDecimal() * 2", "decimal(18,2)", "SELECT c_custkey AS key, CAST(c_custkey * 2 + 0.5 AS DECIMAL(18,2)) AS result FROM customer"),
    "fhir_to_boolean": (R.patients, "name.given.last().replace('BUILDING', 'true').replace('MACHINERY', '0').toBoolean()", "boolean", "SELECT c_custkey AS key, CASE c_mktsegment WHEN 'BUILDING' THEN true WHEN 'MACHINERY' THEN false END AS result FROM customer"),
    "fhir_converts": (R.patients, "iif(active, id, 'x').convertsToInteger().toString() & ' ' & iif(active, 'abc', '1.5').convertsToDecimal().toString() & ' ' & iif(active, 'true', 'maybe').convertsToBoolean().toString() & ' ' & id.convertsToString().toString()", "string",
                      f"SELECT c_custkey AS key, CASE WHEN {_ACTIVE} THEN 'true false true true' ELSE 'false true false true' END AS result FROM customer"),
    "fhir_converts_dates": (R.patients, "iif(active, '2014-02', 'May').convertsToDate().toString() & ' ' & iif(active, 'May', '2014-02-03T10:00:00Z').convertsToDateTime().toString()", "string", f"SELECT c_custkey AS key, CASE WHEN {_ACTIVE} THEN 'true false' ELSE 'false true' END AS result FROM customer"),
    "fhir_today": (R.patients, "iif(active, today(), @2000-01-01) > @2001-01-01", "boolean", f"SELECT c_custkey AS key, {_ACTIVE} AS result FROM customer"),
    "fhir_now": (R.patients, "iif(active, now(), @2000-01-01T00:00:00Z) > @2001-01-01T00:00:00Z", "boolean", f"SELECT c_custkey AS key, {_ACTIVE} AS result FROM customer"),
    "fhir_repeat": (R.patients, "name.given.repeat(iif($this = 'BUILDING', 'A', 'x')).count()", "bigint", "SELECT c_custkey AS key, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END AS BIGINT) AS result FROM customer"),
    "fhir_qualified_type": (R.patients, "iif(active, 'x', 1).first() is System.String", "boolean", f"SELECT c_custkey AS key, {_ACTIVE} AS result FROM customer"),
    "fhir_keyword_members": (R.patients, "name.is.empty() and name.div.empty() and name.contains.empty() and active", "boolean", f"SELECT c_custkey AS key, {_ACTIVE} AS result FROM customer"),
    "fhir_children_values": (R.patients, "name.children().ofType(string).where($this = 'BUILDING' or $this = 'official').count()", "bigint", "SELECT c_custkey AS key, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END AS BIGINT) AS result FROM customer"),
    "fhir_not_equivalent": (R.observations, "code.text.upper() !~ 'CLICK'", "boolean", "SELECT event_id AS key, lower(event_type) <> 'click' AS result FROM events"),
    "fhir_quantity_equal": (R.benefits, "item.where(quantity = 25 '1').count()", "bigint", f"SELECT o_orderkey AS key, count(*) FILTER (l_quantity = 25) AS result {_FIRST_LINE}"),
    "fhir_quantity_plus": (R.benefits, "(item.where(sequence = 1).first().quantity + 5 '1' - 2 '1').value", "decimal(18,2)", f"SELECT o_orderkey AS key, CAST(min(CAST(l_quantity AS DECIMAL(18,2))) FILTER (l_linenumber = 1) + 3 AS DECIMAL(18,2)) AS result {_FIRST_LINE}"),
    "fhir_quantity_times": (R.benefits, "(item.where(sequence = 1).first().quantity * 3 / 2).value", "decimal(18,2)", f"SELECT o_orderkey AS key, CAST(min(CAST(l_quantity AS DECIMAL(18,2))) FILTER (l_linenumber = 1) * 1.5 AS DECIMAL(18,2)) AS result {_FIRST_LINE}"),
}


def _query(make: Callable, path: str, kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = fhirpath(make(spark, sf_dir), "resource", path, errors=None)
        return found.select("key", F.col("result").cast(kind).alias("result"))

    return run


def _documents(found: DataFrame, kind: str) -> DataFrame:
    texts = found.select(F.concat(F.lit(kind + "/"), F.col("key").cast("string")).alias("path"), F.to_json("resource").alias("json"))
    return checked(texts)


def _parsed(docs: DataFrame) -> DataFrame:
    """Documents are read several times below: parsed once, kept as variants."""
    return materialized(docs.select("path", "v", "resource_type", "doc_error"), "documents")


def _graph(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = _parsed(docs)
    found = materialized(graph.resources(docs).drop("label"), "resources")  # labels cost more than all else of a resource
    ids = materialized(graph.identities(docs, found), "identities")
    return found, ids, graph.resolve(graph.references(found), ids, graph.contained(found))


def fhir_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of each patient's organization, by references between documents."""
    docs = _documents(R.patients(spark, sf_dir), "p").union(_documents(R.organizations(spark, sf_dir), "o"))
    found, _, resolved = _graph(docs)
    names = found.where("resource_type = 'Organization'").select(F.col("path").alias("target_path"), F.try_variant_get("v", "$.name", "string").alias("result"))
    rows = resolved.where("owner_type = 'Patient'").join(names, "target_path")
    return rows.select(F.col("owner_id").cast("long").alias("key"), "result")


def fhir_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many references each organization has from other documents."""
    docs = _documents(R.patients(spark, sf_dir), "p").union(_documents(R.organizations(spark, sf_dir), "o"))
    found, ids, resolved = _graph(docs)
    used = graph.usages(resolved, found, ids).groupBy(F.col("target_path").alias("path")).count()
    rows = found.where("resource_type = 'Organization'").select("path", "id").join(used, "path", "left")
    return rows.select("id", F.coalesce("count", F.lit(0)).alias("usages"))


def fhir_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of observations to patients that do not exist, by reference: those of odd events name another type."""
    reference = F.concat(F.when(F.col("key") % 2 == 1, "Person/").otherwise("Patient/"), F.substring_index("resource.subject.reference", "/", -1))
    observations = R.observations(spark, sf_dir).withColumn("resource", F.col("resource").withField("subject", F.struct(reference.alias("reference"))))
    docs = _documents(R.patients(spark, sf_dir), "p").union(_documents(observations, "e"))
    _, _, resolved = _graph(docs)
    rows = graph.unresolved(resolved.where("owner_type = 'Observation'"))
    return rows.groupBy("raw").agg(F.count("*").alias("n"))


def fhir_resolve_in_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resolve() within an expression: the region of each patient's organization, two references away."""
    docs = _documents(R.patients(spark, sf_dir), "p").union(_documents(R.organizations(spark, sf_dir), "o"))
    targets = graph.Targets(docs)
    rows = targets.rows.where("resource.resourceType = 'Patient'")
    found = targets.paths("managingOrganization.resolve().partOf.resolve().name", rows, errors=None)
    return found.select(F.col("resource.id").cast("long").alias("key"), F.get("result", F.lit(0)).alias("result"))


def fhir_resolve_flavors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of all flavors in paths: each order's bundle has a claim that names its patient by urn, its provider within itself, its insurer by
    another server's url, which two files hold; claims of customers that are divisible by 3 name a patient that does not exist."""
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey")
    order, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    pick = lambda **fields: F.struct(*(x.alias(n) for n, x in fields.items()))
    link = lambda x: pick(reference=x)
    insurer = F.concat(F.lit("http://example.org/fhir/Organization/"), (F.col("o_custkey") % 25).cast("string"))
    claim = pick(
        resourceType=F.lit("Claim"), id=order, contained=F.array(pick(resourceType=F.lit("Practitioner"), id=F.lit("pr"), name=F.col("o_orderpriority"))),
        patient=link(F.when(F.col("o_custkey") % 3 == 0, "urn:uuid:none").otherwise(F.concat(F.lit("urn:uuid:"), customer))), provider=link(F.lit("#pr")), insurer=F.array(link(insurer), link(F.lit("#none"))),
    )
    patient = pick(resourceType=F.lit("Patient"), id=customer, birthDate=F.lit("1980-01-02"))
    url = F.coalesce(F.concat(F.lit('"fullUrl":"urn:uuid:'), customer, F.lit('",')), F.lit(""))
    text = F.concat(F.lit('{"resourceType":"Bundle","id":"b'), order, F.lit('","entry":[{'), url, F.lit('"resource":'), F.to_json(patient), F.lit('},{"resource":'), F.to_json(claim), F.lit("}]}"))
    bundles = orders.select(F.concat(F.lit("b/"), order).alias("path"), text.alias("json"))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("file", F.explode(F.array(F.lit("m"), F.lit("z"))))
    named = pick(resourceType=F.lit("Organization"), id=F.col("n_nationkey").cast("string"), name=F.concat("file", F.lit(" "), "n_name"))
    docs = checked(bundles.union(nation.select(F.concat("file", F.lit("/"), F.col("n_nationkey").cast("string")), F.to_json(named))))
    targets = graph.Targets(docs)
    rows = targets.rows.where("resource.resourceType = 'Claim'").withColumn("key", F.col("resource.id").cast("long"))
    found = targets.paths("patient.resolve().id & '|' & provider.resolve().name & '|' & insurer.where(resolve().exists()).resolve().name & '|' & insurer.select(resolve().name).count().toString()", rows, errors=None)
    return found.select("key", "result")


def fhir_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of each patient's and organization's row in an outline."""
    docs = _documents(R.patients(spark, sf_dir), "p").union(_documents(R.organizations(spark, sf_dir), "o"))
    return graph.outline(docs).select("identity", "label")


def fhir_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of patients, to which some defects were added by their key."""
    p, n = R.patients(spark, sf_dir), F.col("key") % 10
    text = F.to_json("resource")
    text = F.when(n == 1, F.regexp_replace(text, r"\}$", ',"shoeSize":1}')).when(n == 2, F.regexp_replace(text, r'"name":\[(.*?\})\]', '"name":$1'))
    text = text.when(n == 3, F.regexp_replace(F.to_json("resource"), '"active":(true|false)', '"active":"$1"')).when(n == 4, F.regexp_replace(F.to_json("resource"), r"\}$", ',"birthDate":"17 May"}'))
    text = text.when(n == 5, F.regexp_replace(F.to_json("resource"), r"\}$", ',"deceased":true}')).when(n == 6, F.regexp_replace(F.to_json("resource"), r"\}$", ',"contact":[{"gender":"male"}]}')).otherwise(F.to_json("resource"))
    docs = checked(materialized(p.select(F.col("key").cast("string").alias("path"), text.alias("json")), "texts"))
    found = validate.validate(docs, definitions.bundled(spark))
    return found.select("path", "element_path", "severity", "category")


_GRAPH: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "fhir_resolve": (fhir_resolve, "SELECT c_custkey AS key, n_name AS result FROM customer JOIN nation ON n_nationkey = c_nationkey"),
    "fhir_usages": (fhir_usages, "SELECT CAST(n_nationkey AS VARCHAR) AS id, count(c_custkey) AS usages FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey UNION ALL SELECT 'R' || r_regionkey, count(n_nationkey) FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey"),
    "fhir_unresolved": (fhir_unresolved, "SELECT raw, count(*) AS n FROM (SELECT CASE WHEN event_id % 2 = 1 THEN 'Person/' ELSE 'Patient/' END || user_id AS raw FROM events WHERE event_id % 2 = 1 OR user_id NOT IN (SELECT c_custkey FROM customer)) GROUP BY raw"),
    "fhir_resolve_in_path": (fhir_resolve_in_path, "SELECT c_custkey AS key, r_name AS result FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"),
    "fhir_resolve_flavors": (fhir_resolve_flavors, "SELECT o_orderkey AS key, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END || '|' || o_orderpriority || '|m ' || n_name || '|1' AS result FROM orders JOIN nation ON n_nationkey = o_custkey % 25"),
    "fhir_outline": (fhir_outline, "SELECT 'Patient/' || c_custkey AS identity, '[Patient] A ' || c_name || ' (' || c_custkey || ')' AS label FROM customer UNION ALL SELECT 'Organization/' || n_nationkey, 'Organization/' || n_nationkey FROM nation UNION ALL SELECT 'Organization/R' || r_regionkey, 'Organization/R' || r_regionkey FROM region"),
    "fhir_validate": (fhir_validate, "SELECT path, CASE k WHEN 1 THEN 'Patient.shoeSize' WHEN 2 THEN 'Patient.name' WHEN 3 THEN 'Patient.active' WHEN 4 THEN 'Patient.birthDate' WHEN 5 THEN 'Patient.deceased' WHEN 6 THEN 'Patient.contact[0]' END AS element_path, 'error' AS severity, CASE k WHEN 1 THEN 'unknown' WHEN 2 THEN 'cardinality' WHEN 3 THEN 'type' WHEN 4 THEN 'format' WHEN 5 THEN 'choice' WHEN 6 THEN 'invariant' END AS category FROM (SELECT CAST(c_custkey AS VARCHAR) AS path, c_custkey % 10 AS k FROM customer) WHERE k BETWEEN 1 AND 6 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'Patient', 'warning', 'invariant' FROM customer"),
}

_GRAPH |= SCENARIOS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(make, path, kind) for name, (make, path, kind, _) in PATHS.items()} | {name: q for name, (q, _) in _GRAPH.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, _, _, sql) in PATHS.items()} | {name: sql for name, (_, sql) in _GRAPH.items()}
