"""FHIR resources derived from the base tables: our own mapping, to have queries at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import spread

MONEY = "decimal(18,2)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, resource): a Patient for each customer."""
    c = spread(_table(spark, sf_dir, "customer"), "c_custkey")
    return c.select(
        F.col("c_custkey").alias("key"),
        F.struct(
            F.lit("Patient").alias("resourceType"),
            F.col("c_custkey").cast("string").alias("id"),
            (F.col("c_acctbal") > 0).alias("active"),
            F.array(F.struct(F.lit("official").alias("use"), F.col("c_name").alias("family"), F.array(F.lit("A"), F.col("c_mktsegment")).alias("given"))).alias("name"),
            F.struct(F.concat(F.lit("Organization/"), F.col("c_nationkey").cast("string")).alias("reference")).alias("managingOrganization"),
            F.array(
                F.struct(F.lit("http://example.org/segment").alias("url"), F.col("c_mktsegment").alias("valueString"), F.lit(None).cast(MONEY).alias("valueDecimal")),
                F.struct(F.lit("http://example.org/balance").alias("url"), F.lit(None).cast("string").alias("valueString"), F.col("c_acctbal").cast(MONEY).alias("valueDecimal")),
            ).alias("extension"),
        ).alias("resource"),
    )


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, resource): an Organization for each nation, part of that of its region."""
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    make = lambda kind, key, name, up: F.struct(
        F.lit("Organization").alias("resourceType"), F.concat(F.lit(kind), F.col(key).cast("string")).alias("id"), F.col(name).alias("name"), F.struct(up.alias("reference")).alias("partOf")
    )
    nations = n.select(F.col("n_nationkey").cast("long").alias("key"), make("", "n_nationkey", "n_name", F.concat(F.lit("Organization/R"), F.col("n_regionkey").cast("string"))).alias("resource"))
    regions = r.select((F.col("r_regionkey") + 1000).cast("long").alias("key"), make("R", "r_regionkey", "r_name", F.lit(None).cast("string")).alias("resource"))
    return nations.union(regions)


def benefits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, resource): an ExplanationOfBenefit for each order, with its lines as items by number."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("l_linenumber").cast("long").alias("sequence"),
                    F.struct(F.col("l_quantity").cast(MONEY).alias("value"), F.lit("1").alias("unit")).alias("quantity"),
                    F.struct(F.col("l_extendedprice").cast(MONEY).alias("value"), F.lit("USD").alias("currency")).alias("net"),
                    F.date_format("l_shipdate", "yyyy-MM-dd").alias("servicedDate"),
                    F.struct(F.col("l_partkey").cast("string").alias("text")).alias("productOrService"),
                    F.col("l_suppkey").cast("string").alias("supplier"),
                )
            )
        ).alias("item")
    )
    o = _table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(
        F.col("o_orderkey").alias("key"),
        F.struct(
            F.lit("ExplanationOfBenefit").alias("resourceType"),
            F.col("o_orderkey").cast("string").alias("id"),
            F.struct(F.concat(F.lit("Patient/"), F.col("o_custkey").cast("string")).alias("reference")).alias("patient"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"),
            F.col("item"),
        ).alias("resource"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, resource): an Observation for each event. Even ones hold a quantity, odd ones a text: a choice element."""
    e = spread(_table(spark, sf_dir, "events"), "event_id")
    even = F.col("event_id") % 2 == 0
    return e.select(
        F.col("event_id").alias("key"),
        F.struct(
            F.lit("Observation").alias("resourceType"),
            F.col("event_id").cast("string").alias("id"),
            F.lit("final").alias("status"),
            F.struct(F.col("event_type").alias("text")).alias("code"),
            F.struct(F.concat(F.lit("Patient/"), F.col("user_id").cast("string")).alias("reference")).alias("subject"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("effectiveDateTime"),
            F.when(even, F.struct(F.col("value").cast(MONEY).alias("value"), F.lit("u").alias("unit"))).alias("valueQuantity"),
            F.when(~even, F.col("event_type")).alias("valueString"),
        ).alias("resource"),
    )


def communications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, resource): a Communication for each document."""
    d = _table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("key"),
        F.struct(
            F.lit("Communication").alias("resourceType"), F.col("doc_id").cast("string").alias("id"), F.lit("completed").alias("status"),
            F.array(F.struct(F.col("text").alias("contentString"))).alias("payload"),
        ).alias("resource"),
    )
