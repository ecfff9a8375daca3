"""What queries do with more rows: files and costly rows are dealt to many tasks."""

import glob
import json
import re

import pytest
from pyspark.sql import functions as F

from helixpath.operators import graph
from helixpath.plans import catalog, resources, scenarios
from helixpath.plans.shared import materialized, new_path, shared_dir
from helixpath.sources.documents import checked


def _suppliers(spark, tmp_path, n):
    rows = spark.range(1, n + 1, numPartitions=1).select(F.col("id").alias("s_suppkey"))
    rows.write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def test_files_are_written_by_many_tasks(spark, tmp_path):
    root = scenarios._files(spark, _suppliers(spark, tmp_path, 3_000), (1,), new_path(spark, "files"))
    names = glob.glob(f"{root}/a/part-*.txt")
    assert len(names) == 600 and len({re.search(r"part-(\d+)-", x).group(1) for x in names}) > 1


def test_a_streams_batches_do_not_grow_with_its_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scenarios, "_FILES_PER_BATCH", 5)
    before = set(glob.glob(f"{shared_dir(spark)}/helixpath-stream-state-*"))
    assert scenarios.fhir_stream(spark, _suppliers(spark, tmp_path, 200)).count() == 200
    (state,) = set(glob.glob(f"{shared_dir(spark)}/helixpath-stream-state-*")) - before
    assert 5 <= len(glob.glob(f"{state}/commits/[0-9]*")) <= scenarios._BATCHES


def test_costly_rows_of_one_split_are_dealt_to_all_cores(spark, tmp_path):
    customers = spark.range(1, 2_001, numPartitions=1).selectExpr("id as c_custkey", "concat('C', id) as c_name", "0 as c_nationkey", "1.5D as c_acctbal", "'BUILDING' as c_mktsegment")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1, 2_001, numPartitions=1).selectExpr("id as event_id", "timestamp'2020-01-01' as ts", "id as user_id", "'click' as event_type", "2.5D as value").write.parquet(f"{tmp_path}/events.parquet")
    costly = [catalog.QUERIES["fhir_sqrt"](spark, str(tmp_path)), resources.observations(spark, str(tmp_path)), scenarios._by_key(spark, str(tmp_path), ["{}"])]
    for rows in costly:
        rows_of_tasks = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(rows_of_tasks) == 2_000 and len(rows_of_tasks) >= spark.sparkContext.defaultParallelism


def test_documents_are_parsed_once_and_their_resources_walked_once(spark, tmp_path):
    texts = [(f"p/{n}", f'{{"resourceType":"Patient","id":"{n}","managingOrganization":{{"reference":"{r}"}}}}') for n, r in enumerate(["Organization/1", "http://x.org/Organization/1", "#no", "Organization/2"])]
    spark.createDataFrame([*texts, ("o", '{"resourceType":"Organization","id":"1"}')], "path string, json string").write.parquet(f"{tmp_path}/docs")
    docs = checked(spark.read.parquet(f"{tmp_path}/docs"))
    found, _, resolved = catalog._graph(docs)
    plans = [df._jdf.queryExecution().optimizedPlan().toString().lower() for df in (docs, resolved)]
    assert len(re.findall(r"parse_?json", plans[0])) == 1 and "mapinarrow" not in plans[1] and "label" not in found.columns
    assert {r["path"]: r["target_path"] for r in resolved.collect()} == {"p/0": "o", "p/1": "o", "p/2": None, "p/3": None}


def test_an_outline_reads_and_parses_its_documents_once_and_writes_none(spark, tmp_path):
    entries = '[{"fullUrl":"urn:uuid:1","resource":{"resourceType":"Patient","name":[{"given":["Ada"],"family":"Li"}]}},{"resource":"text"},null,{"fullUrl":3,"resource":{"resourceType":"Device"}},{"resource":{"resourceType":"Device","id":"d","code":{"coding":[{"display":"Pump"}]}}},{"fullUrl":"urn:uuid:2","resource":{"name":[{"text":"x"}]}}]'
    texts = {"a": '{"resourceType":"Patient","id":"1","name":[{"family":"Li"}]}', "b": '{"resourceType":"Bundle","id":"b","entry":' + entries + "}", "c": '{"resourceType":"Bundle"}', "d": '{"id":"2"}', "e": "[", "f": '{"resourceType":"Patient"}'}
    texts["g"] = '{"resourceType":"Patient","id":"é","name":[{"text":"é[{"}],"x":' + "[" * 126 + "]" * 126 + "}"  # 127 levels in all: as deep as a document may be
    texts["h"] = '{"resourceType":"Patient","id":"deep","x":' + "[" * 127 + "]" * 127 + "}"
    texts["i"] = '{"resourceType":"Patient","id":"wide","x":[' + "[],{}," * 100 + "[]]}"
    spark.createDataFrame(list(texts.items()), "path string, json string").write.parquet(f"{tmp_path}/docs")
    outline = graph.outline(checked(spark.read.parquet(f"{tmp_path}/docs")))
    plan = outline._jdf.queryExecution().optimizedPlan().toString().lower()
    assert len(re.findall(r"parse_?json", plan)) == 1 and plan.count("relation [") == 1
    assert {(r["path"], r["position"], r["identity"], r["label"]) for r in outline.collect()} == {
        ("a", 0, "Patient/1", "[Patient] Li (1)"), ("b", 0, "urn:uuid:1", "[Patient] Ada Li (?)"), ("b", 4, "Device/d", "[Device] Pump (d)"), ("b", 5, "urn:uuid:2", "[null] x (?)"),
        ("g", 0, "Patient/é", "[Patient] é[{ (é)"), ("i", 0, "Patient/wide", "Patient/wide"),
    }
    written = set(glob.glob(f"{shared_dir(spark)}/*"))
    assert catalog.QUERIES["fhir_outline"](spark, "/root/testdata/sf0.001").count() > 0 and set(glob.glob(f"{shared_dir(spark)}/*")) == written


def _linked(spark):
    org = lambda i, name, up=None: {"resourceType": "Organization", "id": i, "name": name} | ({"partOf": {"reference": up}} if up else {})
    links = ["#d", "#none", "Organization/o", "urn:uuid:1", "http://x/Organization/o", "http://x/Organization/p", "http://abs/Organization/q", "Bundle/b", "Nobody/1"]
    listing = {"resourceType": "List", "id": "l", "contained": [{"resourceType": "Device", "id": "d", "name": "old"}, None, {"resourceType": "Device", "id": "d", "name": "inside"}], "link": [{"reference": r} for r in links]}
    entries = [{"fullUrl": "urn:uuid:1", "resource": org("o", "first")}, {"resource": org("o", "last")}, None, {"resource": "text"}, {"fullUrl": "#d", "resource": listing}]
    docs = {
        "b": {"resourceType": "Bundle", "id": "b", "entry": entries}, "c": {"resourceType": "Bundle", "id": "c", "entry": [{"fullUrl": "http://abs/Organization/q", "resource": org("q", "as it stands")}]},
        "a": org("q", "by its tail"), "p1": org("p", "p1", "Organization/top"), "p2": org("p", "p2"), "t": org("top", "Top", "Organization/top"), "e": {"resourceType": "Bundle"}, "x": {"id": "none"},
        "s": {"resourceType": "List", "id": "s", "link": [{"reference": r} for r in ("#d", "Organization/p", "Organization/p")]},
    }
    return checked(spark.createDataFrame([(p, json.dumps(d)) for p, d in docs.items()], "path string, json string"))


@pytest.mark.parametrize(("near", "far"), [(64, 256), (64, 0), (3, 256), (3, 0)])
def test_references_are_found_alike_in_rows_and_by_joins(spark, monkeypatch, near, far):
    monkeypatch.setattr(graph, "NEAR", near)
    monkeypatch.setattr(graph, "FAR", far)
    targets = graph.Targets(_linked(spark))
    assert targets.plain and targets.large == (near == 3)
    found = targets.paths("link.resolve().name.join(', ') & '; ' & link.resolve().partOf.resolve().name.join(', ')", targets.rows.where("resource.resourceType = 'List'"), errors=None)
    assert {r["path"]: r["result"] for r in found.collect()} == {"b": "inside, last, first, last, p1, as it stands; Top", "s": "p1, p1; Top, Top"}


def test_references_of_a_path_are_looked_up_at_once_and_documents_written_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "materialized", lambda df, name: (written.append(name), materialized(df, name))[1])
    monkeypatch.setattr(catalog, "materialized", lambda df, name: (written.append(name), materialized(df, name))[1])
    rows = catalog.QUERIES["fhir_resolve_flavors"](spark, "/root/testdata/sf0.001").collect()
    assert written == ["members", "wanted", "far"]
    assert len(rows) == len({r["key"] for r in rows}) == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count() and all(r["result"].endswith("|1") for r in rows)
