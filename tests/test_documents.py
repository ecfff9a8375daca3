"""Sources, graph, validation and repair on a small workspace of files."""

import json

import pytest
from pyspark.sql import functions as F

from helixpath.operators import graph, repair, validate
from helixpath.sources import definitions
from helixpath.sources.documents import checked, inferred_schema, parse_json, read_files, skipped
from helixpath.streaming import documents as streaming

FILES = {
    "clinics/north.json": {"resourceType": "Organization", "id": "north", "name": "North Clinic", "partOf": {"reference": "Organization/group"}},
    "archive/north.json": {"resourceType": "Organization", "id": "north"},
    "clinics/group.json": {"resourceType": "Bundle", "id": "c7", "type": "collection", "entry": [
        {"fullUrl": "urn:uuid:9a", "resource": {"resourceType": "Organization", "id": "group"}},
        {"resource": {"resourceType": "Communication", "id": "note-3", "status": "completed", "sender": {"reference": "urn:uuid:9a"}, "subject": {"reference": "Patient/missing"},
                      "recipient": [{"reference": "http://other.example/r4/Organization/north"}, {"reference": "#me"}], "contained": [{"resourceType": "Practitioner", "id": "me"}]}},
    ]},
    "people/dora.json": {"resourceType": "Practitioner", "id": "dora", "name": [{"text": "Dr Dora"}]},
    "forms/intake.json": {"resourceType": "Questionnaire", "id": "intake", "status": "draft", "code": [{"display": "Intake"}]},
    "settings.json": {"theme": "dark"},
    "target/old.json": {"resourceType": "Practitioner", "id": "old"}, ".tests/x.json": {"resourceType": "Practitioner", "id": "x"}, "dist/kept.json": {"resourceType": "Practitioner", "id": "kept"},
}


@pytest.fixture(scope="module")
def workspace(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("ws")
    for name, doc in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(json.dumps(doc))
    (root / "broken.json").write_text('{"resourceType": ')
    return str(root)


@pytest.fixture(scope="module")
def docs(spark, workspace):
    files, clipped = read_files(spark, workspace)
    assert not clipped
    return checked(files.withColumn("path", F.regexp_extract("path", r"ws\d*/(.*)$", 1))).cache()


def test_scan(spark, workspace, docs):
    assert {r["path"] for r in docs.select("path").collect()} == {"clinics/north.json", "archive/north.json", "clinics/group.json", "people/dora.json", "forms/intake.json", "settings.json", "broken.json", "dist/kept.json"}
    assert skipped(docs).first()["skipped"] == 2
    some, clipped = read_files(spark, workspace, most=2)
    assert clipped and some.count() == 2
    assert read_files(spark, workspace, most=None, since="2100-01-01")[0].count() == 0


def test_json_is_strict(spark):
    texts = ['{"a":1}', '{"a":1} x', '{"a":1}{"b":2}', "", " ", "[1", "null", "3", '{"a":1,"a":2}', None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("v", parse_json(F.col("t")))
    good = {r["i"]: r["x"] for r in rows.where("v is not null").select("i", F.to_json("v").alias("x")).collect()}
    assert good == {0: '{"a":1}', 6: "null", 7: "3", 8: '{"a":2}'}


def test_graph(docs):
    found = graph.resources(docs).cache()
    labels = {r["element_path"] + " " + r["path"]: r["label"] for r in found.collect()}
    assert labels["Practitioner people/dora.json"] == "[Practitioner] Dr Dora (dora)" and labels["Organization clinics/north.json"] == "Organization/north"
    ids, refs = graph.identities(docs, found), graph.references(found)
    assert {r["identity"] for r in ids.collect()} == {"Organization/north", "Organization/group", "Communication/note-3", "Bundle/c7", "urn:uuid:9a", "Practitioner/dora", "Practitioner/kept", "Questionnaire/intake"}
    resolved = graph.resolve(refs, ids, graph.contained(found)).cache()
    got = {r["raw"]: (r["flavor"], r["target_path"], r["target_element"], r["candidates"]) for r in resolved.collect()}
    group = ("clinics/group.json", "Bundle.entry[0].resource", 1)
    assert got == {
        "Organization/group": ("relative", *group),
        "urn:uuid:9a": ("urn-uuid", *group),
        "http://other.example/r4/Organization/north": ("absolute", "archive/north.json", "Organization", 2),  # the lowest path of two
        "#me": ("contained", "clinics/group.json", "Bundle.entry[1].resource.contained[0]", 1),
        "Patient/missing": ("relative", None, None, 0),
    }
    used = {(r["target_path"], r["path"], r["raw"]) for r in graph.usages(resolved, found, ids).collect()}
    assert used == {("clinics/group.json", "clinics/group.json", "urn:uuid:9a"), ("clinics/group.json", "clinics/north.json", "Organization/group")}
    assert [r["raw"] for r in graph.unresolved(resolved).collect()] == ["Patient/missing"]
    assert {r["identity"]: r["label"] for r in graph.outline(docs).collect()}["Organization/group"] == "Organization/group"


def test_resolution_looks_into_the_own_document_first(spark):
    """Of exact names and last parts, in the own document and in all, each reference finds the first that is there; hot targets and nulls change nothing."""
    ids = spark.createDataFrame([("http://a.example/Device/1", "z", "Device", 0), ("Device/1", "m", "Device", 0), ("Device/1", "n", "Device", 0), ("Device/2", "m", "Device", 0)], "identity string, path string, element_path string, position int")
    inside = spark.createDataFrame([("m", "Device", "x", "Device.contained[0]")], "path string, owner_path string, contained_id string, element_path string")
    rows = [("m", "http://a.example/Device/1"), ("o", "http://a.example/Device/1"), ("o", "http://b.example/Device/1"), ("n", "http://b.example/Device/1"), ("o", "http://b.example/none"), ("m", "#x"), ("n", "#x"), ("o", "what ever")] + [("o", "Device/2")] * 500
    refs = spark.createDataFrame([(p, "Device", r, r) for p, r in rows], "path string, owner_path string, raw string, note string").withColumn("flavor", graph.flavor(F.col("raw")))
    out = graph.resolve(refs, ids, inside)
    assert out.columns == [*refs.columns, "target_path", "target_element", "candidates"]
    got = {(r["path"], r["raw"], r["target_path"], r["candidates"]) for r in out.collect() if r["raw"] != "Device/2"}
    assert got == {
        ("m", "http://a.example/Device/1", "m", 1), ("o", "http://a.example/Device/1", "z", 1), ("o", "http://b.example/Device/1", "m", 2), ("n", "http://b.example/Device/1", "n", 1),
        ("o", "http://b.example/none", None, 0), ("m", "#x", "m", 1), ("n", "#x", None, 0), ("o", "what ever", None, 0),
    }
    assert out.where("raw = 'Device/2' and target_path = 'm'").count() == 500


FINE = {"resourceType": "Medication", "amount": {"numerator": {"value": 2.50, "code": "mg", "system": "http://unitsofmeasure.org"}}}
BAD = {
    "keys": ({"resourceType": "Organization", "name": "N", "colour": "red", "_alias": [], "_size": {}}, {("Organization.colour", "unknown"), ("Organization._size", "unknown")}),
    "bare": ({"resourceType": "MedicationRequest", "status": "active", "intent": "plan", "subject": {"display": "x"}, "medication": {"text": "y"}}, {("MedicationRequest.medication", "choice")}),
    "forms": ({"resourceType": "Observation", "status": "final", "code": {"text": "x"}, "valueString": "a", "valueInteger": 1}, {("Observation.value", "choice")}),
    "shape": ({"resourceType": "Practitioner", "name": {"prefix": "Dr"}, "communication": [], "birthDate": ["1970-01-01"]}, {("Practitioner.name", "cardinality"), ("Practitioner.name.prefix", "cardinality"), ("Practitioner.communication", "cardinality"), ("Practitioner.birthDate", "cardinality")}),
    "missing": ({"resourceType": "Questionnaire", "item": [{"linkId": "a", "item": [{"type": "group"}]}]}, {("Questionnaire.status", "cardinality"), ("Questionnaire.item[0].type", "cardinality"), ("Questionnaire.item[0].item[0].linkId", "cardinality")}),
    "types": ({"resourceType": "Patient", "multipleBirthInteger": 1.5, "telecom": ["x"], "active": "yes", "photo": [{"size": -1}], "contained": [{"id": "q"}]}, {("Patient.multipleBirthInteger", "type"), ("Patient.telecom[0]", "type"), ("Patient.active", "type"), ("Patient.photo[0].size", "type"), ("Patient.contained[0]", "type")}),
    "null": ({"resourceType": "Medication", "status": None, "form": {"text": None}}, {("Medication.status", "type"), ("Medication.form.text", "type")}),
    "format": ({"resourceType": "Practitioner", "birthDate": "1970-13-01", "gender": " male"}, {("Practitioner.birthDate", "format"), ("Practitioner.gender", "format")}),
    "inside": ({"resourceType": "Bundle", "type": "collection", "entry": [{"resource": {"resourceType": "Spaceship"}}, {"resource": {"resourceType": "Observation", "status": "final", "code": {"text": "x"}, "component": [{"code": {"text": "y"}, "referenceRange": [{}]}]}}]}, {("Bundle.entry[0].resource", "unknown"), ("Bundle.entry[1].resource.component[0].referenceRange[0]", "invariant")}),
    "phone": ({"resourceType": "Organization", "name": "x", "telecom": [{"value": "1"}]}, {("Organization.telecom[0]", "invariant")}),
    "unit": ({"resourceType": "Medication", "amount": {"numerator": {"value": 1, "code": "mg"}}}, {("Medication.amount.numerator", "invariant")}),
    "fine": (FINE, set()),
}


def test_validation_and_repair(spark):
    docs = checked(spark.createDataFrame([(k, json.dumps(d)) for k, (d, _) in BAD.items()] + [("none", "{"), ("other", '{"a": 1}')], "path string, json string"))
    tables = definitions.bundled(spark)
    issues = validate.validate(docs, tables).cache()
    got: dict = {k: set() for k in BAD}
    for r in issues.where("severity = 'error'").collect():
        got[r["path"]].add((r["element_path"], r["category"]))
    assert got == {k: want for k, (_, want) in BAD.items()}
    assert {r["element_path"] for r in issues.where("severity = 'warning' and path = 'keys'").collect()} == {"Organization"}  # dom-6
    rate = validate.clean_rate(docs, issues).first()
    assert (rate["resources"], rate["clean"]) == (len(BAD), 1)
    assert {(r["severity"], r["category"]): r["issues"] for r in validate.summary(issues).collect()}["error", "choice"] == 2
    keys = {r["key"]: (r["severity"], r["issues"], r["first"]) for r in validate.invariant_counts(issues).collect()}
    assert keys["qty-3"] == ("error", 1, "Medication.amount.numerator") and keys["cpt-2"][:2] == ("error", 1) and keys["dom-6"][0] == "warning" and "dom-3" not in keys
    fixed = {r["path"]: json.loads(r["repaired"]) for r in repair.repair(docs.where("doc_error is null"), issues).collect()}
    assert fixed["keys"] == {"resourceType": "Organization", "name": "N", "_alias": []}
    assert fixed["shape"] == {"resourceType": "Practitioner", "name": [{"prefix": "Dr"}], "birthDate": "1970-01-01"}
    assert fixed["missing"]["status"] == "" and fixed["missing"]["item"][0]["item"][0]["linkId"] == "" and fixed["fine"] == FINE
    assert fixed["bare"]["medicationCodeableConcept"] == {"text": "y"}


def test_repairs():
    fixed = repair.repaired
    assert fixed('{"a": [1, 2]}', [("X.a", "no_array", "")]) == '{"a": [1, 2]}'
    assert fixed('{"a": [1.50]}', [("X.a", "no_array", "")]) == '{"a":1.50}' and fixed('{"a":1}', [("X.a", "array", "")]) == '{"a":[1]}'
    assert fixed('{"a":1}', [("X.b", "unknown", ""), ("X.c.d", "missing", "")]) == '{"a":1}' and fixed('{"a":{}}', [("X.a.d", "missing", "")]) == '{"a":{"d":""}}'
    assert fixed('{"b":1,"v":2,"c":3}', [("X.v", "bare_choice", "vString")]) == '{"b":1,"vString":2,"c":3}'
    assert fixed('{"v":0.10,"big":12345678901234567890.123456789,"e":1E400,"n":-0,"x":[],"t":"\\u00e9"}', [("X.x", "empty", "")]) == '{"v":0.10,"big":12345678901234567890.123456789,"e":1E400,"n":-0,"t":"é"}'


def test_definitions(spark, tmp_path):
    def definition(name, **more):
        element = [
            {"path": name, "min": 0, "max": "*", "constraint": [{"key": "k-1", "severity": "error", "human": "h", "expression": "a.exists()"}]},
            {"path": f"{name}.a[x]", "min": 1, "max": "1", "type": [{"code": "string"}, {"code": "http://hl7.org/fhirpath/System.Integer"}]},
            {"path": f"{name}.again", "min": 0, "max": "*", "contentReference": f"#{name}"},
            {"path": f"{name}.value", "min": 0, "max": "1", "type": [{"code": "string", "extension": [{"url": "http://hl7.org/fhir/StructureDefinition/regex", "valueString": "[a-z]+"}]}]},
        ]
        return {"resource": {"resourceType": "StructureDefinition", "name": name, "type": name, "kind": "resource", "snapshot": {"element": element}} | more}

    bundle = {"resourceType": "Bundle", "entry": [definition("Demo"), definition("code", kind="primitive-type"), definition("Base", abstract=True), definition("Profile", derivation="constraint")]}
    tables = definitions.load(spark.createDataFrame([(json.dumps(bundle),)], "json string"))
    definitions.save(tables, str(tmp_path / "schema"))
    tables = definitions.saved(spark, str(tmp_path / "schema"))
    assert {tuple(r) for r in tables["types"].collect()} == {("Demo", "resource"), ("code", "primitive-type")}
    rows = {r["path"]: r for r in tables["elements"].where("type = 'Demo'").collect()}
    assert rows["a"]["choice"] and rows["a"]["min"] == 1 and rows["a"]["types"] == ["string", "integer"] and not rows["a"]["max_many"]
    assert rows["again"]["types"] == ["#Demo"] and rows["again"]["max_many"]
    assert {(r["type"], r["key"]) for r in tables["constraints"].collect()} == {("Demo", "k-1"), ("code", "k-1")}
    assert [tuple(r) for r in tables["patterns"].collect()] == [("code", "[a-z]+")]


def test_mixed_kinds_stay_variants(spark):
    schema = inferred_schema(spark.createDataFrame([('{"a": 1, "b": {"c": true}}',), ('{"a": "x", "d": [1.5]}',)], "json string"))
    assert schema.simpleString() == "struct<a:variant,b:struct<c:boolean>,d:array<string>>"


def test_stream(spark, workspace):
    stream = streaming.read_stream(spark, workspace)
    query = stream.select("path", "resource_type", "doc_error").writeStream.format("memory").queryName("docs_seen").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("docs_seen").where("doc_error is null").count() == 6
    assert streaming.counts(stream).isStreaming


def test_places(docs):
    from pyspark.sql import functions as F

    note, entry = "clinics/group.json", "Bundle.entry[1].resource"
    rows = [(note, entry + ".status"), (note, entry + ".payload[0].contentString"), (note, "Bundle.entry[9]"), ("people/dora.json", "Practitioner"), ("people/dora.json", "Practitioner.name[0].text"), ("none", "Patient.x")]
    places = docs.sparkSession.createDataFrame(rows, "path string, element_path string")
    got = [(r["found_path"], r["exact"], r["node"], r["owner"]) for r in graph.locate(places, docs).withColumns({"node": F.try_variant_get("node", "$", "string"), "owner": graph.owner_path(F.col("element_path"))}).collect()]
    assert sorted((a, b, d) for a, b, _, d in got if a) == [("Bundle.entry", False, "Bundle"), (entry, False, entry), (entry + ".status", True, entry), ("Practitioner", True, "Practitioner"), ("Practitioner.name[0].text", True, "Practitioner")]
    assert (None, None, None, "Patient") in got and (entry + ".status", True, "completed", entry) in got


def test_schema_from_definitions(spark):
    from helixpath.plans.compiler import evaluate_json, fhirpath
    from helixpath.sources.documents import typed

    from helixpath.plans.syntax import PathError

    schema = definitions.struct_of(definitions.bundled(spark), "Observation", depth=2)
    doc = '{"code": {"text": "x"}, "valueQuantity": {"value": 0.10, "code": "mg"}, "extension": [{"extension": [{"extension": [{"url": "deep"}]}]}], "contained": [{"id": "p"}]}'
    rows = typed(spark.createDataFrame([(doc,)], "json string"), schema)
    row = fhirpath(rows, "resource", "value.ofType(Quantity).code & code.text").first()
    assert row["result"] == "mgx" and not row["error"]
    assert fhirpath(rows, "resource", "value.value", render=True).first()["result"] == "[0.10]"
    assert fhirpath(rows, "resource", "contained", render=True).first()["result"] == '[{"id":"p"}]'
    assert "deep" in fhirpath(rows, "resource", "extension.extension.extension", render=True).first()["result"]
    with pytest.raises(PathError, match="deeper"):
        fhirpath(rows, "resource", "extension.extension.extension.url")
    assert "component" in schema.fieldNames() and schema["component"].dataType.elementType["referenceRange"].dataType.elementType.fieldNames()
    out = {r["json"]: (r["result"], r["error"]) for r in evaluate_json(spark.createDataFrame([('{"a": [1, 2]}',), ("[1]",), ("{",), (None,)], "json string"), "a.count()").collect()}
    assert out == {'{"a": [1, 2]}': ("[2]", False), "[1]": (None, True), "{": (None, True), None: (None, True)}


def test_names_that_look_like_types(spark):
    schema = inferred_schema(spark.createDataFrame([('{"VOIDED": null, "OBJECT": {"VARIANT_x": [null, {"a-b": 1}]}}',)], "json string"))
    assert schema.simpleString() == "struct<OBJECT:struct<VARIANT_x:array<struct<a-b:bigint>>>,VOIDED:string>"


def nested(levels):
    doc = {"reference": "Patient/1"}
    for n in range(levels):
        doc = {"item": doc} if n % 2 else [doc]
    return {"resourceType": "Questionnaire", "id": f"q{levels}", "item": doc}


def test_depth_is_an_error_of_its_document(spark):
    texts = [json.dumps(nested(n)) for n in (0, 60, 125, 126, 500)] + ['{"resourceType":"Patient","id":"' + "[{" * 300 + '\\"[["}']
    docs = checked(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, json string"))
    assert [r["doc_error"] for r in docs.orderBy("path").collect()] == [None, None, None, "nested too deep", "nested too deep", None]
    refs = graph.references(graph.resources(docs)).collect()
    assert sorted(r["path"] for r in refs) == ["0", "1", "2"] and max(len(r["element_path"]) for r in refs) > 125 * 4
    deep = checked(docs.sparkSession.createDataFrame([("a", json.dumps(nested(20))), ("b", texts[3])], "path string, json string"))
    assert validate.validate(deep, definitions.bundled(spark)).select("path").distinct().count() >= 1


def test_repeated_keys_in_any_order_of_calls(spark):
    spark.conf.unset("spark.sql.variant.allowDuplicateKeys")
    docs = spark.createDataFrame([("a", '{"resourceType":"Patient","id":"1","id":"2"}')], "path string, json string")
    assert checked(docs).select("doc_error", F.to_json("v").alias("v")).first() == (None, '{"id":"2","resourceType":"Patient"}')


def test_ids_of_any_length(spark):
    name = "x" * 1_000_100
    docs = checked(spark.createDataFrame([("a", json.dumps({"resourceType": "Observation", "id": "o", "contained": [{"resourceType": "Patient", "id": name}], "subject": {"reference": "#" + name}}))], "path string, json string"))
    found = graph.resources(docs)
    assert graph.resolve(graph.references(found), graph.identities(docs, found), graph.contained(found)).first()["target_element"] == "Observation.contained[0]"


LINKED = {
    "b.json": {"resourceType": "Bundle", "id": "b", "entry": [
        {"fullUrl": "urn:uuid:p", "resource": {"resourceType": "Patient", "id": "p", "birthDate": "1980-01-02", "managingOrganization": {"reference": "Organization/o"}}},
        {"resource": {"resourceType": "Observation", "id": "x", "status": "final", "subject": {"reference": "urn:uuid:p"}, "performer": [{"reference": "#d"}, {"reference": "http://far.example/Organization/o"}, {"reference": "Nobody/1"}],
                      "contained": [{"resourceType": "Practitioner", "id": "d", "birthDate": "1970-01-01"}]}},
        {"resource": {"resourceType": "Observation", "id": "y", "status": "final", "subject": {"reference": "#d"}}},
    ]},
    "m.json": {"resourceType": "Organization", "id": "o", "name": "M", "partOf": {"reference": "Organization/top"}},
    "z.json": {"resourceType": "Organization", "id": "o", "name": "Z"},
    "top.json": {"resourceType": "Organization", "id": "top", "name": "Top", "partOf": {"reference": "Organization/top"}},
    "twice.json": {"resourceType": "Bundle", "id": "t", "entry": [{"resource": {"resourceType": "Device", "id": "1", "status": "old"}}, {"resource": {"resourceType": "Device", "id": "1", "status": "new"}},
                   {"resource": {"resourceType": "Observation", "id": "z", "status": "final", "subject": {"reference": "Device/1"}, "performer": [{"reference": "Device/1"}, {"reference": "Device/1"}]}}]},
}
RESOLVED = {
    "x": {
        "subject.resolve().birthDate": ["1980-01-02"], "performer.resolve().id": ["d", "o"], "performer.resolve().name": ["M"], "subject.resolve().managingOrganization.resolve().partOf.resolve().name": ["Top"],
        "performer.where(resolve() is Practitioner).reference": ["#d"], "performer.where(resolve().exists().not()).reference": ["Nobody/1"], "performer.select(resolve().name).first()": ["M"], "performer.exists(resolve().partOf.resolve().name = 'Top')": [True],
        "performer.all(resolve().exists())": [False], "Observation.where(performer.where(resolve() is Organization).count() = 1).id": ["x"], "performer.reference.resolve().count()": [2], "'Organization/top'.resolve().name": ["Top"], "iif(subject.resolve().exists(), 'y', 'n')": ["y"],
        "status.resolve()": [], "subject.resolve().resolve()": [],
    },
    "y": {"subject.resolve()": []},  # contained in another resource
    "z": {"subject.resolve().status": ["new"], "performer.resolve().status": ["new", "new"]},  # the last of a doubled identity
}


def test_resolve_in_paths(spark):
    docs = checked(spark.createDataFrame([(p, json.dumps(d)) for p, d in LINKED.items()], "path string, json string"))
    targets, wrong = graph.Targets(docs), []
    for id_, cases in RESOLVED.items():
        rows = targets.rows.where(F.col("resource.id") == id_).where("resource.resourceType = 'Observation'").select("*", F.lit("kept").alias("note"))
        for path, want in cases.items():
            row = targets.paths(path, rows, render=True).collect()
            if len(row) != 1 or row[0]["error"] or json.loads(row[0]["result"]) != want or row[0]["note"] != "kept":
                wrong.append((id_, path, row))
    assert not wrong


def test_invariants_that_resolve(spark):
    docs = checked(spark.createDataFrame([(p, json.dumps(d)) for p, d in LINKED.items()], "path string, json string"))
    tables = dict(definitions.bundled(spark))
    rule = [("Observation", "", "own-1", "error", "the subject is a patient", "subject.resolve().is_patient.exists() or subject.resolve() is Patient or subject.resolve().exists().not()")]
    tables["constraints"] = spark.createDataFrame(rule, tables["constraints"].select("type", "path", "key", "severity", "human", "expression").schema)
    bad = lambda found: {(r["path"], r["element_path"]) for r in found.where("category = 'invariant'").collect()}
    assert bad(validate.validate(docs, tables)) == set()
    assert bad(validate.validate(docs, tables, targets=graph.Targets(docs))) == {("twice.json", "Bundle.entry[2].resource")}


def test_rescan_keeps_reads_and_removes(spark, tmp_path):
    import os

    from helixpath.sources import index

    put = lambda name, doc, when: ((tmp_path / name).write_text(json.dumps(doc)), os.utime(tmp_path / name, (when, when)))
    link = lambda i, to: {"resourceType": "Organization", "id": i, "partOf": {"reference": f"Organization/{to}"}}
    for i in "abc":
        put(f"{i}.json", link(i, "x"), 1_000_000)
    one = index.rescan(spark, str(tmp_path))
    assert (one.kept, one.read, one.removed) == (0, 3, 0)
    put("a.json", link("a", "y"), 2_000_000)
    put("d.json", link("d", "z"), 500_000)  # new, with an old time
    os.remove(tmp_path / "c.json")
    two = index.rescan(spark, str(tmp_path), one)
    assert (two.kept, two.read, two.removed) == (1, 2, 1)
    assert sorted((r["owner_id"], r["raw"][-1]) for r in two.table(spark, "references").collect()) == [("a", "y"), ("b", "x"), ("d", "z")]
    assert two.table(spark, "resources").count() == two.table(spark, "files").count() == two.table(spark, "identities").count() == 3
    for i in "abd":
        os.remove(tmp_path / f"{i}.json")
    three = index.rescan(spark, str(tmp_path), two)
    assert (three.kept, three.read, three.removed) == (0, 0, 3) and three.table(spark, "resources").count() == 0


def test_ignored_folders_are_left_out_of_scans_that_run_at_once(spark, tmp_path):
    from functools import reduce

    for folder in ("a", "node_modules/b", "c/target"):
        (tmp_path / folder).mkdir(parents=True)
        for n in range(400):
            (tmp_path / folder / f"{n}.json").write_text("{}")
    files, _ = read_files(spark, str(tmp_path))
    for _ in range(3):
        scans = [files.agg(F.count_if(F.length("json") < 1000 + n).alias("n")) for n in range(8)]
        assert {r["n"] for r in reduce(lambda a, b: a.union(b), scans).collect()} == {400}
