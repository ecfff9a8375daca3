import json
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from helixpath.operators import positions, validate
from helixpath.sources import definitions
from helixpath.sources.documents import checked

TEXT = """{
  "resourceType": "Observation",
  "code": {"text": "größe", "coding": [{"code": "a"},
    {"code": "b"}]},
  "note": [ ["x", 1.50], [] ],
  "code2": null
}"""

values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=6), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(alphabet="ab_é\"\\", min_size=1, max_size=3), x, max_size=4), max_leaves=20)


def _leaves(value, place):
    yield place, value
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from _leaves(inner, f"{place}.{key}")
    if isinstance(value, list):
        for n, inner in enumerate(value):
            yield from _leaves(inner, f"{place}[{n}]")


@settings(max_examples=150, deadline=None)
@given(values, st.sampled_from([None, 2]), st.booleans())
def test_each_span_is_the_text_of_its_value(value, indent, ascii_):
    raw = json.dumps(value, indent=indent, ensure_ascii=ascii_).encode()
    found = sorted((place, json.dumps(json.loads(raw[a:b]))) for place, a, b, _, _ in positions.node_spans(raw, "R"))
    assert found == sorted((place, json.dumps(v)) for place, v in _leaves(value, "R"))
    for place, a, b, k0, k1 in positions.node_spans(raw, "R"):
        assert (k0, k1) == (a, b) or place.endswith("." + json.loads(raw[k0:k1]))


def _docs(spark, texts):
    return checked(spark.createDataFrame(texts, "path string, json string"))


def test_ranges_of_places(spark):
    docs = _docs(spark, [("a", TEXT), ("b", '{"resourceType":"Patient","id":"1","id":"2"}'), ("broken", "{")])
    asked = {
        ("a", "Observation.code.coding[1].code"): ("Observation.code.coding[1].code", True, 3, 5, 3, 11),
        ("a", "Observation.code.coding[1]"): ("Observation.code.coding[1]", True, 3, 4, 3, 17),
        ("a", "Observation.code.coding[0]"): ("Observation.code.coding[0]", True, 2, 41, 2, 54),  # ö and ß are two bytes each
        ("a", "Observation.code.coding[7].code"): ("Observation.code.coding", False, 2, 30, 2, 38),
        ("a", "Observation.note[0][1]"): ("Observation.note[0][1]", True, 4, 18, 4, 22),
        ("a", "Observation.status"): ("Observation", False, 0, 0, 6, 1),
        ("a", "Observation"): ("Observation", True, 0, 0, 6, 1),
        ("b", "Patient.id"): ("Patient.id", True, 0, 26, 0, 30),  # the first of a repeated key
        ("broken", "Patient.id"): (None,) * 6,
        ("none", "Patient"): (None,) * 6,
        (None, "Patient"): (None,) * 6,
    }
    rows = positions.ranges(spark.createDataFrame([(*k, n) for n, k in enumerate(asked)] + [("a", "Observation", 99)], "path string, element_path string, n int"), docs).collect()
    assert len(rows) == len(asked) + 1
    assert {(r.path, r.element_path): (r.found_path, r.exact, *(r[c] for c in positions.RANGE)) for r in rows} == asked


def test_owners_of_points_in_documents_longer_than_a_bin(spark, monkeypatch):
    rng = random.Random(5)
    entries = [{"resource": {"resourceType": "Basic", "id": str(n), "note": "ü" * rng.choice([1, 40, 9000])}} for n in range(30)]
    for indent in (None, 1):
        text = json.dumps({"resourceType": "Bundle", "entry": entries}, indent=indent, ensure_ascii=False)
        raw, starts = text.encode(), positions._line_starts(text.encode())
        spans = {p: (a, b) for p, a, b, _, _ in positions.node_spans(raw, "Bundle") if p.endswith(".resource")}
        points, expected = [], {}
        for offset in {x for s in spans.values() for x in (s[0] - 1, s[0], s[1] - 1, s[1])} | {rng.randrange(len(raw)) for _ in range(50)}:
            row = int(positions.np.searchsorted(starts, offset, "right")) - 1
            points.append(("d", row, offset - int(starts[row])))
            expected[points[-1]] = next((p for p, (a, b) in spans.items() if a <= offset < b), None)
        df = spark.createDataFrame([*points, ("d", 10**6, 0), ("x", 0, 0), (None, 0, 0), ("p", 0, 3), ("p", 0, 3)], "path string, row long, col long")
        rows = positions.owner_at(df, _docs(spark, [("d", text), ("p", '{"resourceType":"Patient","id":"7"}')])).collect()
        assert {tuple(r[:3]): r.element_path for r in rows if r.path == "d" and r.row < 10**6} == expected
        rest = sorted(((r.path, r.row, r.element_path, r.id) for r in rows if r.path != "d" or r.row == 10**6), key=str)
        assert rest == [("d", 10**6, None, None), ("p", 0, "Patient", "7"), ("p", 0, "Patient", "7"), ("x", 0, None, None), (None, 0, None, None)]


def test_findings_are_written_with_ranges_and_read_back(spark, tmp_path):
    docs = _docs(spark, [("a", '{"resourceType": "Patient",\n "birthDate": null}'), ("b", '{"resourceType":"Observation","code":{"text":"x"}}')])
    issues = validate.validate(docs, definitions.bundled(spark))
    positions.save_findings(issues, docs, str(tmp_path / "errors"))
    got = sorted((r.filename, r.lnum, r.col, r.end_lnum, r.end_col, r.type, r.element_path, r.rule) for r in positions.findings(spark, str(tmp_path / "errors")).collect())
    assert got == [("a", 2, 2, 2, 13, "E", "Patient.birthDate", "null"), ("b", 1, 1, 1, 51, "E", "Observation.status", "missing")]
    positions.save_findings(issues, docs, str(tmp_path / "all"), every=True)
    assert positions.findings(spark, str(tmp_path / "all")).count() == issues.count()


def test_tables_without_rows(spark):
    docs = _docs(spark, [])
    assert positions.nodes(docs).count() == 0
    assert positions.ranges(spark.createDataFrame([], "path string, element_path string"), docs).count() == 0
    assert positions.owner_at(spark.createDataFrame([], "path string, row long, col long"), docs).count() == 0


@settings(max_examples=150, deadline=None)
@given(values, st.lists(values, max_size=3), st.sampled_from([None, 2]), st.booleans())
def test_spans_of_resources_are_those_of_their_places(value, more, indent, ascii_):
    document = {"é": value, "entry": [{"x": value, "resource": v, "y": [v]} for v in [value, *more]] + [value], "z": more}
    text = " " + json.dumps(document, indent=indent, ensure_ascii=ascii_) + "\n"
    nodes = {place: (a, b) for place, a, b, _, _ in positions.node_spans(text.encode(), "Bundle")}
    found = {f"Bundle.entry[{n}].resource": (a, b) for n, a, b in positions.resource_spans(text, "Bundle").tolist()}
    assert found == {place: nodes[place] for place in nodes if re.fullmatch(r"Bundle\.entry\[\d+\]\.resource", place)}
    assert positions.resource_spans(text, "Patient").tolist() == [[0, *nodes["Bundle"]]]


def test_owners_come_of_one_pass_over_the_texts_and_are_not_sent_to_all_tasks(spark, tmp_path):
    spark.createDataFrame([("a", '{"resourceType":"Patient",\n\n"id":"1"}'), ("b", '{"resourceType":"Bundle","entry":[{"resource":5,"resource":{"resourceType":"Basic","id":"é"}},{"resource":[]}]} ')], "path string, json string").write.parquet(f"{tmp_path}/docs")
    points = [("a", 0, 0), ("a", 0, 26), ("a", 0, 27), ("a", 1, 0), ("a", 1, 1), ("a", 2, 8), ("a", 2, 9), ("b", 0, 46), ("b", 0, 59), ("b", 0, 92), ("b", 0, 93), ("b", 0, 108), ("none", 0, 0), (None, 0, 0), ("a", None, 0)]
    asked = spark.createDataFrame(points, "path string, row long, col long")
    found = positions.owner_at(asked, checked(spark.read.parquet(f"{tmp_path}/docs")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "SortMergeJoin [path" in plan
    patient, basic, none = ("Patient", "Patient", "1"), ("Bundle.entry[0].resource", "Basic", "é"), (None,) * 3
    held = dict(zip(points, [patient, patient, none, patient, none, patient, none, basic, basic, basic, none, none, none, none, none], strict=True))
    assert {tuple(r[:3]): tuple(r[3:]) for r in found.collect()} == held


def test_a_documents_kind_is_told_without_the_schema_of_its_parts(spark):
    texts = {"o": ' \n{"resourceType":"A"}', "n": '{"resourceType":1}', "a": '[{"resourceType":"A"}]', "s": '"{"', "z": "null", "b": "{} {}"}
    docs = _docs(spark, list(texts.items()))
    assert {r["path"]: (r["resource_type"], r["doc_error"]) for r in docs.collect()} == {
        "o": ("A", None), "n": (None, "no resourceType"), "a": (None, "not an object"), "s": (None, "not an object"), "z": (None, "not an object"), "b": (None, "not JSON"),
    }
    assert "schema_of_variant(v" not in docs._jdf.queryExecution().analyzed().toString().lower().replace("schemaofvariant", "schema_of_variant")
